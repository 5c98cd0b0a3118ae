"""Each operator against a brute-force version, on awkward documents."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, exact_dedup, html, langid, lm, minhash, mixing, quality, sharding
from tessera.llm.queries import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, n_words string, h string, key string, id string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(seed=1, n=120):
    """Documents with nulls, empty, long, equal and nearly equal texts, repeated rows, a hot source."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    base = text(80)
    out = []
    for k in range(n):
        t = text(rng.randint(1, 150))
        if k % 7 == 0:
            w = base.split()
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            t = " ".join(w)
        if k % 11 == 0:
            t = base.replace(" ", rng.choice(["  ", "\n", "\t"]))
        if k % 13 == 0:
            t = t.upper() + "\n" + t + "\n" + t
        out.append((k, t, rng.choice(["en", "fr", None]), "hot" if k % 3 == 0 else rng.choice(["a", "b", "é", None])))
    out += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n\t\x0b\r", "fr", "b"), (n + 3, text(6000), "en", "hot"), (n + 4, "one", "en", "a"), (n + 4, "one", "en", "a"), (n + 5, "### $$$ %%% " * 30, "en", "a"), (n + 6, "ha ha ha ha ha ha ha ha", "en", "hot"), (None, "no id here", "en", "a"), (n + 7, "<|endoftext|>x<|startoftext|> Don't 12½ ΑΣ \x1c!", "xx", "b")]
    return out


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = []
    for d, t, *_ in rows:
        keep = min(groups[norm(t)])[3]
        want.append((d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    same(got(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)
    same(got(exact_dedup.exact_dedup(docs, max_bits=1, hot_share=0.02), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), want)
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    same([(min(g)[3],) for g in groups.values()], got(left, "doc_id"))
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def measured(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def judged(rows, prior):
    """Verdicts with thresholds from all values of a group, binned like the sketches."""
    ratio = lambda a, b: a / b if b else 0.0
    values = [{"symbol_ratio": ratio(m[2], m[0]), "dup_line_ratio": ratio(m[3], m[5]), "repeat_ratio": ratio(m[4], m[0]), "word_length": ratio(m[1], m[0])} for m in (measured(r[1]) for r in rows)]

    def quantile(name, members):
        bins = sorted(math.ceil(math.log(min(x, quality.HIGH)) / math.log(quality.GAMMA)) for x in (values[k][name] for k in members) if x >= quality.LOW)
        return len(bins), lambda p: quality.GAMMA ** bins[math.ceil(p * len(bins)) - 1]

    def pulled(own, n, towards):
        return towards if own is None else own if towards is None else (n * own + prior * towards) / (n + prior)

    def cutoff(name, levels):
        kind, x = quality.RULES[name]
        out = None
        for members in levels if kind == "rare" else levels[1:]:
            n, q = quantile(name, members)
            if kind == "rare":
                out = pulled(q(x) if n else None, n, out)
            else:
                out = pulled(q(0.75) + x * (n * (q(0.75) - q(0.25)) + prior * q(0.5) / 4) / (n + prior) if n else None, n, out)
        return out

    out = []
    for k, r in enumerate(rows):
        n, _, _, _, again, _ = measured(r[1])
        levels = [range(len(rows)), [j for j, s in enumerate(rows) if s[2] == r[2]], [j for j, s in enumerate(rows) if s[2:4] == r[2:4]]]
        failed = n < 10 or 100 * again > 20 * n
        limits = {m: cutoff(m, levels) for m in quality.RULES}
        out.append((failed, not failed and all(limits[m] is None or values[k][m] <= limits[m] for m in quality.RULES)))
    return out


@pytest.mark.parametrize("prior", [0, 30])
def test_quality(docs, rows, empty, prior):
    want = [(r[0], *measured(r[1])[:5], *v) for r, v in zip(rows, judged(rows, prior), strict=True)]
    d = quality.quality_report(docs, prior=prior)
    same(got(d, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), want)
    kept = quality.filter_quality(docs, prior=prior)
    assert kept.columns == docs.columns
    same(got(kept, "doc_id", "text"), [(r[0], r[1]) for r, w in zip(rows, want, strict=True) if w[-1]])
    assert quality.quality_report(empty).count() == quality.filter_quality(empty).count() == 0


def test_quality_cutoffs_adapt(spark):
    """Groups of other habits have other cutoffs, and what is common in one is rejected in another."""
    rng = random.Random(2)
    data = []
    for k in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
        for _ in range(rng.randint(20, 30) if k % 2 else int(rng.random() < 0.1)):
            words[rng.randrange(60)] += "$"
        data.append((k, " ".join(words), "en", "code" if k % 2 else "prose"))
    data.append((600, " ".join(["word$" + "abcdefghijkl"[i % 12] + str(i) for i in range(25)] + [f"plain{i}" for i in range(35)]), "en", "prose"))
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    measured = quality.with_metrics(d).withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    limits = {r["source"]: r for r in quality.thresholds(measured, prior=5).collect()}
    assert limits["code"]["max_symbol_ratio"] > 5 * limits["prose"]["max_symbol_ratio"] > 0
    assert limits["code"]["max_word_length"] != limits["prose"]["max_word_length"]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(d, prior=5).collect()}
    assert not kept[600]
    assert sum(kept[k] for k in range(1, 600, 2)) > 0.9 * 300
    assert sum(kept[k] for k in range(0, 600, 2)) > 0.9 * 300


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s] or not sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs, rows, empty):
    size = [len(WORDS.findall(r[1] or "")) for r in rows]
    by = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        by[r[3]] += n
    target = water(by)
    out = mixing.mix(docs, block_words=8).collect()
    same([(r["doc_id"], r["size"], r["source_size"]) for r in out], [(r[0], n, by[r[3]]) for r, n in zip(rows, size, strict=True)])
    taken = collections.Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 24 for s in by)
    assert got(mixing.mix(docs.repartition(5), block_words=8), "doc_id", "taken") == got(mixing.mix(docs, block_words=8), "doc_id", "taken")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # no setting of the session changes the mix
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = mixing.mix(docs, block_words=8, bucket_rows=10)
        assert got(again, "doc_id", "taken", "first_shard") == got(mixing.mix(docs.repartition(2), block_words=8, bucket_rows=10), "doc_id", "taken", "first_shard")
        assert got(mixing.mix(docs, block_words=8), "doc_id", "taken") == got(docs.sparkSession.createDataFrame(out), "doc_id", "taken")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sharded = mixing.mixed_documents(docs, block_words=8, shard_slots=50, shard_col="shard")
    assert sharded.columns == [*docs.columns, "shard"]
    by_shard = collections.Counter(r["shard"] for r in sharded.collect())
    assert len(by_shard) > 10 and max(by_shard.values()) < 40
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert max(collections.Counter(r["doc_id"] for r in whole.filter("doc_id <> 124").collect()).values()) <= 3


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1000):
        d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(1)).alias("x"))
        assert sorted(r[0] for r in d.collect()) == list(range(n))
        back = d.select(mixing.permuted(F.col("x"), F.lit(n).cast("long"), F.lit(5), F.lit(1), back=True).alias("k")).collect()
        assert [r[0] for r in back] == list(range(n))


def draw(key, child, weight):
    # Spark hashes columns in turn, each with the hash before it as seed
    h = xxhash.xxh64_intdigest(child.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return math.log(((h >> 11) + 0.5) / 2**53) / weight


def descend(key, tree):
    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else x
    pick = lambda level, name: max(level, key=lambda c: draw(key, name(c), weigh(level[c])))
    region = pick(tree, str)
    rack = pick(tree[region], str)
    return pick(tree[region][rack], lambda s: f"{rack}#{s}")


def test_sharding(docs, rows, empty):
    out = sharding.assign(docs).collect()
    want = []
    for d, t, *_ in rows:
        key = "\0" if d is None else str(d)
        b = (t or "").encode()
        want.append((d, len(b) + 1, zlib.crc32(b), "key", descend(key, sharding.tree(16)), descend(key, sharding.tree(17))))
    same([(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in out], want)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty).count() == 0


def test_near_dedup(docs, rows, empty):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(w, w[1:], strict=False)) or {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = [(r[0], len(s), low.get(find(i)), r[0] == low.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]
    same(got(minhash.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept"), want)
    assert minhash.near_dedup(empty).count() == 0
    unique = docs.filter("doc_id <> 124 and doc_id is not null")
    left = minhash.drop_near_copies(unique)
    assert left.columns == docs.columns
    same(got(left, "doc_id"), [(w[0],) for w in want if w[3] and w[0] not in (124, None)])


def test_stars_miss_no_link(spark):
    """Members that agree with each other, not with their list's first one, are found in the second round."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 20)):
            w[rng.randrange(100)] = word()
        rows.append((k, " ".join(w), None, None))
    d = spark.createDataFrame([(a, b) for a, b, *_ in rows], "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t, *_ in rows]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    same(got(minhash.near_dedup(d), "doc_id", "component_id"), list(enumerate(label)))


def test_bpe(docs, rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    want = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    same(got(bpe.encode_digests(docs, WORD_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    same([(r["doc_id"], len(r["ids"])) for r in bpe.encode_ids(docs, WORD_BPE).collect()], [w[:2] for w in want])
    assert bpe.encode_digests(empty, WORD_BPE).count() == 0


def test_bpe_finds_what_merging_finds():
    """Random vocabularies: the stored last tokens give what applying the merges in order gives."""
    rng = random.Random(4)
    for _ in range(30):
        symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        vocab, merges = list(symbols), []
        for _ in range(25):
            left = rng.choice([s for s in vocab if not s.endswith("</w>")])
            right = rng.choice(vocab)
            if left + right not in vocab:
                vocab.append(left + right)
                merges.append([left, right])

        def merged(word, merges=merges):
            out = [*word[:-1], word[-1] + "</w>"]
            while True:
                ranks = [merges.index([a, b]) if [a, b] in merges else 999 for a, b in zip(out, out[1:], strict=False)]
                if not ranks or min(ranks) == 999:
                    return out
                k = ranks.index(min(ranks))
                out[k : k + 2] = [out[k] + out[k + 1]]

        spec = {"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges}, "added_tokens": []}
        e = bpe.Encoder(bpe.Vocabulary(json.dumps(spec)))
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert [vocab[i] for i in e.encode(w)] == merged(w)


def phrases(text, sample):
    count, at = langid.ESCAPE * sum(c not in sample for c in text), 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_langid(spark, docs, rows, empty):
    rng = random.Random(3)
    of = {"xx": "abcd", "yy": "cdefé"}
    data = []
    for k in range(200):
        lang = rng.choice(list(of))
        data.append((k, " ".join("".join(rng.choice(of[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 400))), lang))
    data += [(900, None, "xx"), (901, "12 %%", "yy"), (902, "", None), (None, "abab", "xx")]
    out = langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    want = {d: lang for d, _, lang in data}
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert 0 <= r["score"] <= 1
            assert r["lang_pred"] == want[r["doc_id"]]
    assert langid.identify(docs).count() == len(rows)
    assert langid.identify(empty).count() == 0
    sample = " ".join("".join(rng.choice("ab ") for _ in range(30)) for _ in range(20))
    ident = langid.Identifier({"xx": [sample]})
    learned = " ".join("".join(c if c.isalpha() else " " for c in sample).split())
    for text in ("abba ab", "zab zz", "a", "bbbbbbbbbbbbbbbbbbbbb a", "ab" * 700):
        bits, _ = ident.entropies([text])
        whole = sum(phrases(text[k : k + langid.ROW], learned) for k in range(0, len(text), langid.ROW))
        assert bits[0, 0] == pytest.approx(whole * ident.parsers[0].bits / len(text))


def spelling(words):
    """P(word) by interpolated 3-grams of bytes over the learned ``words``."""
    grams = [collections.Counter() for _ in range(3)]
    for w in words:
        x = b"  " + w + b" "
        for i in range(2, len(x)):
            for k in range(3):
                grams[k][x[i - k : i + 1]] += 1

    def p(byte, context):
        if context is None:
            return 1 / 256
        after = {g: n for g, n in grams[len(context)].items() if g[:-1] == context}
        below = p(byte, context[1:] if context else None)
        total = sum(after.values())
        if not total:
            return below
        return max(after.get(context + byte, 0) - lm.DISCOUNT, 0) / total + lm.DISCOUNT * len(after) / total * below

    def word(w):
        x = b"  " + w + b" "
        return math.prod(p(x[i : i + 1], x[i - 2 : i]) for i in range(2, len(x)))

    return p, word


def test_langid_tells_all_characters_apart():
    """Two languages of 2,000 characters each, in and above the BMP; phrases are those of the automaton. Ties go to the first name."""
    rng = random.Random(12)
    alphabets = {"aa": [chr(0x4E00 + k) for k in range(1900)] + [chr(0x20000 + k) for k in range(100)], "bb": [chr(0x4E00 + 1900 + k) for k in range(1900)] + [chr(0x20100 + k) for k in range(100)]}
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randint(1, 3))) for _ in range(800)] for x, a in alphabets.items()}
    passage = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    ident = langid.Identifier({x: [passage(x, 400) for _ in range(10)] for x in words})
    texts = [passage(x, n) for x in words for n in (1, 5, 60) for _ in range(20)]
    assert ident.predict(texts)[0] == [x for x in words for _ in range(60)]
    sample = passage("aa", 300)
    one = langid.Identifier({"aa": [sample]})
    for text in texts:
        bits, _ = one.entropies([text])
        whole = sum(phrases(text[k : k + langid.ROW], sample) for k in range(0, len(text), langid.ROW))
        assert bits[0, 0] == pytest.approx(whole * one.parsers[0].bits / len(text))
    assert langid.Identifier({"zz": [sample], "yy": [sample]}).predict(texts)[0] == ["yy"] * len(texts)


def test_lm(spark, docs, rows, empty):
    out = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(docs, share=0.01, chunk_bytes=3000).collect()}
    tokens = [([w for w in (t or "").encode().lower().split()] + [b""]) for _, t, *_ in rows]
    fold = [None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 7 for r in rows]
    train = [t for t, f in zip(tokens, fold, strict=True) if f is not None and f != 2]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    often = {w for w in c if c[w] >= 0.01 * n}
    pairs = collections.Counter(x for t in train for x in zip([b"", *t], t, strict=False))
    byte, spell = spelling(c)
    assert sum(byte(bytes([x]), b"ab") for x in range(256)) == pytest.approx(1)
    assert sum(byte(bytes([x]), b"\x00?") for x in range(256)) == pytest.approx(1)
    spells = {w: spell(w) for t in tokens for w in t}

    def p(before, w):
        root = max(c[w] - d, 0) / n + d * v / n * spells[w]
        if before not in often:
            return root
        arcs = {x: pairs[before, x] for x in often if pairs[before, x]}
        total = max(c[before], sum(arcs.values()))
        kept = {x: max(k - lm.DISCOUNT, 0) / total for x, k in arcs.items()}
        return kept.get(w, 0) + (1 - sum(kept.values())) * root

    assert len(often) > 3
    for r, t, f in zip(rows, tokens, fold, strict=True):
        o = out[r[0], len(t)]
        assert (o["held_out"], o["n_known"], o["train_tokens"]) == (f == 2, sum(c[w] > 0 for w in t), n)
        assert o["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert o["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([b"", *t], t, strict=False)))
    assert len(out) == len({(r[0], len(t)) for r, t in zip(rows, tokens, strict=True)})
    assert lm.score(empty).count() == 0
    alone = lm.score(docs.filter("doc_id is null")).collect()  # nothing to learn from
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in alone] == [(0, 0, 0.0)]
    assert alone[0]["score"] == pytest.approx(len(b"no id here ") * math.log10(1 / 256) + math.log10(1 / 256))


def test_lm_tells_text_from_noise(spark):
    """Unknown words cost more than text that was not learned, and held-out text gains on the base by its known words alone."""
    rng = random.Random(8)
    pool = ["".join(rng.choice(["ka", "lo", "mi", "ren", "tu", "s"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text():
        at = [rng.randrange(40)]
        while len(at) < 120:
            at.append((7 * at[-1] + rng.choice([0, 0, 0, 1, 2])) % 40 if rng.random() < 0.9 else rng.randrange(len(pool)))
        return " ".join(pool[k] for k in at)

    noise = lambda: " ".join("".join(rng.choice("qwxzvbnjk0123456789#") for _ in range(6)) for _ in range(120))
    held = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2][:40]
    data = [(k, text()) for k in range(300) if k not in held] + [(k, text()) for k in held[:20]] + [(k, noise()) for k in held[20:]]
    out = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    real, junk = ([out[k] for k in x] for x in (held[:20], held[20:]))
    assert max(r["score"] / r["n_tokens"] for r in junk) < min(r["score"] / r["n_tokens"] for r in real) - 3
    known = [r for r in real if r["n_known"] == r["n_tokens"]]
    assert known and all(r["score"] > r["base_score"] for r in known)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy!</div>{notice}
<article class="post-{n}"><h1>Title &amp; {n}</h1><p>First&nbsp;line <b>of {n}<br>page<p>Second   &lt;one&gt; {n}</p>{extra}</article>
<aside>See also</aside><section class="comments"><p>Nice!</p></section><form><label>Mail</label><input></form><!-- <p>no</p> --><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    pages, want = [], {}
    for n in range(12):
        extra = "<ul><li>a{0}<li>b</ul>".format(n) if n % 2 else ""
        pages.append((n, f"http://a.example.com/{n}", PAGE.replace("{notice}", "<p>Closed today</p>" if n % 3 else "").replace("{n}", str(n)).replace("{extra}", extra)))
        want[n] = "\n".join([f"Title & {n}", f"First line of {n} page", f"Second <one> {n}", *([f"a{n}", "b"] if n % 2 else [])])
    pages += [(20, "http://b.example.com/", None), (21, None, ""), (22, "x", "<p>bare</p> text"), (23, "http://c/", "<div><p>only</p></div>"), (23, "http://c/", "<div><p>only</p></div>"), (None, "http://c/", "<p>" + "long " * 50_000)]
    d = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, text string, rule string")
    out = html.main_text(d).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert {k: by[k] for k in want} == want
    assert (by[20], by[21], by[22], by[23]) == ("", "", "bare\ntext", "only")
    assert len(out) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.main_text(d.limit(0)).count() == 0


def test_wrapper_is_union_free():
    """Mismatches become optional groups, runs become repeated ones, texts that differ become slots."""
    a = html.wrapper(html.parse("<div><h1>A</h1><p>x</p><p>y</p><hr><ul><li>1</li></ul></div>"))
    b = html.wrapper(html.parse("<div><h1>A</h1><h2>B</h2><p>z</p></div>"))
    w = html.join(a, b)[html.KIDS][0]
    assert [(k[html.SHAPE], k[html.OPT], k[html.REP]) for k in w[html.KIDS]] == [("h1", False, False), ("h2", True, False), ("p", False, True), ("ul", True, False)]
    assert w[html.KIDS][0][html.TEXT] == html._digest("A")
    assert w[html.KIDS][2][html.TEXT] == html.SLOT
    assert html.join(html.wrapper(html.parse("<p class=a>x")), html.wrapper(html.parse("<p class=b>x")))[html.KIDS][0][html.SHAPE] == "p.*"


LAYOUT = """<html><body><div class="q1"><a href="/">Home</a> <a href="/x">News</a></div><div class="q2">We use tokens to keep you signed in. Read on or leave, it is all the same to us, and has been for years.</div>
{title}<div class="{box}"><div class="w"><p>{first}</p>{rest}</div><div class="more"><a href="/z">All of our news</a></div></div>
<div class="q5">{teaser}</div><div class="q6"><p>Some street 1, some town. All rights reserved by those who have them.</p></div></body></html>"""


def test_html_needs_its_wrapper():
    """Hosts without <article> or names that tell anything: the wrapper finds the article, reading pages alone doesn't."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    pages, want = [], []
    for k in range(12):
        paragraphs = [say(60) for _ in range(rng.randint(1, 4))]
        title = say(4)
        box = "zx" if k % 4 else f"zx k{'abcdefghijkl'[k]}"
        pages.append(LAYOUT.format(title=f"<h1>{title}</h1>", box=box, first=paragraphs[0], rest="".join(f"<p>{x}" for x in paragraphs[1:]), teaser=say(6)))
        want.append("\n".join([title, *paragraphs]))
    whole = html.wrapper(html.parse(pages[0]))
    for p in pages[1:]:
        whole = html.join(whole, html.wrapper(html.parse(p)))
    rule = html.rules(whole)
    assert [html.extract(html.parse(p), rule) for p in pages] == want
    alone = [html.read_alone(p) for p in pages]
    assert all(a != w and "We use tokens" in a for a, w in zip(alone, want, strict=True))


def test_html_drops_no_text_for_being_constant():
    """A heading or paragraph of the article stays, though it is the same on all pages; so does all of a host of copies."""
    page = "<body><nav>x</nav><article class='{long}'><h1>Report</h1><p>{text}</p><h2>Summary</h2><p>Same words each time.</p></article></body>"
    long = "u" * 90 + " sidebar"
    for texts in (["one and the same"] * 20, [f"text {k} of many" for k in range(20)]):
        pages = [page.format(text=t, long="wide") for t in texts]
        w = html.wrapper(html.parse(pages[0]))
        for p in pages[1:]:
            w = html.join(w, html.wrapper(html.parse(p)))
        assert [html.extract(html.parse(p), html.rules(w)) for p in pages] == [f"Report\n{t}\nSummary\nSame words each time." for t in texts]
    assert html.parse(f"<div class='{long}'>x</div>").kids[0].bad


def test_html_two_articles():
    """A page with two articles of one shape has both; with two layouts on a host, each page is read by its own."""
    two = html.read_alone("<main><article><p>a</p></article><article><p>b</p></article></main>")
    assert two == "a\nb"
    pages = [f"<body><div class=a><p>{'first kind ' * 20}{k}</p></div><div class=n>{k} like this</div></body>" for k in range(6)] + [f"<body><section class=b><p>{'second kind ' * 10}{k}</p></section><div class=n>{k} like this</div></body>" for k in range(3)]
    w = html.wrapper(html.parse(pages[0]))
    for p in pages[1:]:
        w = html.join(w, html.wrapper(html.parse(p)))
    out = [html.extract(html.parse(p), html.rules(w)) for p in pages]
    assert out == [("first kind " * 20 + str(k)) for k in range(6)] + [("second kind " * 10 + str(k)) for k in range(3)]
