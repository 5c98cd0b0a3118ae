"""The suffix array and the removal of repeated strings, against brute force."""

import hashlib
import random

import pytest

from tessera.llm.suffix_array import digests, suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_sorted(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 10, 60, 400):
        for alphabet in (1, 2, 4, 200):
            text = [rng.randrange(alphabet) for _ in range(n)]
            assert suffix_array(text) == sorted(range(n), key=lambda i: text[i:])
    text = b"mississippi$banana" * 5
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, length):
    seen = {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((n, i))
    out = []
    for n, (doc, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if len(seen[b[i : i + length]]) > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(120), text(100)
    rows = [(n, text(rng.randint(0, 200))) for n in range(30)]
    rows += [(30 + n, text(20) + " " + passage + " " + text(30)) for n in range(4)]
    rows += [(40 + n, text(10) + passage[rng.randint(0, 150) :] + text(10)) for n in range(6)]
    rows += [(50, other + " " + other), (51, "ha " * 400), (52, "x" * 900), (53, None), (54, ""), (55, other), (55, other), (None, other)]
    near = passage.split()
    for n in range(25):
        w = list(near)
        w[rng.randrange(len(w))] = word()
        rows.append((60 + n, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "length", "max_kinds"), [(1, 400, 2000), (2, 400, 3), (3, 150, 2000)])
def test_against_brute_force(spark, seed, length, max_kinds):
    from tessera.llm.suffix_array import dedup

    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup(docs, length=length, k=length // 4, max_kinds=max_kinds, block_bytes=4000).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    order = lambda x: sorted(x, key=str)
    assert order(got) == order(brute(rows, length))


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0


def brute_words(rows, n):
    seen = {}
    words = [(t or "").encode().lower().split() for _, t in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        inside = set()
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                inside.update(range(i, i + n))
        out.append((doc, len(inside)))
    return sorted(out, key=str)


def test_passages_of_words_and_long_texts(spark, monkeypatch):
    """Words in passages of over 50 words against brute force; texts taken in slices give what whole ones do; other columns don't clash."""
    from tessera.llm import suffix_array as sa

    rows = corpus(4)
    short = " ".join(f"w{k}" for k in range(55))  # over 50 words, under 400 bytes
    rows += [(100, f"a {short} b"), (101, f"c d {short.upper()} e"), (102, f"f {' '.join(short.split()[:50])} g")]
    docs = spark.createDataFrame([(*r, b"clash", "clash", 1) for r in rows], "doc_id long, text string, key binary, id string, h long").repartition(3)
    got = {}
    for longest in (sa._LONGEST, 450):
        monkeypatch.setattr(sa, "_LONGEST", longest)
        d = sa.digests(docs).collect()
        assert sorted(((r["doc_id"], r["n_passage_words"]) for r in d), key=str) == brute_words(rows, 51)
        got[longest] = sorted(map(tuple, d), key=str)
    first, second = got.values()
    assert first == second
    assert [x[:5] for x in first] == sorted(brute(rows, 400), key=str)
