"""Near dedup decides by row where ids are null or repeat; its sets are those of the texts."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import minhash


def text(name, more=""):
    return " ".join(f"{name}{k}" for k in range(100)) + more


def test_rows_with_null_and_repeated_ids(spark):
    near = " more"
    clean = [(1, text("a")), (None, text("b")), (None, ""), (None, None), (11, text("d")), (12, text("e")), (31, text("h")), (32, text("i").upper()), (41, text("j"))]
    # near copies without an id or with that of a clean row; rows that repeat id and text
    gone = [(None, text("a", near)), (12, text("d", near)), (31, text("h")), (31, text("h")), (None, text("i")), (None, text("i")), (42, text("j", near)), (42, text("j", near))]
    # one of each two stays: they share the least id, or have none
    either = [(21, text("f")), (21, text("f", near)), (None, text("g")), (None, text("g", near))]
    docs = spark.createDataFrame(clean + gone + either, "doc_id long, text string")
    left = [tuple(r) for r in minhash.drop_near_copies(docs).collect()]
    assert sorted((r for r in left if r not in either), key=str) == sorted(clean, key=str)
    assert sorted((r[1] or "")[0] for r in left if r in either) == ["f", "g"]


def test_sets_of_slices():
    """Sets don't depend on where in an Arrow batch a text lies."""
    texts = [f"A{k} b  c{k}\x0b\n d" if k % 5 else " " * (k % 3) for k in range(1000)]
    want = []
    for t in texts:
        w = t.lower().split()
        want.append(len(set(zip(w, w[1:], strict=False))))
    assert [len(s) for s in minhash.sets(pa.array(texts))] == want
    assert [len(s) for s in minhash.sets(pa.array(texts).slice(300, 400))] == want[300:700]


def test_close_pairs_that_are_no_links_are_not_written(spark):
    """A group whose members are close to each other, but linked with few, costs pairs as it has links; thinning them loses none."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]

    def edited(words, n):
        out = list(words)
        for k in rng.sample(range(0, 200, 3), n):
            out[k] = f"x{rng.random()}"
        return out

    rows = [edited(base, 19) for _ in range(120)]  # two of them share about 0.69
    rows += [edited(rows[k], 5) for k in range(20)] + [edited(rows[k], 6) for k in range(20)]  # linked with the one they come from
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    sets = [set(zip(w, w[1:], strict=False)) for w in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = list(range(len(rows)))
    for _ in range(10):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    table = minhash.sketches(docs, "doc_id", "text", minhash.LEAST).filter("key is not null")
    classes = minhash.cut(table.withColumnRenamed("n_shingles", "size"))
    none = spark.createDataFrame([], "key binary, root binary")
    pairs = minhash.cross_pairs(minhash.shared_postings(classes), none, classes, 80, minhash.LEAST).count()
    assert len(links) <= pairs < len(links) + 500  # of 12,720
    for at_once in (0, 10_000):
        roots = minhash.rooted(docs, "doc_id", "text", at_once=at_once).select("id", "root").collect()
        least = {}
        for r in roots:
            least[bytes(r["root"])] = min(r["id"], least.get(bytes(r["root"]), r["id"]))
        assert {r["id"]: least[bytes(r["root"])] for r in roots} == dict(enumerate(label))


def test_odd_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 50, 400, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 7).astype(np.uint64)])
        bits = sum(int(x).bit_count() for x in (minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
