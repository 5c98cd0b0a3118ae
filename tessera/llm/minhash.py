"""MinHash near-dedup by an inverted join over signature coordinates.

A document is the set of its 2-word shingles; equal sets are one class. A class has a signature of
``COORDINATES`` minima. Two classes that are similar enough agree in at least ``LEAST`` of them (of
64, 38: a pair at the threshold of 0.8 agrees in fewer with probability 5e-5, a closer one in fewer
far less often), so they differ in at most 26. The coordinates lie in 64 - 38 + 1 = 27 runs of two or
three (the prefix of a run-wise order), and a class is posted under each run with its values: one
run at least agrees as a whole, so no pair that reaches ``LEAST`` is missed. A run of several
coordinates has a short list of postings where a single one's grows with the corpus.

A posting carries the size of its set and four bits of each minimum, as four 64-bit planes. Where
two postings meet, their collisions are counted on the planes, and pairs that can't reach ``LEAST``,
or whose sizes rule them out, are skipped on the spot: nothing of them is written or shuffled. What
is left, nearly all of it true links, is confirmed on the full sets.

Only values that two classes post are kept (tokens are counted alone first, and a Bloom filter of
bounded size keeps other postings from being shuffled). No list of postings is joined with itself at
first: each list links its members to its first one, and each class is confirmed against the least
of its lists' first ones. Confirmed links make components. Then only lists that still hold two
components give pairs, only across components, hot lists split by salts. So the components are
those of all links, and a group of copies costs about a pair a member.

Members of a group that are close without being linked would give pairs as the square of the group.
So in that second step postings also carry an odd sketch of their set: ``ODD`` bits, each the parity
of the number of shingles that hash to it. Two sets differ in at least as many shingles as their
sketches in bits, so a pair whose sketches differ in more bits than a link may have shingles is none,
without error, and isn't written. Pairs that are left are confirmed at once if they are few beside
the classes; else each component first confirms its closest one, and pairs that this made part of one
component are dropped, some times over, before all others are confirmed.

Sets aren't kept: those that are compared are made again from their texts.

Cases: a null text, or one without a word, is empty, linked with nothing and kept; one word makes a
set of one; rows that repeat are in one class; a null id counts as larger than any other, and a
component without an id has null; an empty table gives an empty result; other columns are not read
by ``near_dedup`` and pass through ``drop_near_copies``. Components that don't settle raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bloom import bits_of, n_blocks, test_rows
from tessera.llm.common import cut, lookup_join, lowered_words, whole
from tessera.llm.tables import discard, stored

U = np.uint64
COORDINATES = 64
LEAST = 38
_MIX = U(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 2**63, COORDINATES).astype(U) * U(2) + U(1)
_B = _RNG.integers(0, 2**63, COORDINATES).astype(U)
PLANES = ("p0", "p1", "p2", "p3")
SLICE = 256  # texts looked at together
ODD = 1024  # bits of an odd sketch, a multiple of 64


def runs(least: int) -> list[np.ndarray]:
    """The coordinates in as many runs as one more than may differ."""
    return np.array_split(np.arange(COORDINATES), COORDINATES - least + 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts`` in a row, and where each text's begin (and the last one's end)."""
    words, ends = lowered_words(texts)
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], U)
    return hashes[coded.indices.to_numpy()] if len(hashes) else hashes, ends


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the distinct 2-word shingles of a text's word hashes, sorted; of the whole sequence if it is shorter."""
    if not len(w):
        return np.zeros(0, U)
    s = w[:1] if len(w) == 1 else (w[:-1] * _MIX) ^ (w[1:] + (w[:-1] >> U(29)))
    s = (s ^ (s >> U(31))) * _MIX
    return np.unique(s ^ (s >> U(32)))


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text."""
    for at in range(0, len(texts), SLICE):
        w, ends = words_of(texts.slice(at, SLICE))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield shingles(w[a:b])


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions."""
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 4096):
        part = ((s[at : at + 4096, None] * _A + _B) >> U(32)).min(axis=0).astype(np.uint32)
        np.minimum(out, part, out=out)
    return out


def digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def tokens_of(signatures: np.ndarray, least: int) -> np.ndarray:
    """Each signature's (row's) run and values, hashed, a column a run."""
    out = []
    for k, run in enumerate(runs(least)):
        v = np.full(len(signatures), k + 1, U)
        for c in run:
            v = (v ^ signatures[:, c].astype(U)) * _MIX
            v ^= v >> U(29)
        out.append(v)
    return np.stack(out, axis=1)


def planes_of(signatures: np.ndarray) -> list[np.ndarray]:
    """The low bits of the minima: one 64-bit number a plane."""
    return [np.packbits((signatures >> np.uint32(k)) & np.uint32(1), axis=1).view(np.int64).ravel() for k in range(len(PLANES))]


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The parity of how many members of a set hash to each of ``ODD`` bits."""
    return np.packbits(np.bincount((s >> U(32)).astype(np.int64) % ODD, minlength=ODD) & 1).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, mark, n_shingles, key, tokens, planes, odd); mark is a hash of the text, key is null for empty sets."""
    kinds = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("mark", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    schema = T.StructType([*kinds, *[T.StructField(p, T.LongType()) for p in PLANES], T.StructField("odd", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                each = list(sets(b.column(2)))
                sig = np.array([signature(s) for s in each], np.uint32)
                tokens = tokens_of(sig, least)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel()))
                odd = np.stack([odd_sketch(s) for s in each])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in each], pa.int64()), pa.array([digest(s) for s in each], pa.binary()), lists(tokens), *map(pa.array, planes_of(sig)), lists(odd)], names=schema.names)

    return docs.select(F.col(id_col), _mark(text_col).alias("__mark"), whole(text_col).alias("__text")).mapInArrow(run, schema)


def _mark(text_col: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(whole(text_col))


def shared_postings(classes: DataFrame) -> DataFrame:
    """(token, key, size, planes): the postings of ``classes`` under tokens that two of them have."""
    posted = classes.select(F.explode("tokens").alias("token"), "key", "size", *PLANES)
    shared = cut(posted.groupBy("token").count().filter("count > 1").select("token"))
    blocks = n_blocks(shared.count())
    # what passes the filter by chance meets no other posting
    return cut(test_rows(posted, bits_of(shared, "token", blocks), "token", blocks).filter("maybe").drop("maybe"))


def may_link(a: str, b: str, threshold: int, least: int) -> Column:
    """Whether the postings ``a`` and ``b`` can be of a link, by their sizes and by their planes, on which equal minima always collide."""
    get = lambda side, name: F.col(f"{side}.{name}")
    differ = reduce(Column.bitwiseOR, [get(a, p).bitwiseXOR(get(b, p)) for p in PLANES])
    sizes = 100 * F.least(get(a, "size"), get(b, "size")) >= threshold * F.greatest(get(a, "size"), get(b, "size"))
    return sizes & (COORDINATES - F.bit_count(differ) >= least)


def posting() -> Column:
    return F.struct("key", "size", *PLANES)


def star_pairs(posted: DataFrame, threshold: int, least: int) -> DataFrame:
    """(a, b): each class with the least of its lists' first members that it can be linked with."""
    hubs = posted.groupBy("token").agg(F.min(posting()).alias("x"), F.count("*").alias("n")).filter("n > 1").select(F.col("token").alias("t"), "x")
    met = posted.select("token", posting().alias("y")).join(hubs.hint("merge"), F.col("token") == F.col("t"))
    met = met.filter((F.col("x.key") < F.col("y.key")) & may_link("x", "y", threshold, least))
    return met.groupBy(F.col("y.key").alias("b")).agg(F.min("x.key").alias("a")).select("a", "b")


def may_reach(a: str, b: str, x: str, y: str, threshold: int) -> tuple[Column, Column]:
    """In how many bits the odd sketches ``x`` and ``y`` of the postings ``a`` and ``b`` differ, and whether so few shingles can make a link."""
    # by higher-order functions, as the terms written out make the join's loop too long for the JIT compiler
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return apart, (100 + threshold) * apart.cast("long") <= (100 - threshold) * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def cross_pairs(posted: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int, least: int, per_salt: int = 2048) -> DataFrame:
    """(a, b, apart): the pairs of a list that lie in different components and can be linked, hot lists split by salts."""
    several = F.col("n") > 1
    labelled = posted.join(labels.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"), "left").select("token", posting().alias("y"), F.coalesce("root", "key").alias("root"))
    labelled = cut(labelled)
    lists = labelled.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter(several & (F.col("lo") != F.col("hi"))).select(F.col("token").alias("t"), F.ceil(F.col("n") / per_salt).cast("int").alias("salts"))
    rows = labelled.join(lists.hint("merge"), F.col("token") == F.col("t")).select("token", "y", "root", "salts")
    rows = stored(rows.join(classes.select(F.col("key").alias("k"), "odd").hint("merge"), F.col("y.key") == F.col("k")).select("token", "y", "odd", "root", "salts"))
    left = rows.select("token", F.col("y").alias("x"), F.col("odd").alias("ox"), F.col("root").alias("ra"), F.pmod(F.xxhash64("y.key"), F.col("salts")).cast("int").alias("salt"))
    right = rows.select(F.col("token").alias("t"), "y", F.col("odd").alias("oy"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt2"))
    apart, reach = may_reach("x", "y", "ox", "oy", threshold)
    on = (F.col("token") == F.col("t")) & (F.col("salt") == F.col("salt2")) & (F.col("x.key") < F.col("y.key")) & (F.col("ra") != F.col("rb")) & may_link("x", "y", threshold, least) & reach
    # a salt's part of a list is what a task holds of it
    out = cut(right.join(left.hint("merge"), on).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), apart.alias("apart")).distinct())
    discard(rows)
    return out


def sets_again(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, set) of the classes ``keys``, made of the text of one row of each."""
    wanted = cut(classes.join(keys.select(F.col("key").alias("k")).hint("merge"), F.col("key") == F.col("k"), "left_semi").select(F.xxhash64("row.id", "row.mark").alias("h"), "key"))
    blocks = n_blocks(max(1, wanted.count()))
    rows = docs.select(F.xxhash64(F.col(id_col), _mark(text_col)).alias("h"), whole(text_col).alias("text"))
    some = test_rows(rows, bits_of(wanted, "h", blocks), "h", blocks).filter("maybe").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                each = [s for s in sets(batch.column(0).slice(at, SLICE)) if len(s)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, U), *each]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in each], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "set"])

    made = some.mapInArrow(run, "key binary, set array<long>")
    return made.join(wanted.select(F.col("key").alias("k")).hint("merge"), F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, threshold: int, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) whose sets are similar: 100 * common >= threshold * union. A class in many pairs is split over salts, ``per_task`` in each."""
    some = stored(sets_again(docs, id_col, text_col, classes, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()))
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")).withColumnRenamed("a", "hub")
    of = lambda name: some.select(F.col("key").alias(f"k_{name}"), F.col("set").alias(f"set_{name}")).hint("merge")
    hubs = size.join(of("a"), F.col("hub") == F.col("k_a")).select("hub", "set_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("of_salt"))
    salted = pairs.join(size.hint("merge"), F.col("a") == F.col("hub")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    met = salted.join(of("b"), F.col("b") == F.col("k_b")).join(hubs.hint("merge"), (F.col("a") == F.col("hub")) & (F.col("salt") == F.col("of_salt")))
    both = F.size(F.array_intersect("set_a", "set_b"))
    out = cut(met.withColumn("both", both).filter(100 * F.col("both") >= threshold * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b"))
    discard(some)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, root) for every node of ``edges`` (a, b): its component's least node.

    Large-star and small-star steps in turn: each node hands its larger, then its smaller neighbours
    to its least one, until nothing changes; that not happening is an error. Minima are aggregated
    before they are joined back.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low.hint("merge"), F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        near = large.join(low.hint("merge"), F.col("a") == F.col("k"))
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        e = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = e.select(F.col("b").alias("key")).distinct()
    return e.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(roots.select("key", F.col("key").alias("root")))


def closest(rest: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``rest`` that still lie in different components, and the closest one of each component."""
    root = lambda name: labels.select(F.col("key").alias(f"k_{name}"), F.col("root").alias(f"r_{name}")).hint("merge")
    across = rest.join(root("a"), F.col("a") == F.col("k_a"), "left").join(root("b"), F.col("b") == F.col("k_b"), "left")
    across = cut(across.select("a", "b", "apart", F.coalesce("r_a", "a").alias("ra"), F.coalesce("r_b", "b").alias("rb")).filter("ra <> rb"))
    of = lambda r: across.select(F.col(r).alias("r"), F.struct("apart", "a", "b").alias("pair"))
    best = of("ra").unionByName(of("rb")).groupBy("r").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()
    return across.select("a", "b", "apart"), cut(best)


def joined(rest: DataFrame, labels: DataFrame, confirm: Callable[[DataFrame], DataFrame], at_once: int, most_rounds: int = 4) -> DataFrame:
    """``labels`` with the links among the pairs ``rest`` (a, b, apart); more than ``at_once`` pairs are thinned by rounds of the closest ones."""
    for k in range(most_rounds + 1):
        n = rest.count()
        if not n:
            return labels
        last = n <= at_once or k == most_rounds
        rest, best = (rest, rest) if last else closest(rest, labels)
        more = confirm(best.select("a", "b"))
        labels = cut(components(labels.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more)))
        if last:
            break
        tested = best.withColumnsRenamed({"a": "a1", "b": "b1"})
        untested = rest.join(tested.hint("merge"), (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1")), "left_anti")
        rest = closest(untested, labels)[0]
    return labels


def rooted(docs: DataFrame, id_col: str, text_col: str, threshold: int = 80, least: int = LEAST, at_once: int | None = None) -> DataFrame:
    """(id, mark, n_shingles, key, root): root is the least key of the component, null for empty sets."""
    table = stored(sketches(docs, id_col, text_col, least))
    of = table.select("id", "mark", "n_shingles", "key")
    one = F.min_by(F.struct("tokens", "n_shingles", *PLANES, "odd"), "mark").alias("one")
    classes = stored(table.filter(F.col("key").isNotNull()).groupBy("key").agg(one, F.min(F.struct("mark", "id")).alias("row")).select("key", "row", "one.tokens", F.col("one.n_shingles").alias("size"), *[f"one.{p}" for p in PLANES], "one.odd"))
    posted = shared_postings(classes)
    stars = cut(star_pairs(posted, threshold, least))
    confirm = lambda pairs: confirmed(pairs, docs, id_col, text_col, classes, threshold)
    labels = cut(components(confirm(stars)))
    tested = stars.withColumnsRenamed({"a": "a1", "b": "b1"})
    rest = cut(cross_pairs(posted, labels, classes, threshold, least).join(tested.hint("merge"), (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1")), "left_anti"))
    labels = joined(rest, labels, confirm, at_once if at_once is not None else max(10_000, classes.count() // 4))
    discard(classes)
    return lookup_join(of, labels, ["key"], how="left").select("id", "mark", "n_shingles", "key", F.coalesce("root", "key").alias("root"))


def clustered(docs: DataFrame, id_col: str, text_col: str, threshold: int = 80, least: int = LEAST) -> DataFrame:
    """(id, n_shingles, key, component_id): component_id is the least id of the component."""
    labelled = rooted(docs, id_col, text_col, threshold, least)
    least_id = cut(labelled.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").select("root", "component_id"))
    out = lookup_join(labelled, least_id.withColumn("found", F.lit(True)), ["root"], how="left")
    return out.select("id", "n_shingles", "key", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, least: int = LEAST) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept."""
    d = clustered(docs, id_col, text_col, threshold, least)
    return d.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, least: int = LEAST) -> DataFrame:
    """``docs`` with one row of each component, that of the least id and then key, its columns unchanged.

    Rows are told apart by id and text; of rows that repeat both, one is kept if the component keeps theirs.
    """
    labelled = rooted(docs, id_col, text_col, threshold, least).filter(F.col("root").isNotNull())
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "mark")
    best = cut(labelled.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows")).filter("rows > 1").select("root", "best"))
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key")) & (F.col("mark") == F.col("best.mark"))
    listed = lookup_join(labelled, best, ["root"]).groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.max(same).alias("__keep"), F.count("*").alias("rows"))
    # of the other rows, nothing is to be done
    listed = cut(listed.filter("not __keep or rows > 1").select("__id", "__mark", "__keep"))
    blocks = n_blocks(max(1, listed.count()))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _mark(text_col).alias("mark")).withColumn("h", F.xxhash64("id", "mark"))
    tested = test_rows(rows, bits_of(listed.select(F.xxhash64("__id", "__mark").alias("h")), "h", blocks), "h", blocks)
    found = tested.filter("maybe").join(listed.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    rest = found.filter(F.col("__keep").isNull()).select("row.*")
    one = found.filter("__keep").groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*")
    return tested.filter(~F.col("maybe")).select("row.*").unionByName(rest).unionByName(one)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n
"""
