"""Operators on postings (doc_id, pos)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = ("doc_id", "pos")


def term(postings: DataFrame, token: str) -> DataFrame:
    return postings.filter(F.col("token") == token).select(*COLUMNS)


def free(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """All postings of all tokens; those of a token that is named twice come twice. One scan."""
    times = Counter(tokens)
    rows = postings.filter(F.col("token").isin(*times))
    if all(n == 1 for n in times.values()):
        return rows.select(*COLUMNS)
    n = F.coalesce(*[F.when(F.col("token") == t, F.lit(k)) for t, k in times.items()])
    return rows.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), n)).alias("x")).select(*COLUMNS)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(right)


def _ranked(d: DataFrame) -> DataFrame:
    return d.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents of both sides: in each, the n-th posting of one side goes with the n-th of the other, and both stay."""
    r = _ranked(right).select(F.col("doc_id").alias("d"), F.col("rn").alias("k"), F.col("pos").alias("rpos"))
    pairs = _ranked(left).join(r, (F.col("doc_id") == F.col("d")) & (F.col("rn") == F.col("k")))
    return pairs.select("doc_id", F.explode(F.array("pos", "rpos")).alias("pos"))


def intersect_docs(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").distinct().join(right.select("doc_id"), "doc_id", "left_semi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings of documents that the right side hasn't."""
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_anti")


def distance(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Postings of a left one and a right one that comes at most ``most`` later.

    Both sides are tagged and sorted once by document; a window looks for the nearest other side, so
    no pair is made, however often a word occurs.
    """
    both = left.select(*COLUMNS, F.lit(True).alias("is_left")).unionAll(right.select(*COLUMNS, F.lit(False).alias("is_left"))).distinct()
    w = W.partitionBy("doc_id").orderBy("pos").rangeBetween
    after = F.max(F.when(~F.col("is_left"), F.lit(1))).over(w(0, most))
    before = F.max(F.when(F.col("is_left"), F.lit(1))).over(w(-most, 0))
    hit = both.withColumn("hit", F.when(F.col("is_left"), after).otherwise(before))
    return hit.filter("hit = 1").select(*COLUMNS).distinct()


def phrase(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Postings of the tokens where they stand in a row. One scan, one shuffle by document."""
    places = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(tokens)]), lambda x: x["t"] == F.col("token"))
    rows = postings.filter(F.col("token").isin(*set(tokens))).select("doc_id", "pos", F.explode(F.transform(places, lambda x: x["k"])).alias("k"))
    starts = rows.groupBy("doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == len(tokens))
    places = F.sequence(F.col("start"), F.col("start") + len(tokens) - 1).cast("array<int>")
    return starts.select("doc_id", F.explode(places).alias("pos")).distinct()


def phrase_chained(postings: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """The looser phrase: neighbours within a distance of one, folded from the left."""
    out = distance(term(postings, tokens[0]), term(postings, tokens[1]), 1)
    for k in range(1, len(tokens) - 1):
        out = distance(out, distance(term(postings, tokens[k]), term(postings, tokens[k + 1]), 1), k)
    return out


def wildcard(postings: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Postings of tokens with exactly one character between prefix and suffix; the prefix reaches the scan."""
    t = F.col("token")
    return postings.filter(t.startswith(prefix) & t.endswith(suffix) & (F.length(t) == len(prefix) + len(suffix) + 1)).select(*COLUMNS)


def zone(sub: DataFrame, extents: DataFrame, elem: str) -> DataFrame:
    """Postings inside the zone's range of their document."""
    e = extents.filter(F.col("elem") == elem).select(F.col("doc_id").alias("d"), "start_pos", "end_pos")
    return sub.join(e, (F.col("doc_id") == F.col("d")) & (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))).select(*COLUMNS)


def within(sub: DataFrame, hops: DataFrame) -> DataFrame:
    """Postings of documents in the hop table."""
    return sub.join(hops.select("doc_id"), "doc_id", "left_semi")
