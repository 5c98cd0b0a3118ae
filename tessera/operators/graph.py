"""Graph operators on edges (src, dst); repeated edges count as often as they occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators.tools import cut, small

MOST_LINKS = 1000


def neighbours(edges: DataFrame) -> DataFrame:
    """(doc_id, other): both directions of every edge."""
    return edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("other")).unionAll(edges.select(F.col("dst").alias("doc_id"), F.col("src").alias("other")))


def k_hop(edges: DataFrame, root: int, hops: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_id, hops) of all within ``hops`` links of ``root``, in either direction, at their least distance.

    Each round joins the last ring with the edges; a ring is broadcast only while it is small.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([(root, 0)], "doc_id long, hops int")
    ring = found.select("doc_id")
    for k in range(1, hops + 1):
        near = neighbours(edges).join(small(ring, config.broadcast_rows), "doc_id", "left_semi").select(F.col("other").alias("doc_id")).distinct()
        ring = cut(near.join(found.select("doc_id"), "doc_id", "left_anti"))
        if ring.isEmpty():
            break
        found = found.unionAll(ring.select("doc_id", F.lit(k).alias("hops")))
    return found


def page_rank_step(ranks: DataFrame, links: DataFrame, n: int, teleport: float) -> DataFrame:
    """One synchronous step; ``links`` (src, share: 1 / out-degree of src, dsts). Sums are combined before they shuffle."""
    shares = links.join(ranks.select(F.col("doc_id").alias("src"), "pr"), "src").select(F.explode("dsts").alias("dst"), (F.col("pr") * F.col("share")).alias("gives"))
    given = shares.groupBy("dst").agg(F.sum("gives").alias("got"))
    new = F.lit(teleport / n) + F.lit(1 - teleport) * F.coalesce("got", F.lit(0.0))
    return ranks.join(given.withColumnRenamed("dst", "d"), F.col("doc_id") == F.col("d"), "left").select("doc_id", new.alias("pr"), F.abs(new - F.col("pr")).alias("delta"))


def page_rank(edges: DataFrame, config: EngineConfig = EngineConfig(), iterations: int | None = None, converge: bool = True) -> DataFrame:
    """(doc_id, pr) of all pages with an in-link, summing to 1: synchronous steps until the ranks move by less than the limit in all.

    Pages without in-links have no rank and give none. With ``iterations`` and not ``converge``,
    exactly so many steps.
    """
    pages = cut(edges.select(F.col("dst").alias("doc_id")).distinct())
    n = pages.count()
    if not n:
        return pages.withColumn("pr", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("deg")).withColumnRenamed("src", "s")
    # links of pages without rank give nothing: they leave before the first step
    links = edges.join(degree, F.col("src") == F.col("s")).join(pages.withColumnRenamed("doc_id", "p"), F.col("src") == F.col("p"), "left_semi")
    # a row some MOST_LINKS links of a page: steps shuffle and sort pages, not links
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / MOST_LINKS))
    links = cut(links.groupBy("src", "deg", part.alias("part")).agg(F.collect_list("dst").alias("dsts")).select("src", (1 / F.col("deg")).alias("share"), "dsts"))
    ranks = pages.withColumn("pr", F.lit(1.0 / n))
    steps = (config.page_rank_iterations + 1) if iterations is None else iterations
    for _ in range(steps):
        ranks = cut(page_rank_step(ranks, links, n, config.teleport))
        if converge and ranks.agg(F.sum("delta")).first()[0] < config.page_rank_delta:
            break
    total = ranks.agg(F.sum("pr")).first()[0]
    return ranks.select("doc_id", (F.col("pr") / F.lit(total)).alias("pr"))


def induced(edges: DataFrame, docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(source, destination): the distinct links between ``docs`` (doc_id, title), by title."""
    d = small(docs.select(F.col("doc_id").alias("sid"), F.col("title").alias("source")), config.broadcast_rows)
    e = small(docs.select(F.col("doc_id").alias("did"), F.col("title").alias("destination")), config.broadcast_rows)
    return edges.join(d, F.col("src") == F.col("sid")).join(e, F.col("dst") == F.col("did")).select("source", "destination").distinct()
