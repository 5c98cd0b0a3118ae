"""The test tables as articles and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: the first line is an infobox, the last of several a citation, language and source are categories."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    flat = lambda c: F.translate(c, "\n\t", "  ")
    box = F.struct(F.lit("lead").alias("itype"), flat(F.get(lines, F.lit(0))).alias("text"))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc"), "doc_id").alias("title"),
        F.substring(flat(F.coalesce("text", F.lit(""))), 1, 80).alias("abstract"),
        F.concat_ws(" ", "lang", "source").alias("categories"),
        F.date_format(F.timestamp_seconds(F.col("doc_id") * 3600), "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        flat(F.coalesce("text", F.lit(""))).alias("main_text"),
        F.lit("").alias("links"),
        F.array(box).alias("infoboxes"),
        F.when(F.size(lines) >= 2, F.array(flat(F.element_at(lines, -1)))).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph of parts and suppliers, with cycles."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = F.col("l_suppkey") + 10_000_000
    odd = li.filter(F.col("l_linenumber") % 2 == 1).select(F.col("l_partkey").alias("src"), supplier.alias("dst"))
    even = li.filter(F.col("l_linenumber") % 2 == 0).select(supplier.alias("src"), F.col("l_partkey").alias("dst"))
    return odd.distinct().unionAll(even.distinct())


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``documents`` and ``labels`` as the four tables of an article store.

    Documents without text have no content. Labels are infoboxes, of some articles; lines are
    citations. Links mix ids with what isn't one; dates come in several forms, some of them none.
    Documents labelled as poor are there twice, under another title, and the toxic ones once more
    without an id.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    i = F.col("doc_id")
    date = F.when(i % 5 == 0, F.lit("soon")).when(i % 5 == 1, F.concat(F.lit("2024-1-"), i % 28 + 1, F.lit(" 3:4:5"))).when(i % 5 == 2, F.lit("2016-12-31 23:59:60")).when(i % 5 == 3, F.lit(None).cast("string")).otherwise(F.concat(F.lit("2023-02-"), F.lpad((i % 40 + 1).cast("string"), 2, "0"), F.lit(" 00:00:00")))
    article = d.select(i.alias("articleid"), F.concat(F.lit("doc"), i).alias("title"), F.col("lang").alias("domain"), F.lit(0).cast("short").alias("namespace"), date.alias("lastupdated"), (i + 100).alias("dumpid"))
    links = F.concat_ws("\t", i + 1, F.lit("x"), F.concat(F.lit(" "), i * 2, F.lit(" ")), F.lit("-3"), F.lit("99999999999"), F.lit(""), i + 1)
    content = d.filter(F.col("text").isNotNull()).select(i.alias("articleid"), F.col("source").alias("categories"), F.substring("text", 1, 20).alias("abstracts"), links.alias("links"), "text")
    boxes = labels.select(i.alias("articleid"), F.concat(F.lit("Quality"), "quality").alias("infoboxtype"), F.concat(F.lit("toxic "), "toxic").alias("body"))
    cites = d.select(i.alias("articleid"), F.posexplode(F.split("text", "\n")).alias("k", "body")).select("articleid", F.col("k").cast("long").alias("citationid"), "body")
    return {"article": article, "content": content, "infoboxes": boxes, "citations": cites}


def crowded(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Assembled ``docs`` with repeated ids and rows without one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = docs.join(labels, "doc_id")
    again = labelled.filter("quality = 0").withColumn("title", F.concat(F.lit("z"), "title")).select(docs.columns)
    lost = labelled.filter("toxic = 1").withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns)
    return docs.unionByName(again).unionByName(lost)
