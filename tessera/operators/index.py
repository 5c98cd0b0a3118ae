"""The index: positional postings, term and document frequencies, zone extents, links and PageRank, as tables.

Positions run through a document's infoboxes, main text, citations and categories, in this order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import graph
from tessera.operators.tools import forget, kept, small
from tessera.sources import schemas

MOST_ID = 2**32 - 1
SPREAD = 16  # files that a token's rows are in


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    tf: DataFrame
    dictionary: DataFrame
    extents: DataFrame
    edges: DataFrame
    docs: DataFrame
    page_rank: DataFrame

    def save(self, path: str, dump_id: int) -> None:
        """Write version ``dump_id``, then move the pointer to it in one step, so that readers see a whole version.

        Texts are tokenised once for the postings; tf and dictionary are counted from what was
        written. Tables with tokens are sorted by them: row groups are skipped.
        """
        spark = self.docs.sparkSession
        folder = f"{path}/dump_id={dump_id}"

        def write(name: str, df: DataFrame) -> DataFrame:
            if "token" in df.columns:
                df = df.sortWithinPartitions(*[c for c in ("token", "doc_id", "pos") if c in df.columns])
            writer = df.write.mode("overwrite")
            if "token" in df.columns:
                writer = writer.option("parquet.bloom.filter.enabled#token", "true")
            writer.parquet(f"{folder}/{name}")
            return spark.read.schema(schemas.INDEX[name]).parquet(f"{folder}/{name}")

        # a token's rows meet in some files, SPREAD at most, however many it has; ranges would have to be sampled first, by a second pass
        together = lambda df: df.withColumn("part", F.pmod("doc_id", F.lit(SPREAD))).repartition("token", "part")
        postings = write("postings", together(self.postings).drop("part"))
        tf = write("tf", together(postings).groupBy("token", "part", "doc_id").agg(F.count("*").alias("tf")).drop("part"))
        write("dictionary", dictionary_of(tf))
        for f in fields(self):
            if f.name not in ("postings", "tf", "dictionary"):
                write(f.name, getattr(self, f.name))
        _point(spark, path, dump_id)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dump_id: int | None = None) -> Index:
        version = current(spark, path) if dump_id is None else dump_id
        if version is None:
            raise FileNotFoundError(f"no index in {path}")
        return cls(**{name: spark.read.schema(ddl).parquet(f"{path}/dump_id={version}/{name}") for name, ddl in schemas.INDEX.items()})


def _point(spark: SparkSession, path: str, dump_id: int) -> None:
    """Write the pointer beside the old one and rename it over that: a reader finds the old or the new one."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, place = hadoop.Path(f"{path}/.current-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/current")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(json.dumps({"dump_id": dump_id}).encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(new, place, how)


def current(spark: SparkSession, path: str) -> int | None:
    """The version that ``path`` points to, or None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.text(f"{path}/current").collect()
    return json.loads(rows[0][0])["dump_id"] if rows else None


def _stretches(index_title: bool) -> Column:
    """A document's texts with their zones, in the order of positions."""
    seg = lambda elem, text: F.struct(elem.cast("string").alias("elem"), F.coalesce(text, F.lit("")).alias("text"))
    kind = "array<struct<elem:string,text:string>>"
    parts = [
        F.transform(F.coalesce("infoboxes", F.array()), lambda b: seg(F.lower(b["itype"]), b["text"])).cast(kind),
        F.array(seg(F.lit(None), F.col("main_text"))).cast(kind),
        F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda c: seg(F.lit("Citation"), c)).cast(kind),
        F.array(seg(F.lit("Category"), F.col("categories"))).cast(kind),
    ]
    if index_title:
        parts.append(F.array(seg(F.lit("Title"), F.col("title"))).cast(kind))
    return F.concat(*parts)


def _cells(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def words(docs: DataFrame, index_title: bool = False) -> DataFrame:
    """(doc_id, toks): a row a document; a token's place in it is its position."""
    return docs.select("doc_id", _cells(F.concat_ws(" ", F.transform(_stretches(index_title), lambda x: x["text"]))).alias("toks"))


def segments(docs: DataFrame, index_title: bool = False) -> DataFrame:
    """(doc_id, ord, elem, n, start): a row a stretch of text, in the order of positions, how many tokens it has and where it starts."""
    sized = F.transform(_stretches(index_title), lambda x: F.struct(x["elem"].alias("elem"), F.size(_cells(x["text"])).alias("n")))
    # offsets are summed inside the row, once: no shuffle, and no window over a document
    none = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("s", none, lambda a, x: F.struct((a["total"] + x["n"]).alias("total"), F.concat(a["starts"], F.array(a["total"])).alias("starts")), lambda a: a["starts"])
    placed = docs.select("doc_id", sized.alias("s")).select("doc_id", F.arrays_zip("s", starts.alias("start")).alias("z"))
    return placed.select("doc_id", F.posexplode("z").alias("ord", "p")).select("doc_id", "ord", "p.s.*", "p.start")


def postings_of(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.posexplode("toks").alias("pos", "token")).select("token", "doc_id", "pos")


def extents_of(placed: DataFrame) -> DataFrame:
    """One range per zone and document, from its first to its last stretch."""
    return placed.filter(F.col("elem").isNotNull()).groupBy("elem", "doc_id").agg(F.min("start").alias("start_pos"), F.max(F.col("start") + F.col("n")).cast("int").alias("end_pos"))


def tf_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def dictionary_of(tf: DataFrame) -> DataFrame:
    """From ``tf``, so postings are counted once."""
    return tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("postings_count"))


def dictionary_of_documents(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The dictionary where no tf is there to count: a document whose id is its alone tells its tokens inside its row, and nothing shuffles but counts a token.

    Ids that repeat are counted here; their rows go by way of tf.
    """
    again = kept(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("d")))
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    ids = small(again, config.broadcast_rows)
    none = again.isEmpty()
    alone = words(docs if none else docs.join(ids, same, "left_anti"))
    each = F.explode(F.array(F.struct(F.array_distinct("toks").alias("t"), F.lit(1).alias("df"), F.lit(0).alias("n")), F.struct(F.col("toks").alias("t"), F.lit(0).alias("df"), F.lit(1).alias("n"))))
    rows = alone.select(each.alias("e")).select(F.explode("e.t").alias("token"), F.col("e.df").alias("df"), F.col("e.n").alias("n"))
    if none:
        forget(again)
    else:
        shared = tf_of(postings_of(words(docs.join(ids, same, "left_semi"))))
        rows = rows.unionAll(shared.select("token", F.lit(1).alias("df"), F.col("tf").alias("n")))
    return rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("postings_count"))


def only(ix: Index, tokens: Iterable[str]) -> Index:
    """``ix`` with what it has of ``tokens``, found by one pass over its postings. Enough for a query of these words, without wildcards."""
    rows = kept(ix.postings.filter(F.col("token").isin(*tokens)))
    tf = tf_of(rows)
    return replace(ix, postings=rows, tf=tf, dictionary=dictionary_of(tf))

def edges_of(docs: DataFrame) -> DataFrame:
    """Links of documents: ids between tabs; what is no id is dropped, repeats stay."""
    parts = docs.select(F.col("doc_id").alias("src"), F.explode(F.split(F.coalesce("links", F.lit("")), "\t")).alias("t"))
    dst = F.when(F.trim("t").rlike(r"^\+?[0-9]+$"), F.expr("try_cast(trim(t) as bigint)"))
    return parts.select("src", dst.alias("dst")).filter(F.col("dst").between(0, MOST_ID))


def timestamp_of(text: str) -> Column:
    """yyyy-M-d H:m:s, a leap second as the next one; the epoch for anything else."""
    c = F.col(text)
    leap = c.rlike(r"^\d+-\d+-\d+ \d+:\d+:60$")
    plain = F.when(leap, F.regexp_replace(c, ":60$", ":59")).otherwise(c)
    parsed = F.try_to_timestamp(plain, F.lit("yyyy-M-d H:m:s"))
    return F.coalesce(F.when(leap, parsed + F.expr("interval 1 second")).otherwise(parsed), F.timestamp_seconds(F.lit(0))).cast("timestamp_ntz")


def build(docs: DataFrame, config: EngineConfig = EngineConfig(), edges: DataFrame | None = None, index_title: bool = False, rank: bool = True) -> Index:
    """The index of ``docs`` (schema DOCUMENT, unique ids); ``edges`` replaces the links in them."""
    placed = segments(docs, index_title)
    postings = postings_of(words(docs, index_title))
    tf = tf_of(postings)
    links = edges_of(docs) if edges is None else edges
    ranks = graph.page_rank(links, config) if rank else docs.sparkSession.createDataFrame([], schemas.INDEX["page_rank"])
    table = docs.select("doc_id", "title", "abstract", timestamp_of("last_updated").alias("last_updated"))
    return Index(postings, tf, dictionary_of(tf), extents_of(placed), links, table, ranks)
