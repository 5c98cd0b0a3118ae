"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only their rows shuffle.

Pass one sets the bits of every row's hash in a blocked Bloom filter and keeps the bits that were
set twice or more. Pass two tests each row against them: a row with a bit that was set once is
alone and passes straight through; the others, all repeated rows and a few per cent of the rest,
are grouped by the SHA-256 of their normalised text. False positives cost a shuffle, never a
result. DataFrame functions only.

The filter holds ``bits_per_row`` bits a row and at most ``max_bits``: what is broadcast is at most
``max_bits / 8`` bytes (32 MB), whatever the input. Beyond that, more rows shuffle.

Cases: a null text is the empty text; a null id sorts after all others when the smallest is
chosen; of rows with equal ids and texts each has its own output row with the same ``keep_id``
(``kept`` is then true for each of them); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import n_blocks, repeated_bits, test_rows
from tessera.llm.common import cut, squeezed, whole

def keys_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_chars (code points), sha (of the normalised text) and h, computed once."""
    text = whole(text_col)
    return cut(docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(squeezed(text), 256)).alias("sha")).withColumn("h", F.xxhash64("sha")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 2**28, hot_share: float = 0.001) -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are so without their white space. The row with the most code points,
    then the smallest id, stays.
    """
    rows = keys_of(docs, id_col, text_col)
    n = rows.count()
    blocks = n_blocks(n, bits_per_row, max_bits)
    tested = test_rows(rows, repeated_bits(rows, "h", blocks), "h", blocks)
    alone = tested.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = tested.filter("maybe").select("id", "n_chars", "sha")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), "id"))
    groups = cut(maybe.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")).select(F.col("sha").alias("gsha"), F.col("best.id").alias("keep_id"), "group_size"))
    # A group above hot_share of all rows is resolved without moving its rows: there are at most 1 / hot_share such groups.
    hot = groups.filter(F.col("group_size") > hot_share * n).select(F.col("gsha").alias("hsha"), F.col("keep_id").alias("hkeep"), F.col("group_size").alias("hsize"))
    marked = maybe.join(F.broadcast(hot), F.col("sha") == F.col("hsha"), "left")
    of_hot = marked.filter(F.col("hsha").isNotNull()).select("id", F.col("hkeep").alias("keep_id"), F.col("hsize").alias("group_size"), "sha")
    of_rest = marked.filter(F.col("hsha").isNull()).select("id", "sha").join(groups, F.col("sha") == F.col("gsha")).select("id", "keep_id", "group_size", "sha")
    out = alone.unionByName(of_hot).unionByName(of_rest)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 2**28) -> DataFrame:
    """``docs`` with one whole row of each group of equal texts, its columns unchanged.

    Unlike ``exact_dedup``, one row stays even where rows repeat with one id. Only possibly
    repeated rows shuffle, and each task first reduces its own groups.
    """
    text = whole(text_col)
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(squeezed(text), 256)).alias("sha"))
    narrow = keys_of(docs, id_col, text_col)
    blocks = n_blocks(narrow.count(), bits_per_row, max_bits)
    tested = test_rows(rows.withColumn("h", F.xxhash64("sha")), repeated_bits(narrow, "h", blocks), "h", blocks)
    better = F.struct((-F.length(whole(F.col(f"row.{text_col}")))).alias("n"), F.col(f"row.{id_col}").isNull().alias("no_id"), F.col(f"row.{id_col}").alias("id"))
    kept = tested.filter("maybe").groupBy("sha").agg(F.min_by("row", better).alias("row"))
    return tested.filter(~F.col("maybe")).select("row.*").unionByName(kept.select("row.*"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha AS text_sha256 FROM g
"""
