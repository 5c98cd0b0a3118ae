"""Expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the session names in spark.checkpoint.dir; only where none is named, and on one machine, as in tests, make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that it is computed once and outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what was written with ``cut``: it does so when the plans behind them are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give back to the system what a Python worker has freed: Spark hands workers on from stage to stage, with what earlier ones left."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """``text`` without its white space; replace() beats a regular expression, as most of these characters are rare."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def split_words(text: Column) -> Column:
    """Words of ``text``, which isn't null; the first and the last may be empty."""
    return F.split(text, SPACE_CLASS + "+")


def count_words(text: Column) -> Column:
    """How many words ``text``, which isn't null, has. An empty piece stands before leading and after trailing space."""
    edge = lambda n: F.substring(text, n, 1).isin(*SPACES).cast("int")
    n = F.size(split_words(text)) - edge(1) - edge(-1)
    return F.when(text == "", F.lit(0)).otherwise(n).cast("long")


def same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Null-safe equality of all ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], max_rows: int = 50_000, hot_share: float = 0.001, how: str = "inner") -> DataFrame:
    """Join ``left`` to the unique ``keys`` of ``right``, null-safe, and keep ``left``'s key columns.

    ``right`` is broadcast only if it has at most ``max_rows`` rows, counted here. Beyond that the
    keys that more than ``hot_share`` of ``left``'s rows have, counted here and at most 1 / hot_share,
    are joined by a broadcast of their rows; all others by a shuffle.
    """
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    equal = lambda other: reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{other}{k}")), keys, F.lit(True))
    drop = [f"__r_{k}" for k in keys]
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(renamed), equal("__r_"), how).drop(*drop)
    n = left.count()
    hot = cut(left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_share * n).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))
    same = reduce(lambda a, k: a & F.col(f"__r_{k}").eqNullSafe(F.col(f"__h_{k}")), keys, F.lit(True))
    few = renamed.join(F.broadcast(hot), same, "left_semi")
    marked = left.join(F.broadcast(hot), equal("__h_"), "left").drop(*[f"__h_{k}" for k in keys])
    of_hot = marked.filter(F.col("__hot")).join(F.broadcast(few), equal("__r_"), how)
    of_rest = marked.filter(F.col("__hot").isNull()).join(renamed.hint("merge"), equal("__r_"), how)
    return of_hot.unionByName(of_rest).drop("__hot", *drop)


def lowered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``texts`` (strings without nulls), A-Z lowered, in a row, and where each text's begin, and the last one's end."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # a slice of its own memory: Arrow lowers others wrongly after a cast
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole.cast(pa.large_string())))
    flat = split.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return flat.filter(there), before[split.offsets.to_numpy() - split.offsets[0].as_py()]
