"""Helpers of the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where none is named, and on one machine, one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_KEPT: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once into Parquet in the shared folder: for what is read more than once. Removed by ``forget``, or when the process ends."""
    spark = df.sparkSession
    path = scratch(spark, "kept")
    df.write.parquet(path)
    _KEPT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = (spark, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more."""
    for t in tables:
        _KEPT.remove(t._kept)
        discard(*t._kept)


@atexit.register
def _forget_all() -> None:
    while _KEPT:
        try:
            discard(*_KEPT.pop())
        except Exception:  # the session is gone; its folder is the cluster's to clean
            continue


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; beyond that the planner joins by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
