"""Intermediate tables in the folder that the cluster shares: written once, removed when they aren't needed any more."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import ensure_checkpoint_dir

#: Spark removes a query's shuffle files when it ends. Without this they stay until their plan is collected as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many bytes of rows Spark hands to Python at once, 64 MB by default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def with_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    had = {k: spark.conf.get(k) if k == BATCH else spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, together: int = 0) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back: computed once, kept when executors are lost, read by column.

    ``together``: of rows that are large, so many bytes are a row group, which is what a task holds when it writes and reads.
    Removed by ``discard``, or when the process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    writer = df.write.option("compression", "zstd")
    if together:
        writer = writer.option("parquet.block.size", together).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = (spark, path)
    return out


def swept(df: DataFrame, batch: int = 0) -> DataFrame:
    """``stored``, and the shuffle files behind it are removed as soon as it is written. Python gets ``batch`` bytes of rows at once."""
    with with_settings(df.sparkSession, **{CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})):
        return stored(df)


def _drop(written: tuple[SparkSession, str]) -> None:
    if written in _WRITTEN:
        _WRITTEN.remove(written)
        try:
            remove(*written)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        _drop(t._stored)


@atexit.register
def _clean() -> None:
    for written in list(_WRITTEN):
        _drop(written)
