"""Refresh from a stream: each batch of arriving article rows that carries a new version triggers a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.api import update_index
from tessera.config import EngineConfig
from tessera.sources import articles, schemas


def refresh_on_arrival(spark: SparkSession, source: str, index_path: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Watch the folder ``source``/article; rebuild from all tables when a batch arrives with a larger dump id. Stops when all that is there was seen."""

    def rebuild(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            update_index(batch.sparkSession, articles.read_parquet(batch.sparkSession, source), index_path, config)

    arriving = spark.readStream.schema(schemas.ARTICLE).parquet(f"{source}/article").select("dumpid")
    return arriving.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
