"""A task that reads many chunks holds few of them at once, in the JVM and in Python."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.llm import lm, tables


def test_chunks_come_in_small_batches(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    expected = sorted(lm.score(docs, chunk_bytes=20_000).collect())
    monkeypatch.setattr(lm, "TOGETHER", 50_000, raising=False)
    batches, groups = [], []
    real = lm.swept

    def swept(df, *limits):
        """Write what counts the rows that Python gets at once, the way the pairs are written."""
        if "blob" in df.columns and "chunk" in df.columns and not batches:
            path = next(p for _, p in tables._WRITTEN[::-1] if "chunk" in spark.read.parquet(p).columns)
            for f in Path(path.removeprefix("file:")).glob("*.parquet"):
                meta = pq.ParquetFile(f).metadata
                groups.extend(meta.row_group(k).num_rows for k in range(meta.num_row_groups))
            count = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it)
            seen = real(spark.read.parquet(path).mapInArrow(count, "n long"), *limits)
            batches.extend(r["n"] for r in seen.collect())
        return real(df, *limits)

    monkeypatch.setattr(lm, "swept", swept)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    found = sorted(lm.score(docs, chunk_bytes=20_000).collect())
    assert sum(groups) == sum(batches) > 30
    assert max(groups) <= 6 and max(batches) <= 6
    assert spark.conf.get(key) == had
    assert found == expected
    assert lm.score(docs.limit(0)).agg(F.count("*")).first()[0] == 0
