"""What the language model shuffled leaves the disk when its tables are written, without waiting for a collection of garbage."""

import random
import time
from pathlib import Path

from tessera.llm import lm
from tests.llm.test_lm_buckets import written


def on_disk(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*") if f.exists())


def test_shuffles_leave_the_disk(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 4000)}" for _ in range(300)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    monkeypatch.setattr(lm, "release", lambda _: None, raising=False)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, there, sent = spark.conf.get(key), on_disk(spark), written(spark)
    out = lm.score(docs, chunk_bytes=50_000)
    sent = written(spark) - sent
    assert sent > 500_000
    for _ in range(20):  # files are removed by another thread
        if on_disk(spark) - there < 0.2 * sent:
            break
        time.sleep(0.5)
    assert on_disk(spark) - there < 0.2 * sent
    assert spark.conf.get(key) == had
    assert out.count() == 200
