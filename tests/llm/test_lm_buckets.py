"""Pairs of words in several buckets, with hot first words split among them, and what they shuffle."""

import random
import time

import pytest

from tessera.llm import lm


def written(spark) -> int:
    time.sleep(1)  # for the listener
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_buckets(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randint(0, 4000)}"]) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).localCheckpoint()
    before = written(spark)
    one = {r["doc_id"]: r for r in lm.score(docs, chunk_bytes=50_000).collect()}
    tokens = sum(r["n_tokens"] for r in one.values())
    assert (written(spark) - before) / tokens < 19
    monkeypatch.setattr(lm, "TOKENS", tokens // 7)
    several = {r["doc_id"]: r for r in lm.score(docs, chunk_bytes=50_000).collect()}
    assert several.keys() == one.keys()
    assert all(several[d]["score"] == pytest.approx(one[d]["score"]) for d in one)
