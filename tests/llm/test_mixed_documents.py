"""The mix in whole documents holds its targets: no source strays by more than half a document."""

import collections
import random

import pytest

from tessera.llm import mixing
from tests.llm.test_operators import water


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taken_words_meet_the_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "b", "c", "d", None])) for k in range(2000)]
    rows += [(5000, "w " * 9000, "b"), (5001, "w " * 7000, "e"), (5002, "", "a"), (5003, None, "a"), (5004, " ", "f"), (None, "w w w", "c"), (None, "w w", None)]
    size = [len((t or "").split()) for _, t, _ in rows]
    sizes, largest = collections.Counter(), collections.Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
        largest[s] = max(largest[s], n)
    target = water(sizes)
    times, taken = collections.Counter(), collections.Counter()
    for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed).collect():
        times[r["doc_id"], r["source"]] += 1
        taken[r["source"]] += len(r["text"].split())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    for (d, _, s), n in zip(rows, size, strict=True):
        whole = int(target[s] / sizes[s] + 1e-9) if sizes[s] else 0
        assert times[d, s] in ((whole, whole + 1) if n else (0,))
