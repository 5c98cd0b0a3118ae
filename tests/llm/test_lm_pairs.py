"""The language model counts all pairs of words, those of rare words too."""

import collections
import math
import random
import zlib

import pytest

from tessera.llm import lm
from tests.llm.test_operators import spelling


def test_pairs_of_rare_words(spark):
    rng = random.Random(4)
    often, rare = [f"a{k}" for k in range(5)], [f"r{k}" for k in range(30)]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    texts += ["only1 only2 a1 only1 only2", texts[3], "never1 never2"]
    ids = [*range(60), 61, 9_000, 62]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    tokens = [[w.encode() for w in t.split()] + [b""] for t in texts]
    train = [t for d, t in zip(ids, tokens, strict=True) if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    pairs = collections.Counter(x for t in train for x in zip([b"", *t], t, strict=False))
    kinds = collections.Counter(a for a, _ in pairs)
    spell = spelling(c)[1]
    spells = {w: spell(w) for t in tokens for w in t}

    def p(before, w):
        root = max(c[w] - d, 0) / n + d * v / n * spells[w]
        if not c[before]:
            return root
        return max(pairs[before, w] - lm.DISCOUNT, 0) / c[before] + lm.DISCOUNT * kinds[before] / c[before] * root

    assert sum(max(k - lm.DISCOUNT, 0) for (a, _), k in pairs.items() if a == b"r1") / c[b"r1"] + lm.DISCOUNT * kinds[b"r1"] / c[b"r1"] == pytest.approx(1)
    out = {r["doc_id"]: r["score"] for r in lm.score(docs, chunk_bytes=200).collect()}
    for i, t in zip(ids, tokens, strict=True):
        assert out[i] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([b"", *t], t, strict=False)))
