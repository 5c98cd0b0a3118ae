"""The Bloom filter has no false negatives, at the edges of its bitmaps too."""

from pyspark.sql import functions as F

from tessera.llm import bloom

ROWS = 1_000_000


def test_every_inserted_hash_is_present(spark):
    hashes = spark.range(ROWS).select(F.xxhash64("id").alias("h"))
    blocks = bloom.n_blocks(ROWS)
    once, twice = bloom.bits_of(hashes, "h", blocks), bloom.repeated_bits(hashes.unionAll(hashes), "h", blocks)
    for bitmaps in (once, twice):
        assert bloom.test_rows(hashes, bitmaps, "h", blocks).filter("not maybe").count() == 0


def test_few_other_hashes_are_present(spark):
    blocks = bloom.n_blocks(ROWS)
    bitmaps = bloom.bits_of(spark.range(ROWS).select(F.xxhash64("id").alias("h")), "h", blocks)
    others = spark.range(ROWS, 2 * ROWS).select(F.xxhash64("id").alias("h"))
    assert bloom.test_rows(others, bitmaps, "h", blocks).filter("maybe").count() < ROWS / 20
