"""Blocked Bloom filters from Spark's bitmap functions.

A filter is a table of bitmaps of 4 KB; both bits of a hash lie in one of them. It holds
``bits_per_row`` bits a row and at most ``max_bits``, so that what is broadcast is at most
``max_bits / 8`` bytes (32 MB), whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32768  # bits of one bitmap


def _bits(h: Column, blocks: int) -> list[Column]:
    """The two bits of a hash, both in one block; numbered from 1, as bitmap_bucket_number puts 1 to BLOCK in one bucket."""
    block = F.pmod(h, F.lit(blocks)) * BLOCK
    at = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BLOCK - 1))
    return [block + at(47) + 1, block + at(31) + 1]


def _has(bitmap: Column, bit: Column) -> Column:
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def n_blocks(n_rows: int, bits_per_row: int = 16, max_bits: int = 2**28) -> int:
    return max(1, min(n_rows * bits_per_row, max_bits) // BLOCK)


def _bitmaps(bits: DataFrame) -> DataFrame:
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _each_bit(hashes: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    return hashes.select(F.explode(F.array_distinct(F.array(*_bits(F.col(hash_col), blocks)))).alias("bit"))


def bits_of(hashes: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    """Bitmaps of all hashes."""
    return _bitmaps(_each_bit(hashes, hash_col, blocks))


def repeated_bits(hashes: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    """Bitmaps of the bits that two rows or more set."""
    return _bitmaps(_each_bit(hashes, hash_col, blocks).groupBy("bit").count().filter("count > 1"))


def test_rows(rows: DataFrame, bitmaps: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    """``rows`` with the boolean ``maybe``: whether both bits of the hash are set."""
    bits = _bits(F.col(hash_col), blocks)
    hit = _has(F.col("bitmap"), bits[0]) & _has(F.col("bitmap"), bits[1])
    probe = rows.withColumn("block", F.bitmap_bucket_number(bits[0]))
    # at most max_bits / BLOCK rows of 4 KB
    return probe.join(F.broadcast(bitmaps), "block", "left").withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "bitmap")
