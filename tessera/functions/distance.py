"""String functions of the spelling suggestion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positional_distance(a: Column, b: str) -> Column:
    """How many places two words differ in, a missing letter being one."""
    pairs = F.zip_with(F.split(a, ""), F.array(*[F.lit(c) for c in b]), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
