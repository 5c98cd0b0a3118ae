"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

At each level every child draws ln(u) / weight from a hash of (key, child), and the largest draw
wins; a child's weight is the sum of its shards'. If the weight of a subtree changes, its own draw
alone changes, so rows move only into that subtree if it grew and only out of it if it shrank. A
shard that is added gets a region of its own: no other draw changes, hence it takes rows only into
itself.

The text sizes balance only as the hash makes them (law ``key``). DataFrame functions only.

Cases: a null id is a key of its own; rows with equal ids share a shard; a null text has size 1 and
the checksum of the empty text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, lookup_join, parts, whole

#: region: rack: shard: weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def tree(n_shards: int, base: int = 16, per_rack: int = 4, per_region: int = 8) -> Tree:
    """Shards 0 to ``base`` - 1 in full racks and regions; each later one in a region of its own."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n_shards):
        region = f"r{s // per_region}" if s < base else f"grown{s}"
        rack = f"{region}/{s // per_rack}" if s < base else f"{region}/0"
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def _draw(key: Column, child: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11)
    return F.log((bits + 0.5) / float(2**53)) / F.lit(weight)


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child that draws highest; nested values are only computed for the winner."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in children]
    top = F.greatest(*draws)
    out = children[-1][2]
    for draw, (_, _, value) in reversed(list(zip(draws[:-1], children[:-1], strict=True))):
        out = F.when(draw == top, value).otherwise(out)
    return out


def shard_of(key: Column, of: Tree) -> Column:
    """The shard of ``key``: a descent through regions, racks and shards."""
    weigh = lambda shards: float(sum(shards.values()))
    regions = []
    for region, racks in of.items():
        inner = [(rack, weigh(shards), _pick(key, [(f"{rack}#{s}", w, F.lit(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inner), _pick(key, inner)))
    return _pick(key, regions)


def with_slots(rows: DataFrame, shard_col: str, order: list[str], spread: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard: ranks in small buckets, offset by the buckets before them."""
    b = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(spread)).cast("int"))
    counts = b.groupBy(shard_col, "__bucket").count()
    before = counts.select(F.col(shard_col), "__bucket", (F.sum("count").over(W.partitionBy(shard_col).orderBy("__bucket")) - F.col("count")).alias("__before"))
    rank = F.row_number().over(W.partitionBy(shard_col, "__bucket").orderBy(*order)) - 1
    ranked = b.withColumn("__rank", rank)
    joined = lookup_join(ranked, before, [shard_col, "__bucket"])
    return joined.withColumn("slot", (F.col("__before") + F.col("__rank")).cast("long")).drop("__bucket", "__before", "__rank")


def assign(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot and grown_shard."""
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("id").cast("string"), F.lit("\0"))
    rows = cut(rows.withColumn("shard", shard_of(key, tree(n_shards))).withColumn("grown_shard", shard_of(key, tree(n_shards + 1))))
    out = with_slots(rows, "shard", ["id", "text_crc32", "size"], spread=4 * parts(docs.sparkSession))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
