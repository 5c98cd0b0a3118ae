"""Mixing sources to target weights, in blocks of words, by pseudorandom index permutations.

1. A source's words are packed into blocks of ``block_words``; word offsets come from sums over
   buckets of documents, so no task sees a whole source.
2. Targets: sources share the total by weight; a target stops at ``max_epochs`` times its source's
   size and the excess is reshared by weight until none is above.
3. Each output shard draws its count of a source multinomially: the slots of a source, whose number
   its target fixes, choose shards at random. Hence the counts of a shard vary as a multinomial
   does, and no source's sum strays from its target.
4. Slot k of a source maps to a block by a permutation of the block indices that is keyed by source
   and epoch (swap-or-not: 16 rounds, each a bijection of [0, n) for any n); a block is thus taken
   once an epoch, and no document exceeds ``max_epochs`` times its size.
5. Blocks are joined to the documents by (source, block), and bring the shards they go to.

``mixed_documents`` takes whole documents by the same slots: a document lies in a block, the
permutation read backwards tells its slot, and the slots that the target pays for take it.

DataFrame functions only. Hot sources are spread by block index.

Cases: a null source is the last source; null or empty texts have no words and are never taken; a
source without words has target 0; rows that repeat each lay down their own words; an empty table
gives an empty result; other columns are not read by ``mix`` and pass through ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import count_words, cut, lookup_join, whole

WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) with no, weight and target; the sources are numbered by code point, null last.

    Sorted by cap / weight, the capped sources are a prefix: a source is capped if an equal share of
    what the earlier ones leave is at least its cap. The windows run over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("no", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("no"))
    whole_table = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole_table).cast("double"))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / left)
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole_table)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole_table), F.lit(0.0))
    s = s.withColumn("share", (F.col("total") - used) / free)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("share") * F.col("weight"))
    return s.select("source", "source_size", "no", "weight", target.alias("target"))


def permuted(k: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """The place of index ``k`` in a keyed pseudorandom permutation of 0 to ``n`` - 1; ``back``: the index at place ``k``, as each round undoes itself."""

    def swap(x: Column, r: Column) -> Column:
        y = F.pmod(F.xxhash64(*key, r) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, k.cast("long"), swap)


def shard_of(no: Column, slot: Column, shards: Column, seed: int) -> Column:
    """The shard that a slot chooses."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), no, slot), shards)


def laid_out(sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """``sources`` with words, with their blocks ``n``, their ``slots`` and the number of ``shards``."""
    s = sources.filter("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block_words).cast("long"))
    s = s.withColumn("slots", F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long")).filter("slots > 0")
    return s.withColumn("shards", F.ceil(F.sum("slots").over(W.partitionBy()) / shard_slots).cast("long"))


def offsets(rows: DataFrame, spread: int) -> DataFrame:
    """``rows`` (id, source, size) with ``start``, the words of the source that lie before the document."""
    b = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(spread)).cast("int"))
    sums = b.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select("source", "bucket", (F.sum("sum").over(W.partitionBy("source").orderBy("bucket")) - F.col("sum")).alias("before"))
    inner = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    ranked = b.withColumn("inner", inner)
    return lookup_join(ranked, before, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("inner")).drop("bucket", "before", "inner")


def plan(sources: DataFrame, block_words: int, shard_slots: int = 4096, seed: int = 7, chunk: int = 4096, task_slots: int = 32_768) -> DataFrame:
    """The mix as slots: (no, k, block, shard). ``sources`` has no, source_size and target; a task has about ``task_slots`` slots."""
    s = cut(laid_out(sources, block_words, shard_slots))
    tasks = 1 + int(s.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]) // task_slots
    chunks = s.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long")))).repartition(tasks, "no", "from")
    k = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + chunk, F.col("slots")) - 1)).alias("k")
    slots = chunks.select("no", "n", "shards", k)
    epoch = F.floor(F.col("k") / F.col("n")).cast("long")
    return slots.select(
        "no", "k",
        permuted(F.pmod("k", "n"), F.col("n"), F.lit(seed), F.col("no"), epoch).alias("block"),
        shard_of(F.col("no"), F.col("k"), F.col("shards"), seed).alias("shard"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: id, size, source, source_size, target and taken, in words, and first_shard, the least of the shards that its words go to."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(whole(text_col)).alias("size")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    placed = lookup_join(offsets(rows, spread=1 + rows.count() // bucket_rows), sources, ["source"])
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    pieces = placed.filter("size > 0").select("id", "source", "size", "start", "no", "source_size", "target", F.explode(blocks).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    counts = plan(sources, block_words, seed=seed).groupBy("no", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # the planner takes what a sequence is exploded to for as small as the sequence: it may not choose a broadcast
    joined = pieces.join(counts.hint("merge"), ["no", "block"], "left")
    taken = F.sum(overlap * F.coalesce(F.col("times"), F.lit(0)))
    keys = ["no", "start", "id", "source", "size", "source_size", "target"]
    some = joined.groupBy(*keys).agg(taken.cast("long").alias("taken"), F.min("shard").alias("first_shard"))
    none = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    return some.select("id", "source", "size", "source_size", "target", "taken", "first_shard").unionByName(none.select("id", "source", "size", "source_size", "target", "taken", "first_shard")).withColumnRenamed("id", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, block_words: int = 64, shard_slots: int = 4096, shard_col: str | None = None) -> DataFrame:
    """The mix in whole documents: each row of ``docs`` 0 to ``max_epochs`` times, its columns unchanged, and its shard if ``shard_col`` names it.

    A document lies in the block of its source that a hash of its id and text names; the permutation
    read backwards gives its slot. Documents are taken in the order of their slots, as far as the
    target's words go: whole epochs take all of them, and of the part of an epoch that is left,
    those whose middle word lies before its end. So the words taken differ from the target by half
    of the document at that end at most. A copy goes to the shard that its slot in that epoch chose.
    Rows that repeat id and text lie at one place.
    """
    text = whole(F.col(f"row.{text_col}"))
    rows = docs.select(F.struct("*").alias("row")).withColumns({"source": F.col(f"row.{source_col}"), "size": count_words(text)})
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col(f"row.{id_col}"), text))
    narrow = cut(rows.select("source", "size", "h"))
    sources = cut(laid_out(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), block_words, shard_slots))
    ends = _ends(_placed(lookup_join(narrow.filter("size > 0"), sources, ["source"]), seed), sources)
    named = lookup_join(sources.select("source", "no", "n", "shards"), ends, ["source"])
    placed = _placed(lookup_join(rows.filter("size > 0"), cut(named), ["source"]), seed)
    times = (F.col("epochs") + (F.col("place") <= F.col("last")).cast("int")).cast("int")
    copies = placed.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    if shard_col is None:
        return copies.select("row.*")
    return copies.select("row.*", shard_of(F.col("no"), F.col("slot") + F.col("copy") * F.col("n"), F.col("shards"), seed).alias(shard_col))


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (h, no, n) with their slot in an epoch and their place: a number below 2^63 in the order of the slots, then of the hash."""
    slot = permuted(F.pmod("h", "n"), F.col("n"), F.lit(seed), F.col("no"), F.lit(0).cast("long"), back=True)
    place = F.shiftleft(F.col("slot") * F.floor(F.lit(2**43) / F.col("n")), 20).bitwiseOR(F.shiftrightunsigned("h", 44))
    return rows.withColumn("slot", slot).withColumn("place", place.cast("long"))


def _ends(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, epochs, last): the whole epochs, and the last place that the part of an epoch takes, from rows (source, size, place)."""
    narrow = cut(placed.select("source", "size", "place"))
    bucket = F.shiftright("place", 51).alias("bucket")  # 4096, in the order of the places
    sums = cut(narrow.groupBy("source", bucket).agg(F.sum("size").alias("sum")))
    epochs = F.floor(F.col("target") / F.col("source_size"))
    sources = cut(sources.select("source", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("part")))
    laid = sums.withColumn("before", F.sum("sum").over(W.partitionBy("source").orderBy("bucket")) - F.col("sum"))
    edge = cut(lookup_join(laid, sources, ["source"]).filter("before <= part and part < before + sum").select("source", "bucket", "before", "part"))
    # only the bucket in which the part ends is laid out by place
    inner = lookup_join(narrow.withColumn("bucket", bucket), edge, ["source", "bucket"]).groupBy("source", "before", "part", "place").agg(F.sum("size").alias("size"))
    start = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("place")) - F.col("size")
    inside = inner.withColumn("start", start).filter(F.col("start") + F.col("size") / 2 <= F.col("part")).groupBy("source").agg(F.max("place").alias("inside"))
    # if it takes none of that bucket, its end is the last place before it
    below = edge.select("source", (F.shiftleft("bucket", 51) - 1).alias("below"))
    found = lookup_join(lookup_join(sources, below, ["source"], how="left"), inside, ["source"], how="left")
    return found.select("source", "epochs", F.coalesce("inside", "below", F.lit(-1).cast("long")).alias("last"))
