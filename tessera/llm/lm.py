"""LM scoring by a weighted backoff automaton.

The model spells its vocabulary: n-grams of words stand on n-grams of bytes. Its states are

- a state for each word that was learned. Its arcs carry the weight of all words that followed it,
  (c(h, w) - d) / c(h); its failure arc leads to the root with the mass that is left. A ``share``
  above 0 gives a smaller model: states and arcs of words that make up so much of the tokens;
- the root, with an arc for each word that was learned, (c - d) / N. Its failure arc carries the
  mass that the discount freed, d * V / N, to the spelling of the word;
- contexts of two, one and no bytes, which spell a word to its end by smoothed 3-, 2- and 1-grams of
  bytes, counted once a learned word, each failing to the next shorter context.

An arc's weight includes what its failure path adds (interpolation), so the weights of a state add
up to one over all words there are. A word that was never seen costs what its spelling costs. One
left-to-right traversal carries the state and adds up log10 of the weights; a text starts in the
state of the end token, whose spelling is empty.

1. Documents are read once, ``chunk_bytes`` together: a chunk is a row with its distinct words, their
   training counts in it, and its documents as lists of chunk-local word numbers.
2. Counts are summed by word over all chunks; N, V and the discount come of them.
3. Pairs are counted by chunk, then over all chunks in buckets of some ``TOKENS`` tokens, by the first word, or by
   both words where the first is hot. A chunk sends a bucket one row: sorted 64-bit hashes of first words, those
   of the words that followed each, as differences, and counts; inside a bucket a pair is told by 64 bits of both.
   How many kinds of words followed a word is counted there too. Bytes are counted over all learned words and
   broadcast, at most 2^24 cells; with ``share``, pairs of frequent words as well.
4. Counts of words that more than one chunk has go back to the chunks, and a row a bucket with what the other chunks
   add to the chunk's counts of pairs, in the order they were sent in. There documents are traversed.

A hot word costs one row a chunk, whatever its count, and no task holds more than some chunks of
documents, or one document, however many chunks it reads: the table of chunks has small row groups, and
Python gets it in small batches. Nothing is sampled, and no word is left out.

Cases: a null text is the empty text, whose only token is the end; a null id is not held out but
not learned from; if nothing is learned, c and N are 0 and words are spelled by bytes that are all
alike; rows that repeat are scored alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lowered_words, trim, whole
from tessera.llm.langid import remainder
from tessera.llm.tables import discard, stored, swept

DISCOUNT = 0.75  # of n-grams of bytes and of pairs of words
#: The end token; words are bytes and never empty. Its chunk-local number is 0.
END = b""
BOUND = 32  # the byte around a word; no word has it
TOKENS = 2 << 20  # a bucket of pairs
TOGETHER = 8 << 20  # bytes of chunks that a task holds at once; a chunk that is larger is alone
U = np.uint64


def learns(id_col: str) -> F.Column:
    """Whether a document is learned from."""
    return F.coalesce(remainder(id_col, 7) != 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, the end first; each text's words by number, the end last, in a row; and their counts."""
    flat, ends = lowered_words(texts)
    coded = flat.dictionary_encode()
    sizes = np.diff(ends) + 1
    out = np.zeros(len(coded) + len(texts), np.uint32)
    spelled = np.ones(len(out), bool)
    spelled[np.cumsum(sizes) - 1] = False
    out[spelled] = coded.indices.to_numpy() + 1
    words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.large_binary()).cast(pa.binary())])
    return words, out, sizes


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, words, counts, ids, held, learn, sizes, tokens): a row a chunk; tokens are compressed chunk-local numbers."""
    rows = docs.select(F.col(id_col), F.coalesce(remainder(id_col, 7) == 2, F.lit(False)).alias("__held"), learns(id_col).alias("__learn"), whole(text_col).alias("__text"))
    lists = {"words": T.BinaryType(), "counts": T.LongType(), "ids": docs.schema[id_col].dataType, "held": T.BooleanType(), "learn": T.BooleanType(), "sizes": T.LongType()}
    schema = T.StructType([T.StructField("chunk", T.LongType()), *[T.StructField(k, T.ArrayType(t)) for k, t in lists.items()], T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            ids, held, learn, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
            words, tokens, sizes = words_of(texts)
            of = np.repeat(learn.to_numpy(zero_copy_only=False).astype(bool), sizes)
            counts = np.bincount(tokens[of], minlength=len(words))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            blob = pa.compress(tokens.tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([base + made]), *map(one, (words, pa.array(counts), ids, held, learn, pa.array(sizes))), pa.array([blob], pa.binary())], names=schema.names)

        for batch in batches:
            lengths = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
            start = 0
            for k in range(batch.num_rows):
                size += int(lengths[k])
                if size >= chunk_bytes:
                    waiting.append(batch.slice(start, k + 1 - start))
                    yield close()
                    made, waiting, size, start = made + 1, [], 0, k + 1
            if start < batch.num_rows:
                waiting.append(batch.slice(start))
        if waiting:
            yield close()
        trim()

    return rows.mapInArrow(run, schema)


def unpacked(tokens: bytes, sizes: np.ndarray) -> np.ndarray:
    return np.frombuffer(pa.decompress(tokens, int(sizes.sum()) * 4, codec="zstd", asbytes=True), np.uint32)


def pair_counts(table: DataFrame, rank: dict[bytes, int]) -> np.ndarray:
    """How often each frequent word followed each, over all training documents; a text's first word follows the end."""
    k = len(rank)
    ranks = table.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(k * k, np.int64)
        rank = ranks.value
        for batch in batches:
            for words, learn, sizes, tokens in zip(*(batch.column(c) for c in range(4)), strict=True):
                of = np.array([rank.get(w, k) for w in words.values.to_pylist()], np.int64)
                n = np.asarray(sizes.values)
                t = of[unpacked(tokens.as_py(), n)]
                before = np.concatenate([[rank.get(END, k)], t[:-1]])  # before a text's first word lies the end of another, or none
                known = np.repeat(np.array(learn.values.to_pylist(), bool), n) & (t < k) & (before < k)
                pairs += np.bincount(before[known] * k + t[known], minlength=k * k)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["pair", "n"])

    out = np.zeros(k * k, np.int64)
    if k:
        found = table.select("words", "learn", "sizes", "tokens").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        out[[r["pair"] for r in found]] = [r["n"] for r in found]
    return out.reshape(k, k)


def local_pairs(words: int, learn: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs as before * ``words`` + word, how often each was learned in it, and each token's pair by number."""
    before = np.concatenate([np.zeros(1, np.int64), tokens[:-1].astype(np.int64)])[: len(tokens)]
    before[np.cumsum(sizes) - sizes] = 0
    codes, of = np.unique(before * words + tokens, return_inverse=True)
    return codes, np.bincount(of[np.repeat(learn, sizes)], minlength=len(codes)), of


def packed(*arrays: np.ndarray) -> bytes:
    """64-bit numbers, by planes of bytes and compressed, behind how many each array has."""
    planes = b"".join(np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], U).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def opened(blob: bytes, arrays: int) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 8 * arrays], U).astype(np.int64)
    flat = np.frombuffer(pa.decompress(blob[8 * arrays :], int(sizes.sum()) * 8, codec="zstd", asbytes=True), np.uint8)
    ends = 8 * np.cumsum(sizes)
    return [np.ascontiguousarray(flat[e - 8 * n : e].reshape(8, n).T).view(U).ravel() for n, e in zip(sizes, ends, strict=True)]


def hashed(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()], U)  # as Spark's xxhash64


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes."""
    x = h * U(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def placed(hashes: np.ndarray, codes: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The order of a chunk's pairs by bucket and hashes, and their buckets and hashes in it. Pairs are where their first word is; those of hot words are everywhere."""
    before = codes // len(hashes)
    h, w = hashes[before], hashes[codes % len(hashes)]
    of = np.where(np.isin(hashes, hot)[before], mixed(h, w), h) % U(buckets)
    order = np.lexsort((w, h, of))
    return order, of[order].astype(np.int64), h[order], w[order]


def bounds(of: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), [len(of)]])


def all_pairs(table: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(chunk, at, k, blob): for each chunk and bucket ``at`` how much more often its pairs, as ``placed``, were learned in all chunks than in it;
    and, without a chunk, how many kinds of words ``k`` followed the word whose hash is ``at``, summands of it if it is hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, learn, sizes, tokens in zip(*(batch.column(c) for c in range(5)), strict=True):
                hashes, n = hashed(words.values), np.asarray(sizes.values)
                codes, counts, _ = local_pairs(len(hashes), learn.values.to_numpy(zero_copy_only=False).astype(bool), unpacked(tokens.as_py(), n), n)
                order, of, h, w = placed(hashes, codes, hot, buckets)
                counts = counts[order]
                ends = bounds(of)
                blobs = []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    starts = bounds(h[a:b])
                    step = np.diff(w[a:b], prepend=U(0))
                    step[starts[:-1]] = w[a:b][starts[:-1]]
                    blobs.append(packed(np.diff(h[a:b][starts[:-1]], prepend=U(0)), np.diff(starts), step, counts[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(of[ends[:-1]]), pa.array(np.full(len(blobs), chunk.as_py())), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])
                del codes, counts, order, of, h, w, blobs
            trim()

    def add(part: pa.Table) -> pa.Table:
        trim()
        each = [opened(x.as_py(), 4) for x in part.column("blob")]
        there = np.concatenate([np.cumsum(x[0], dtype=U) for x in each])  # the first words of each chunk
        sizes = np.concatenate([x[1] for x in each]).astype(np.int64)
        step, n = np.concatenate([x[2] for x in each]), np.concatenate([x[3] for x in each]).astype(np.int64)
        lengths = [len(x[2]) for x in each]
        del each
        total = np.cumsum(step, dtype=U)  # wraps around, as its differences do
        starts = np.cumsum(sizes) - sizes
        w = total - np.repeat(total[starts] - step[starts], sizes)
        h = np.repeat(there, sizes)
        key = mixed(h, w)
        del total, w, step
        order = np.argsort(key)
        ends = bounds(key[order])
        learned = np.add.reduceat(n[order], ends[:-1])
        kinds, k = np.unique(h[order[ends[:-1]]][learned > 0], return_counts=True)
        more = np.empty_like(n)
        more[order] = np.repeat(learned, np.diff(ends))
        more -= n
        firsts, chunks_of = np.unique(there, return_counts=True)
        told = np.isin(kinds, firsts[chunks_of > 1]) | np.isin(kinds, hot)  # all others are followed in one chunk only
        kinds, k = kinds[told], k[told]
        at = np.cumsum([0, *lengths])
        blobs = [packed(more[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        bucket = part.column("bucket")[0].as_py()
        columns = [pa.array([*part.column("chunk").to_pylist(), *[None] * len(k)], pa.int64()), pa.array(np.concatenate([np.full(len(blobs), bucket, np.int64), kinds.view(np.int64)])), pa.array([*[None] * len(blobs), *k.tolist()], pa.int64()), pa.array([*blobs, *[None] * len(k)], pa.binary())]
        return pa.Table.from_arrays(columns, names=["chunk", "at", "k", "blob"])

    sent = table.select("chunk", "words", "learn", "sizes", "tokens").mapInArrow(send, "bucket long, chunk long, blob binary")
    return sent.groupBy("bucket").applyInArrow(add, "chunk long, at long, k long, blob binary")


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte 3-grams that spell each of ``words``, in a row, and how many each word has: one a byte, and the boundary."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int64)
    starts = np.cumsum(lengths + 3) - (lengths + 3)
    padded = np.full(int((lengths + 3).sum()), BOUND, np.int64)
    padded[np.arange(len(flat)) + np.repeat(3 * np.arange(len(lengths)) + 2, lengths)] = flat
    grams = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:] if len(padded) else padded
    inside = np.ones(len(padded), bool)
    inside[starts + lengths + 1] = inside[starts + lengths + 2] = False
    return grams[inside[: len(grams)]], lengths + 1


def byte_counts(totals: DataFrame) -> dict[int, int]:
    """How many learned words are spelled with each 3-gram of bytes, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = np.unique(spelled(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])

    found = totals.filter("c > 0").select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


class Spelling:
    """log10 of the weight of each byte after its context of two, interpolated down to bytes that are all alike."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.codes = np.array(sorted(counts), np.int64)
        c3 = np.array([counts[k] for k in self.codes.tolist()], float)
        a, b, c = self.codes >> 16, (self.codes >> 8) & 255, self.codes & 255
        c2 = np.zeros((256, 256))
        np.add.at(c2, (b, c), c3)
        c1 = c2.sum(axis=0)
        over = lambda n: np.maximum(n, 1)
        self.p1 = np.maximum(c1 - DISCOUNT, 0) / over(c1.sum()) + (DISCOUNT * (c1 > 0).sum() / c1.sum() if c1.sum() else 1) / 256
        n, kinds = c2.sum(axis=1), (c2 > 0).sum(axis=1)
        back = np.where(n > 0, DISCOUNT * kinds / over(n), 1.0)
        self.p2 = np.maximum(c2 - DISCOUNT, 0) / over(n)[:, None] + back[:, None] * self.p1[None, :]
        of = (a << 8) | b
        n3, k3 = np.bincount(of, weights=c3, minlength=65536), np.bincount(of, minlength=65536)
        self.back = np.where(n3 > 0, DISCOUNT * k3 / over(n3), 1.0)
        self.arc = np.maximum(c3 - DISCOUNT, 0) / over(n3[of])

    def weigh(self, grams: np.ndarray) -> np.ndarray:
        p = self.back[grams >> 8] * self.p2[(grams >> 8) & 255, grams & 255]
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
            p = p + np.where(self.codes[at] == grams, self.arc[at], 0)
        return np.log10(p)

    def words(self, words: pa.Array) -> np.ndarray:
        """log10 of the probability of each word's spelling."""
        grams, sizes = spelled(words)
        return np.add.reduceat(self.weigh(grams), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def weights(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The discounted arc weights and the backoff weights of the states, which were contexts ``counts`` times."""
    total = np.maximum(np.maximum(counts, 1), pairs.sum(axis=1))
    arc = np.maximum(pairs - DISCOUNT, 0) / total[:, None]
    return arc, 1 - arc.sum(axis=1)


class Model:
    def __init__(self, n: int, v: int, discount: float, rank: dict[bytes, int], pairs: np.ndarray, counts: np.ndarray, grams: dict[int, int]) -> None:
        self.n, self.discount, self.rank, self.spelling = n, discount, rank, Spelling(grams)
        self.log_free = math.log10(discount * v / n) if n else 0.0  # the root's failure arc
        self.base = math.log10(n + v + 1)
        arc, backoff = weights(pairs, counts)
        self.arc = np.pad(arc, ((0, 1), (0, 1)))  # the last state is the root, the last arc that of any other word
        self.backoff = np.append(backoff, 1.0)

    def score(self, words: pa.Array, c: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """n_known, base score and score of each text; ``words`` were learned ``c`` times.

        ``pairs``: how often each token's pair was learned, and how many kinds of words followed each of ``words``, where all words are states.
        """
        k = len(self.rank)
        rank = np.array([self.rank.get(w, k) for w in words.to_pylist()], np.int64)
        free = self.spelling.words(words) + self.log_free
        learned = np.maximum(c - self.discount, 0) / max(1, self.n)
        with np.errstate(divide="ignore"):
            at_root = np.where(learned > 0, np.log10(learned + 10**free), free)  # long spellings would vanish as numbers
        state = rank[tokens]
        before = np.concatenate([[0], state[:-1]])
        starts = np.cumsum(sizes) - sizes
        before[starts] = self.rank.get(END, k)
        each = at_root[tokens]
        if pairs is None:
            back, arc = self.backoff[before], self.arc[before, state]
        else:
            n, kinds = pairs
            h = np.concatenate([np.zeros(1, np.int64), tokens[:-1].astype(np.int64)])[: len(tokens)]
            h[starts] = 0
            total = np.maximum(c, 1)
            back = np.where(c > 0, DISCOUNT * kinds / total, 1.0)[h]
            arc = np.maximum(n - DISCOUNT, 0) / total[h]
        with np.errstate(divide="ignore"):
            each = np.where(arc > 0, np.log10(arc + back * 10**each), np.log10(back) + each)
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return add((c > 0)[tokens].astype(np.int64)), add(np.log10(c + 1)[tokens]) - sizes * self.base, add(each)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``share``: 0 for all words as states; above, only words that make up so much of the tokens are.
    """
    context = docs.sparkSession.sparkContext
    table = stored(chunks(docs, id_col, text_col, chunk_bytes), TOGETHER)
    listed = table.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("chunk", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = swept(listed.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")))
    times = lambda k: F.count(F.when(F.col("c") == k, 1))
    row = totals.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), times(1).alias("once"), times(2).alias("twice")).first()
    n, v, once, twice = (int(x) for x in row)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    top = totals.filter(F.col("c") >= max(1.0, share * n)).orderBy(F.desc("c"), "word").select("word", "c").collect() if n and share else []
    rank = {bytes(r["word"]): k for k, r in enumerate(top)}
    model = context.broadcast(Model(n, v, discount, rank, pair_counts(table, rank), np.array([r["c"] for r in top], float), byte_counts(totals)))
    # a word of one chunk has all its counts there
    spread = totals.filter("chunks > 1").select(F.col("word").alias("of"), "c", F.lit(0).cast("long").alias("kinds"))
    if not share:
        size = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        buckets = -(-size // TOKENS) or 1
        hot = hashed(pa.array([bytes(r["word"]) for r in totals.filter(F.col("c") * 4 * buckets > n).select("word").collect()], pa.binary()))
        pairs = swept(all_pairs(table, hot, buckets), TOGETHER)
        kinds = pairs.filter("chunk is null").groupBy(F.col("at").alias("h")).agg(F.sum("k").alias("k"))
        spread = spread.join(kinds, F.xxhash64("of") == F.col("h"), "left").select("of", "c", F.coalesce("k", "kinds").alias("kinds"))
    n_parts = 2 * max(1, table.select("chunk").count())
    back = listed.select("chunk", "local", "word").join(spread, F.col("word") == F.col("of")).select(F.col("chunk").alias("part"), F.col("local").cast("long").alias("local"), "c", "kinds", F.lit(None).cast("binary").alias("blob"))
    if not share:
        back = swept(back)
        discard(totals)
        none = F.lit(None).cast("long")
        back = back.unionByName(pairs.filter("chunk is not null").select(F.col("chunk").alias("part"), F.col("at").alias("local"), none.alias("c"), none.alias("kinds"), "blob"))
    back = back.repartition(n_parts, "part")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        m = model.value
        row = {c: left.column(c)[0] for c in left.column_names}
        sizes = np.asarray(row["sizes"].values)
        c = np.array(row["counts"].values)
        pair = right.column("blob").is_valid().to_numpy()
        words, blobs = right.filter(pa.array(~pair)), right.filter(pa.array(pair))
        local = words.column("local").to_numpy()
        c[local] = words.column("c").to_numpy()
        tokens = unpacked(row["tokens"].as_py(), sizes)
        counted = None
        if not share:
            codes, n, of = local_pairs(len(c), np.array(row["learn"].values.to_pylist(), bool), tokens, sizes)
            followed = np.bincount(codes[n > 0] // len(c), minlength=len(c))
            followed[local] = words.column("kinds").to_numpy()
            order, bucket, _, _ = placed(hashed(row["words"].values), codes, hot, buckets)
            ends = bounds(bucket)
            found = dict(zip(blobs.column("local").to_pylist(), blobs.column("blob").to_pylist(), strict=True))
            n[order] += np.concatenate([opened(found[k], 1)[0] for k in bucket[ends[:-1]].tolist()]).astype(np.int64)
            counted = n[of], followed
        known, base, scored = m.score(row["words"].values, c, tokens, sizes, counted)
        columns = [row["ids"].values, row["held"].values, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), m.n)), pa.array(base), pa.array(scored)]
        return pa.Table.from_arrays(columns, names=schema.names)

    return table.repartition(n_parts, "chunk").groupBy("chunk").cogroup(back.groupBy("part")).applyInArrow(traverse, schema)
