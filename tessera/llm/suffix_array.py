"""Suffix-array dedup: removal of bytes covered by a string of ``length`` bytes that starts anywhere else too.

Suffix arrays are built by linear grouping (``suffix_array``). Suffixes are grouped by their Lyndon
prefix: first by their first symbol, then, group by group in descending order, by what follows;
previous-smaller pointers tell which earlier suffixes a processed group refines. A second pass over
the places in ascending order emits each group's order from the suffixes that are already placed,
without renaming and recursion.

No array spans the corpus. Every window of ``length`` bytes belongs to one anchor, its leftmost
K-gram of least hash; equal windows have equal anchors, whatever surrounds them. The windows of one
anchor in a row make a region. Then:

1. Each text gives its regions: anchor hash, region hash, place.
2. By anchor, with map-side combining: a region alone with its anchor repeats nowhere; one that
   occurs twice repeats as a whole; those that share an anchor and differ somewhere are undecided.
3. Undecided regions, one of each kind, are cut out of their texts and brought together by anchor.
   Slices of them that are equal as wholes settle their windows; the rest, which agree in part, are
   laid beside each other and a suffix array tells which windows repeat. An anchor with more than
   ``max_kinds`` kinds has its windows counted by 128-bit hash, spread over the cluster, instead.
4. Repeated windows go back to their texts. A Bloom filter of bounded size keeps texts without any
   from being shuffled.

Passages of words are found in the same way (``passage_words``): a text is written as four bytes of hash
a word, A-Z lowered, and stretches that windows of that many words cover are counted in words.

Matches never cross documents, as regions lie in one text. Equal texts share one text key, by which
what was found for one holds for all.

Cases: a null text is the empty text; a text shorter than ``length`` stays whole; rows that repeat
are copies like any other, so all of them are removed; ids may be null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bloom import bits_of, n_blocks, test_rows
from tessera.llm.common import lookup_join, release, trim, whole
from tessera.llm.tables import discard, stored

U = np.uint64
PLACE_BITS = 24  # low bits of an anchor's rank, which hold its place; so much text is looked at at once
_BUFFER = 1 << 18
_OUT = 1 << 20  # bytes of pieces, about, that a worker holds before it hands them on
_ROW = 100  # what a row counts for besides
_LONGEST = 1 << 22  # longer texts are taken in slices that overlap by a window
_BASE = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(12345).integers(0, 2**63, 256).astype(U) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 2**64))
        k *= 2
    return out


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def regions(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Regions of the texts that lie at [starts, ends) of ``buf``: text, first window, windows, anchor's offset, anchor hash, region hash."""
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    n = len(buf)
    empty = np.zeros(0, np.int64)
    long_enough = ends - starts >= length
    if not long_enough.any():
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    up, down = _tables(max(n + 1, 2 * _BUFFER))
    s = np.zeros(n + 1, U)
    np.cumsum(_SYMBOL[buf] * up[:n], out=s[1:])
    grams = _mixed((s[k:] - s[:-k]) * down[: n + 1 - k])
    least = (grams >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(grams), dtype=U)
    span, w = length - k + 1, 1
    while w * 2 <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < span:
        least = np.minimum(least[: len(least) - (span - w)], least[span - w :])
    anchor = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    first, last = starts[long_enough], ends[long_enough] - length + 1
    inside = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    change[first] = True
    i0 = np.nonzero(change & inside)[0]
    breaks = np.append(np.nonzero(change | ~inside)[0], len(anchor))
    windows = breaks[np.searchsorted(breaks, i0) + 1] - i0
    at = anchor[i0]
    end = i0 + windows - 1 + length
    body = _mixed((s[end] - s[i0]) * down[i0])
    shape = (end - i0).astype(U) * U(_BASE) + (at - i0).astype(U)
    text = np.searchsorted(starts, i0, side="right") - 1
    return text, i0 - starts[text], windows, at - i0, grams[at], _mixed(body ^ shape)


WORD_BYTES = 4


def as_words(text: bytes) -> bytes:
    """WORD_BYTES of hash for each word of ``text``, A-Z lowered. Hashing beats looking hashes up, and keeps nothing."""
    return b"".join(map(xxhash.xxh32_digest, text.lower().split()))


def _scan(batch: pa.RecordBatch, length: int, k: int, encode: Callable[[bytes], bytes] | None) -> Iterator[tuple[list[bytes], tuple[np.ndarray, ...]]]:
    """Keys and regions of the texts of a batch (columns key, text), some texts at a time."""
    keys: list[bytes] = []
    texts: list[bytes] = []
    shifts: list[int] = []
    size = 0

    def done() -> tuple[list[bytes], tuple[np.ndarray, ...]]:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(texts) + b"\0" * length, np.uint8)
        found = list(regions(buf, ends - sizes, ends, length, k))
        found[1] = found[1] + np.array(shifts)[found[0]] if len(found[0]) else found[1]
        return list(keys), tuple(found)

    seen: set[bytes] = set()
    again: dict[bytes, int] = {}
    for n in range(batch.num_rows):
        key, text = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
        if encode:
            text = encode(text)
        if len(text) < length:
            continue
        if key in seen:
            again[key] = len(text)
            continue
        seen.add(key)
        for shift in range(0, len(text) - length + 1, _LONGEST):
            keys.append(key)
            texts.append(text[shift : shift + _LONGEST + length - 1])
            shifts.append(shift)
            size += len(texts[-1])
            if size >= _BUFFER:
                yield done()
                keys, texts, shifts, size = [], [], [], 0
    if texts:
        yield done()
    if again:
        none = np.zeros(0, np.int64)
        yield list(again), (np.arange(len(again)), np.zeros(len(again), np.int64), np.array(list(again.values())) - length + 1, none, none, none)


def suffix_array(text: list[int] | bytes | np.ndarray) -> list[int]:
    """The suffix array of ``text``, by linear grouping.

    A virtual symbol below all others ends the text. ``order`` holds the suffixes by group, each
    group in a row; moving suffixes to a new group right after their own means swapping them to the
    row's end. Groups are taken from the highest down; all that a group refines lie below it.
    """
    symbols = [*(int(c) + 1 for c in text), 0]
    n = len(symbols)
    count = [0] * (max(symbols) + 2)
    for c in symbols:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    base = count[:]
    order = [0] * n
    where = [0] * n
    group = [0] * n  # the row at which a suffix's group starts
    for i, c in enumerate(symbols):
        where[i] = base[c]
        order[base[c]] = i
        group[i] = count[c]
        base[c] += 1
    size = [0] * n
    for c in range(len(count) - 1):
        if count[c + 1] > count[c]:
            size[count[c]] = count[c + 1] - count[c]
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        members.sort()
        points: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        if points:
            by_count: dict[int, list[int]] = {}
            for j, k in points.items():
                by_count.setdefault(k, []).append(j)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for j in by_count[k]:
                    moved.setdefault(group[j], []).append(j)
                for old, js in moved.items():
                    left = size[old] - len(js)
                    if not left:
                        continue
                    size[old] = left
                    new = old + left
                    size[new] = len(js)
                    row = old + left + len(js)
                    for j in js:
                        # swap j to the end of its group's row
                        row -= 1
                        p, q = where[j], order[row]
                        order[p], order[row] = q, j
                        where[q], where[j] = p, row
                    for j in js:
                        group[j] = new
        end = g
    free = {}
    placed = [False] * n
    out = [-1] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            row = free.get(g, g)
            out[row] = j
            free[g] = row + 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def repeated_windows(texts: list[list[int]], length: int) -> list[np.ndarray]:
    """For each text (symbols above 0), which of its windows of ``length`` symbols occur elsewhere in ``texts``.

    0 stands between texts. Of all suffixes with ``length`` symbols left in their text, equal windows are neighbours in the array.
    """
    joined: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(joined))
        joined += t
        joined.append(0)
    room = np.zeros(len(joined), np.int64)
    for s, t in zip(starts, texts, strict=True):
        room[s : s + len(t)] = len(t) - np.arange(len(t))
    sa = np.array(suffix_array(joined), np.int64)
    sa = sa[room[sa] >= length]
    flat = np.array(joined, np.int32)
    hit = np.zeros(len(flat), bool)
    if len(sa) > 1:
        windows = flat[sa[:, None] + np.arange(length)[None, :]]
        equal = (windows[1:] == windows[:-1]).all(axis=1)
        hit[sa[1:][equal]] = True
        hit[sa[:-1][equal]] = True
    return [hit[s : s + max(0, len(t) - length + 1)] for s, t in zip(starts, texts, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


class Settler:
    """Finds which windows of the kinds of an anchor occur in another kind of it.

    Windows are taken by how far their anchor is from their start, a rung of distances at a time. All
    windows of a rung hold the rung's core; kinds without a common core have none in common, kinds
    with an equal hull have all in common. What is left agrees in the core and not in the margins:
    the margins, around one symbol that stands for the core, go to a suffix array with others.
    """

    def __init__(self, length: int, k: int, rungs: int = 20, batch: int = 1 << 15) -> None:
        self.length, self.k, self.batch = length, k, batch
        self.step = max(1, (length - k) // rungs)
        self.waiting: list[tuple[list[int], list[tuple[np.ndarray, int, int]], int]] = []
        self.size = self.core = 0

    def add(self, kinds: list[tuple[bytes, int]]) -> list[np.ndarray]:
        """Flags of the windows of each kind (region text, anchor's offset); complete after ``finish``."""
        length, step = self.length, self.step
        flags = [np.zeros(len(t) - length + 1, bool) for t, _ in kinds]
        for low in range(0, length - self.k + 1, step):
            high = min(low + step - 1, length - self.k)  # distances low to high
            cores: dict[bytes, list[tuple[int, int, int]]] = {}
            for n, (t, at) in enumerate(kinds):
                first, last = max(0, at - high), min(len(flags[n]) - 1, at - low)
                if first <= last:
                    cores.setdefault(t[at - low : at - high + length], []).append((n, first, last))
            for group in cores.values():
                if len(group) > 1:
                    self._group(kinds, flags, group, low, high)
        return flags

    def _group(self, kinds: list[tuple[bytes, int]], flags: list[np.ndarray], group: list[tuple[int, int, int]], low: int, high: int) -> None:
        hulls: dict[tuple[int, bytes], list[tuple[np.ndarray, int, int]]] = {}
        for n, first, last in group:
            t, at = kinds[n]
            hulls.setdefault((at - first, t[first : last + self.length]), []).append((flags[n], first, last))
        for same in hulls.values():
            if len(same) > 1:
                for f, first, last in same:
                    f[first : last + 1] = True
        if len(hulls) == 1:
            return
        self.core += 1
        for (left, hull), same in hulls.items():
            a, b = left - low, left - high + self.length  # the core is hull[a:b]
            text = [c + 1 for c in hull[:a]] + [256 + self.core] + [c + 1 for c in hull[b:]]
            self.waiting.append((text, same, high - low + 1))
            self.size += len(text)
        if self.size > self.batch:  # no window of this group occurs in another
            self.finish()

    def finish(self) -> None:
        for symbols in {w[2] for w in self.waiting}:
            chosen = [w for w in self.waiting if w[2] == symbols]
            for (_, same, _), hit in zip(chosen, repeated_windows([w[0] for w in chosen], symbols), strict=True):
                for f, first, last in same:
                    f[first : last + 1] |= hit
        self.waiting, self.size, self.core = [], 0, 0


def _region_rows(texts: DataFrame, length: int, k: int, encode: Callable[[bytes], bytes] | None) -> DataFrame:
    """(key, first, windows, at, anchor, body): a row a region. A row without an anchor says that a text occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for keys, (text, first, windows, at, anchor, body) in _scan(batch, length, k, encode):
                hashed = [pa.array(x) if len(x) else pa.nulls(len(text), t) for x, t in ((at.astype(np.int32), pa.int32()), (anchor.view(np.int64), pa.int64()), (body.view(np.int64), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), *hashed], names=["key", "first", "windows", "at", "anchor", "body"])
        trim()

    return texts.select("key", "text").mapInArrow(run, "key binary, first int, windows int, at int, anchor long, body long")


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, encode: Callable[[bytes], bytes] | None) -> Iterator[pa.RecordBatch]:
    """(anchor, key, first, at, n, piece, window): the regions of texts (key, regions, text), a row each, or a row a window if they are hot.

    A text of hot regions gives a row a byte, so rows are handed on as they come, not a batch of texts at a time.
    """
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    out: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "key", "first", "at", "n", "piece", "window"])

    trim()
    for batch in batches:
        for n in range(batch.num_rows):
            key, text = batch.column(0)[n].as_py(), batch.column(2)[n].as_py()
            if encode:
                text = encode(text)
            for r in batch.column(1)[n].as_py():
                piece = text[r["first"] : r["first"] + r["windows"] - 1 + length]
                if not r["hot"]:
                    rows = [(r["anchor"], key, r["first"], r["at"], r["n"], piece, None)]
                else:
                    rows = ((r["anchor"], key, r["first"] + w, None, r["n"], None, hashlib.blake2b(piece[w : w + length], digest_size=16).digest()) for w in range(r["windows"]))
                for row in rows:
                    out.append(row)
                    size += _ROW + len(row[5] or b"")
                    if size >= _OUT:
                        yield done()
                        out, size = [], 0
    if out:
        yield done()
    del out
    trim()


_SPAN = "key binary, start int, end int"


def repeated_spans(texts: DataFrame, length: int, k: int, max_kinds: int, block_bytes: int, encode: Callable[[bytes], bytes] | None = None, hot_share: float = 0.001) -> DataFrame:
    """(key, spans): for each text (key, text) the stretches, as ``encode`` writes it, that repeated windows cover; they may overlap."""
    found = stored(_region_rows(texts, length, k, encode))
    rows = found.filter(F.col("anchor").isNotNull())
    span = lambda d: d.select("key", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    # a batch lists copies of its own texts, which repeat as a whole; other copies share all regions
    copies = span(found.filter(F.col("anchor").isNull()))
    by_anchor = stored(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("body").alias("least"), F.max("body").alias("most")).filter("n > 1"))
    # a filter of bounded size keeps the regions that are alone from being shuffled, anchors of many regions are broadcast
    blocks = n_blocks(max(1, by_anchor.count()))
    maybe = test_rows(rows, bits_of(by_anchor.select("anchor"), "anchor", blocks), "anchor", blocks).filter("maybe").drop("maybe")
    listed = by_anchor.select(F.col("anchor").alias("a"), "n", "least", "most")
    many = F.col("n") > max(2, hot_share * found.count())
    hot = F.broadcast(listed.filter(many))  # at most 1 / hot_share rows
    same = F.col("anchor") == F.col("a")
    few = maybe.join(hot.select("a"), same, "left_anti").join(listed.filter(~many).hint("merge"), same)
    shared = stored(maybe.join(hot, same).unionByName(few).drop("a", "n"))
    decided = span(shared.filter("least = most"))
    mixed = shared.filter("least <> most").drop("least", "most")
    one = F.min(F.struct("key", "first", "windows", "at"))
    kinds = stored(mixed.groupBy("anchor", "body").agg(F.count("*").alias("n"), one.alias("one")).select("anchor", "body", "n", "one.*"))
    several = kinds.filter("n > 1").select(F.col("anchor").alias("a"), F.col("body").alias("b"))
    decided = decided.unionByName(span(mixed.join(several, (F.col("anchor") == F.col("a")) & (F.col("body") == F.col("b")), "left_semi")))
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).select(F.col("anchor").alias("a"), "kinds")
    wanted = kinds.join(crowd, F.col("anchor") == F.col("a")).select("key", "first", "windows", "at", "anchor", "n", (F.col("kinds") > max_kinds).alias("hot"))
    wanted = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("first", "windows", "at", "anchor", "n", "hot")).alias("regions")))
    blocks = n_blocks(wanted.count())
    some = test_rows(texts.withColumn("h", F.xxhash64("key")), bits_of(wanted.select(F.xxhash64("key").alias("h")), "h", blocks), "h", blocks).filter("maybe")
    some = some.select("key", "text").dropDuplicates(["key"])
    joined = wanted.withColumnRenamed("key", "wkey").join(some, F.col("wkey") == F.col("key")).select("key", "regions", "text")

    pieces = stored(joined.mapInArrow(lambda batches: _cut_out(batches, length, encode), "anchor long, key binary, first int, at int, n long, piece binary, window binary"))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("n")).first()["n"]
    n_parts = max(1, int(size) // block_bytes)

    def compare(table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple]] = defaultdict(list)
        for row in zip(*(table.column(c).to_pylist() for c in ("anchor", "key", "first", "at", "n", "piece")), strict=True):
            by[row[0]].append(row[1:])
        settler = Settler(length, k)
        flags = [settler.add([(piece, at) for _, _, at, _, piece in members]) for members in by.values()]
        settler.finish()
        out: list[tuple] = []
        for members, hits in zip(by.values(), flags, strict=True):
            for (key, first, _, n, _), hit in zip(members, hits, strict=True):
                if n == 1:
                    out.extend((key, first + a, first + b + length) for a, b in _runs(hit))
        del by, settler, flags
        trim()
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["key", "start", "end"])

    parts_of = pieces.filter(F.col("piece").isNotNull()).withColumn("part", F.pmod(F.col("anchor"), F.lit(n_parts)))
    compared = parts_of.groupBy("part").applyInArrow(compare, _SPAN)
    windows = pieces.filter(F.col("window").isNotNull())
    twice = windows.groupBy("window").count().filter("count > 1").select(F.col("window").alias("w"))
    crowded = windows.join(twice, F.col("window") == F.col("w"), "left_semi").select("key", F.col("first").alias("start"), (F.col("first") + length).alias("end"))
    out = stored(decided.unionByName(copies).unionByName(compared).unionByName(crowded).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(found, by_anchor, shared, kinds, wanted, pieces)
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def passages(texts: DataFrame, words: int, max_kinds: int, block_bytes: int) -> DataFrame:
    """(key, n_passage_words): the words of the texts (key, text) that lie in windows of ``words`` words which occur elsewhere too."""
    spans = repeated_spans(texts, words * WORD_BYTES, 8 * WORD_BYTES, max_kinds, block_bytes, as_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            n = [sum(c for x, y in _merged(row.as_py()) if (c := y // WORD_BYTES - -(-x // WORD_BYTES)) >= words) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_passage_words"])

    out = stored(spans.mapInArrow(run, "key binary, n_passage_words long").filter("n_passage_words > 0"))
    discard(spans)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, k: int = 100, max_kinds: int = 2000, block_bytes: int = 4 << 20, passage_words: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes, kept (the remaining bytes), spans (the removed runs) and n_passage_words (null unless ``passage_words`` is given)."""
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    n = docs.count()
    spans = repeated_spans(texts.select("key", "text"), length, k, max_kinds, block_bytes)
    by_text = spans.withColumn("n_passage_words", F.lit(None).cast("long"))
    if passage_words:
        release(docs.sparkSession)
        words = passages(texts.select("key", "text"), passage_words, max_kinds, block_bytes).withColumnRenamed("key", "wkey").withColumnRenamed("n_passage_words", "words")
        both = spans.join(words.hint("merge"), F.col("key") == F.col("wkey"), "full").select(F.coalesce("key", "wkey").alias("key"), "spans", F.coalesce("words", F.lit(0).cast("long")).alias("n_passage_words"))
        by_text = stored(both)
        discard(spans)
    blocks = n_blocks(n)
    tested = test_rows(texts.withColumn("h", F.xxhash64("key")), bits_of(by_text.select(F.xxhash64("key").alias("h")), "h", blocks), "h", blocks)
    untouched = tested.filter(~F.col("maybe")).select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("kept"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0 if passage_words else None).cast("long").alias("n_passage_words"))
    touched = lookup_join(tested.filter("maybe").select("id", "key", "text"), by_text, ["key"], how="left").select("id", "text", "spans", F.coalesce("n_passage_words", F.lit(0 if passage_words else None).cast("long")).alias("n_passage_words"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", untouched.schema["spans"].dataType), T.StructField("n_passage_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        trim()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                size, kept, spans = [], [], []
                for n in range(b.num_rows):
                    text, runs = b.column(1)[n].as_py(), _merged(b.column(2)[n].as_py() or [])
                    ends = [0, *(y for _, y in runs)]
                    size.append(len(text))
                    kept.append(b"".join(text[x:y] for x, y in zip(ends, [*(x for x, _ in runs), len(text)], strict=True)))
                    spans.append([{"start": x, "end": y} for x, y in runs])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind), b.column(3)], names=schema.names)

    return untouched.unionByName(touched.mapInArrow(run, schema)).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage_words: int = 51) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage_words: its words in passages of over 50 words that start anywhere else too."""
    d = dedup(docs, id_col, text_col, length, passage_words=passage_words)
    return d.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
