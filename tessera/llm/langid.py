"""Language ID by cross-parsing entropy.

Each language has a bounded sample of labelled text and the suffix automaton of that sample. A text
is parsed greedily into phrases, each the longest match of the automaton (and at least one
character; one that the sample has not costs ESCAPE more); the fewer phrases a character, normalised by the bits that a place in the sample takes,
the closer the language. The language with the lowest entropy wins.

The sample is bounded: ``passages`` passages of ``passage_chars`` characters a language, chosen by a
hash of id and text and taken at a hashed place; the driver holds it and broadcasts it. Texts are
parsed whole, with runs of anything but letters as one space. Many texts advance together, a
character a step; a text is laid out in rows of ``ROW`` characters, at whose ends a phrase ends. An
automaton is a dense table for the sample's ``DENSE`` commonest characters, and a sorted list of
(state, character) for all its others; no character of the sample is left out.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
was learned. Only rows with a language and an id are learned from; a null id is not held out. Ties
go to the first language by name. Rows that repeat are predicted alike; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import whole

ROW = 1024
DENSE = 47  # the characters of a sample that have a place in the dense table
ESCAPE = 0.25  # what a character that a sample has not costs besides its phrase
BATCH_CHARS = 2_000_000


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id's text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, passages: int, passage_chars: int) -> dict[str, list[str]]:
    """Passages of each language, at most ``passages`` of at most ``passage_chars`` characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * passages / n)))]), F.col("lang"))
    h = F.xxhash64("id", "text")
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - passage_chars, F.lit(0)) + 1) + 1
    some = rows.withColumn("h", h).filter(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))
    cut = some.select("lang", "h", F.substring("text", place.cast("int"), F.lit(passage_chars)).alias("text"))
    best = cut.dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= passages)
    out: dict[str, list[str]] = {}
    for r in sorted(best.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts the substrings of ``text``."""
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def _letters(points: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Code points with each run of what isn't a letter as one space; languages don't differ by digits and signs."""
    letter = alpha[np.where(points < 65536, points, 0x4E00)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32)[keep]


ALPHA = np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536)


class Parser:
    """The automaton of one language. In the dense table, entry (state, symbol) is the next state times
    the table's width; its sign bit says that a phrase ended before the symbol. Symbol 0 is any
    character that the sample hasn't, always a phrase of its own, and ESCAPE more. Symbols above DENSE are looked up
    in ``keys``; where a state has no arc for one, a phrase ends and the root's arc is taken."""

    def __init__(self, passages: list[str]) -> None:
        text = " ".join(_letters(np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32), ALPHA).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").lower() for p in passages)
        self.bits = math.log2(max(2, len(text)))
        common = [c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))]
        number = {c: k for k, c in enumerate(common, 1)}
        self.width = width = min(DENSE, len(common)) + 1
        self.size = len(common) + 1
        self.code = np.zeros(65536, np.int32)
        for c, k in number.items():
            if ord(c) < 65536:
                self.code[ord(c)] = k
        for c in range(65536):
            low = chr(c).lower()
            if len(low) == 1 and low != chr(c) and ord(low) < 65536:
                self.code[c] = self.code[ord(low)]
        beyond = sorted(c for c in common if ord(c) >= 65536)
        self.beyond = np.array([ord(c) for c in beyond], np.int64)
        self.beyond_code = np.array([number[c] for c in beyond], np.int32)
        step = suffix_automaton(text)
        root = np.zeros(width, np.int32)
        root[0] = len(step) * width  # a last state, from which every symbol starts a phrase
        self.starts = np.zeros(self.size, np.int32)  # the root's arcs
        sparse: list[tuple[int, int]] = []
        for c, n in step[0].items():
            self.starts[number[c]] = n * width
            if number[c] < width:
                root[number[c]] = n * width
        table = np.tile(root | np.int32(-(2**31)), (len(step) + 1, 1))
        for s, arcs in enumerate(step):
            for c, n in arcs.items():
                if number[c] < width:
                    table[s, number[c]] = n * width
                else:
                    sparse.append((s * self.size + number[c], n * width))
        table[0, 0] = root[0]
        self.table = table.ravel()
        sparse.sort()
        self.keys = np.array([k for k, _ in sparse], np.int64)
        self.to = np.array([n for _, n in sparse], np.int32)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The symbols of code points."""
        out = self.code[np.where(points < 65536, points, 0)]
        if len(self.beyond) and (high := points >= 65536).any():
            at = np.minimum(np.searchsorted(self.beyond, points[high]), len(self.beyond) - 1)
            out[high] = np.where(self.beyond[at] == points[high], self.beyond_code[at], 0)
        return out

    def phrases(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases in each row of code points; the rows are sorted by length, longest first."""
        codes = np.ascontiguousarray(self.codes(points).T)
        rare = codes >= self.width
        some = rare.any(axis=1)
        n = len(lengths)
        count = np.zeros(n, np.int32)
        state = np.zeros(n, np.int32)
        alive = np.searchsorted(-lengths, -np.arange(codes.shape[0]), side="left")
        for t in range(codes.shape[0]):
            k = alive[t]
            if not k:
                break
            c = codes[t, :k]
            if some[t]:
                at = np.flatnonzero(rare[t, :k])
                key = (state[at] // self.width).astype(np.int64) * self.size + c[at]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                arc = self.keys[place] == key
                v = self.table[state[:k] + np.where(rare[t, :k], 0, c)]
                v[at] = np.where(arc, self.to[place], self.starts[c[at]] | np.int32(-(2**31)))
            else:
                v = self.table[state[:k] + c]
            count[:k] -= v >> 31
            state[:k] = v & 0x7FFFFFFF
        # the first symbol of a row is a match from the root, not a phrase that ended
        unknown = (codes == 0) & (np.arange(codes.shape[0])[:, None] < lengths)
        return count + 1 + ESCAPE * unknown.sum(axis=0)


class Identifier:
    def __init__(self, passages: dict[str, list[str]]) -> None:
        self.langs = sorted(passages)
        self.parsers = [Parser(passages[x]) for x in self.langs]
        self.alpha = ALPHA

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text (rows) in each language (columns), and whether it has a letter."""
        bits = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), bool)
        points = [_letters(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), self.alpha) for t in texts]
        starts, lengths, owner = [], [], []
        at = 0
        for k, p in enumerate(points):
            for s in range(0, len(p), ROW):
                starts.append(at + s)
                lengths.append(min(ROW, len(p) - s))
                owner.append(k)
            at += len(p)
            if len(p):
                low = p < 65536
                letters[k] = self.alpha[p[low]].any() or (not low.all() and any(c.isalpha() for c in texts[k]))
        if not starts or not self.langs:
            return bits, letters
        flat = np.concatenate([*points, np.zeros(ROW, np.uint32)])
        order = np.argsort(-np.array(lengths), kind="stable")
        start, length, own = np.array(starts)[order], np.array(lengths)[order], np.array(owner)[order]
        rows = flat[start[:, None] + np.arange(length[0])[None, :]]
        size = np.array([max(1, len(p)) for p in points])
        for j, parser in enumerate(self.parsers):
            n = np.bincount(own, weights=parser.phrases(rows, length), minlength=len(texts))
            bits[:, j] = n * parser.bits / size
        return bits, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        bits, letters = self.entropies(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = bits.argmin(axis=1)
        weight = np.array([min(64, len(t)) for t in texts], float)
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * weight[:, None])
        score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score.tolist()


_MADE: dict[str, Identifier] = {}  # of this Python worker


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_CHARS characters."""
    at = size = 0
    for k in range(len(texts)):
        size += len(texts[k].as_py() or "")
        if size >= BATCH_CHARS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passages: int = 60, passage_chars: int = 1000) -> DataFrame:
    """One row per document: id, held_out, lang_pred and score."""
    learned = docs.sparkSession.sparkContext.broadcast(samples(docs, id_col, text_col, lang_col, passages, passage_chars))
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, name = schema.names, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Identifier(learned.value)
        model = _MADE[name]
        for batch in batches:
            for a, b in _slices(batch.column(2)):
                part = batch.slice(a, b - a)
                langs, scores = model.predict([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    rows = docs.select(F.col(id_col), F.coalesce(remainder(id_col, 4) == 2, F.lit(False)).alias("__held_out"), whole(text_col).alias("__text"))
    return rows.mapInArrow(run, schema)
