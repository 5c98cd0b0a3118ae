"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, and that encoding is fixed by its last token. An automaton
over the vocabulary reads the word and yields, at each place, the tokens that end there, longest
first. The first of them that may follow the last token of the prefix before it is the prefix's
last token; whether two tokens may follow each other is found by undoing their merges at the seam.
Following the stored tokens back from the end gives exactly the ids of the merge procedure.

The vocabulary file's path is a parameter; the driver reads the file and broadcasts its merges,
whose size the file bounds. Words are cached, in two generations of bounded size, as one string of bytes
each. Workers give back what earlier stages left in them, as they are handed on with it.

Cases: a null text is the empty text and has no tokens; the strings of special tokens in a text are
those tokens; a text of any length is encoded whole; rows that repeat are encoded alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import trim, whole

CACHE_WORDS = 200_000
#: Separators that Python splits at and that aren't white space here.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and ids of a word-level BPE file: the part of it that encoding needs."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("not a BPE vocabulary with word ends")
        self.suffix: str = model["end_of_word_suffix"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        # own numbers: single symbols first, then products in order of merging
        names = [t for t in ids if t not in made] + [a + b for a, b in merges]
        number = {t: k for k, t in enumerate(names)}
        self.ids = [ids[t] for t in names]
        self.symbols = [self._symbols(t) for t in names]
        self.parts = [(k, k) for k in range(len(names))]
        self.product: dict[tuple[int, int], int] = {}
        for a, b in merges:
            k = number[a + b]
            self.parts[k] = self.product[(number[a], number[b])] = (number[a], number[b])
            self.product[(number[a], number[b])] = k

    def _symbols(self, token: str) -> str:
        """One character a symbol: the last one of a word has its own, moved out of the way."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            bare = token[: -len(self.suffix)]
            return bare[:-1] + chr(ord(bare[-1]) + 0x10000)
        return token


class Encoder:
    """Words to ids; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, list[int]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        # a token whose own string merges differently never comes up
        self.stands: list[bool] = []
        for k, (a, b) in enumerate(vocabulary.parts):
            self.stands.append(a == k or (self.stands[a] and self.stands[b] and self.may_follow(a, b, k)))
        self._automaton()

    def _automaton(self) -> None:
        """States of all prefixes of tokens, with suffix links; ends[s]: the tokens that end in s, longest first."""
        step: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for k, symbols in enumerate(self.v.symbols):
            s = 0
            for c in symbols:
                n = step[s].get(c)
                if n is None:
                    n = step[s][c] = len(step)
                    step.append({})
                    own.append(-1)
                s = n
            own[s] = k if self.stands[k] else -1
        link = [0] * len(step)
        size = [0] * len(step)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            for c, n in step[s].items():
                size[n] = size[s] + 1
                f = link[s]
                while f and c not in step[f]:
                    f = link[f]
                link[n] = step[f].get(c, 0) if s else 0
                ends[n] = (((own[n], size[n]),) if own[n] >= 0 else ()) + ends[link[n]]
                queue.append(n)
        self.step, self.link, self.ends = step, link, ends

    def may_follow(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether merging the symbols of token ``a`` and of ``b`` in a row, up to merge ``limit``, gives these two tokens.

        Undo the later of the two merges again and again; the seam holds if no merge across it
        would have come before the merge that was undone last.
        """
        parts, product = self.v.parts, self.v.product
        limit = len(parts) if limit is None else limit
        while True:
            if product.get((a, b), limit) < limit:
                return False
            left, right = parts[a][1], parts[b][0]
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):
                limit, a = a, left
            else:  # of equal merges the left one comes first
                limit, b = b + 1, right

    def piece(self, symbols: str) -> list[int]:
        """Own numbers of the tokens of a word, one character a symbol."""
        step, link, ends, fits = self.step, self.link, self.ends, self.fits
        last = [0]
        size = [0]
        s = i = 0
        for c in symbols:
            i += 1
            arcs = step[s]
            if c in arcs:
                s = arcs[c]
            else:
                while c not in step[s]:
                    s = link[s]
                s = arcs[c] = step[s][c]  # found once for this state
            for token, length in ends[s]:
                if length == i:
                    break
                pair = (last[i - length] << 20) | token
                if pair in fits:
                    if fits[pair]:
                        break
                else:
                    if len(fits) > 500_000:
                        fits.clear()
                    fits[pair] = fit = self.may_follow(last[i - length], token)
                    if fit:
                        break
            last.append(token)
            size.append(length)
        out = []
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens and white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        else:
            text = text.lower()
        pieces, ids = self.pieces, self.v.ids
        out: list[int] = []
        for word in [text] if text.isalpha() and len(text) < 64 else _PIECES.findall(text):
            found = pieces.get(word)
            if found is None:
                symbols = word.encode().decode("latin-1").translate(self.letters)
                found = [ids[k] for k in self.piece(symbols[:-1] + chr(ord(symbols[-1]) + 0x10000))]
                if len(pieces) >= CACHE_WORDS:
                    pieces.clear()
                if len(word) < 64:
                    pieces[word] = found
            out += found
        return out

    def word(self, text: str) -> list[int]:
        """Ids of a text without white space."""
        if self.special is None or "<" not in text:
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.special.split(text)):
            out += [self.v.special[part]] if k % 2 else self.plain(part)
        return out

    def words(self, text: str) -> list[str]:
        return _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.words(text):
            out += self.word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a space."""
        text_of = self.v.text_of
        return " ".join([text_of[i] for i in ids])

    def joined(self, text: str) -> tuple[int, bytes, bytes]:
        """How many ids ``text`` has, the ids joined by a space, and the decoded text.

        A word is cached as one string of bytes, its ids and its decoded text on two lines: tokens of words have no white space.
        """
        young = self.young
        lines: list[bytes] = []
        for w in self.words(text):
            if w in young:
                found = young[w]
            else:
                found = self.old.get(w)
                if found is None:
                    x = self.word(w)
                    found = (" ".join([str(i) for i in x]) + "\n" + self.decode(x)).encode() if x else b""
                if len(young) >= CACHE_WORDS:
                    self.old, self.young = young, {}
                    young = self.young
                if len(w) < 64:
                    young[w] = found
            if found:
                lines.append(found)
        parts = b"\n".join(lines).split(b"\n") if lines else []
        ids = b" ".join(parts[::2])
        return ids.count(b" ") + bool(ids), ids, b" ".join(parts[1::2])


_ENCODERS: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The encoder of a vocabulary's JSON text, made once per process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(source))
        gc.freeze()  # the automaton stays; the collector needn't look at it again and again
        trim()  # what was read of the file
    return _ENCODERS[key]


def _shas(e: Encoder, text: str) -> tuple[int, str, str]:
    n, ids, decoded = e.joined(text)
    return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _map(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[T.StructField], one) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        e = encoder(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = [one(e, t.as_py()) for t in b.column(1)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c)) for c in columns)], names=names)
            del batch
            trim()

    return docs.select(F.col(id_col), whole(text_col).alias("__text")).mapInArrow(run, schema)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array of int) and decoded."""

    def one(e: Encoder, text: str) -> tuple:
        ids = e.encode(text)
        return ids, e.decode(ids)

    return _map(docs, path, id_col, text_col, [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())], one)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _map(docs, path, id_col, text_col, fields, _shas)
