"""What a worker of the suffix-array dedup holds at once."""

import gc
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import suffix_array as sa


def kept_by(f):
    gc.collect()
    tracemalloc.start()
    f()
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return kept


def test_hashed_words_are_not_kept():
    text = " ".join(f"Word{n}" for n in range(50_000)).encode()
    assert kept_by(lambda: sa.as_words(text)) < 100_000
    assert sa.as_words(b" A b\tA ") == xxhash.xxh32_digest(b"a") + xxhash.xxh32_digest(b"b") + xxhash.xxh32_digest(b"a")


def test_pieces_are_handed_on_as_they_come():
    """Texts of hot anchors give a row a byte: a batch of texts must not become one batch of rows."""
    rng = random.Random(5)
    texts = [rng.randbytes(3_000) for _ in range(30)]
    region = lambda n: {"first": n, "windows": 2_500, "at": 7, "anchor": n, "n": 1, "hot": n % 3 > 0}
    kind = pa.list_(pa.struct([("first", pa.int32()), ("windows", pa.int32()), ("at", pa.int32()), ("anchor", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_())]))
    keys = [bytes([n]) for n in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([[region(n)] for n in range(30)], kind), pa.array(texts, pa.binary())], names=["key", "regions", "text"])
    given = list(sa._cut_out(iter([batch]), 400, None))
    assert len(given) > 3 and max(b.num_rows for b in given) < 15_000
    rows = [tuple(r.values()) for b in given for r in b.to_pylist()]
    want = []
    for n, (key, text) in enumerate(zip(keys, texts, strict=True)):
        if n % 3 == 0:
            want.append((n, key, n, 7, 1, text[n : n + 2_899], None))
        else:
            want += [(n, key, n + w, None, 1, None, hashlib.blake2b(text[n + w : n + w + 400], digest_size=16).digest()) for w in range(2_500)]
    assert rows == want


def test_one_anchor_is_settled_in_steps(monkeypatch):
    """The kinds of one anchor go to suffix arrays group by group, not all at once; the flags stay right."""
    rng = random.Random(6)
    length, k = 60, 12
    letters = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    anchor, sides = letters(k), [(letters(48), letters(48)) for _ in range(4)]
    kinds = []
    for n in range(120):
        left, right = (bytearray(x) for x in sides[n % 4])
        left[rng.randrange(30)], right[18 + rng.randrange(30)] = rng.choice(b"cde"), rng.choice(b"cde")
        kinds.append((bytes(left) + anchor + bytes(right), 48))
    kinds = list(dict.fromkeys(kinds))
    sizes = []
    real = sa.repeated_windows
    monkeypatch.setattr(sa, "repeated_windows", lambda texts, symbols: sizes.append(sum(map(len, texts))) or real(texts, symbols))
    settler = sa.Settler(length, k, rungs=5, batch=300)
    flags = settler.add(kinds)
    settler.finish()
    windows: dict[bytes, set[int]] = {}
    for n, (t, _) in enumerate(kinds):
        for i in range(len(t) - length + 1):
            windows.setdefault(t[i : i + length], set()).add(n)
    for (t, _), f in zip(kinds, flags, strict=True):
        assert f.tolist() == [len(windows[t[i : i + length]]) > 1 for i in range(len(t) - length + 1)]
    assert np.sum(np.concatenate(flags)) > 0
    assert len(sizes) > 1 and max(sizes) < 300 + 120 * 2 * (length - k) // 5
