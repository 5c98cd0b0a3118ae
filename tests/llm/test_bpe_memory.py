"""What a worker of the BPE keeps of each word."""

import gc
import random
import tracemalloc
from pathlib import Path

from tessera.llm import bpe
from tessera.llm.queries import WORD_BPE


def test_cached_words_are_small():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(8, 12))) for _ in range(20_000)]
    e = bpe.Encoder(bpe.Vocabulary(Path(WORD_BPE).read_text(encoding="utf-8")))
    for w in words:
        e.joined(w)
    e.pieces.clear()
    e.young = {}
    gc.collect()
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for w in words:
        e.joined(w)
    e.pieces.clear()
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert kept / len(set(words)) < 130


def test_joined():
    e = bpe.Encoder(bpe.Vocabulary(Path(WORD_BPE).read_text(encoding="utf-8")))
    for text in ["", " ", "a", "Eine Straße, 12 Äpfel\x1c\n<|endoftext|>x", "x" * 300, "́ \x00 née", "a b\u0085c"]:
        for _ in range(2):
            ids = e.encode(text)
            assert e.joined(text) == (len(ids), " ".join(map(str, ids)).encode(), " ".join(e.decode(e.word(w)) for w in e.words(text) if e.word(w)).encode())
