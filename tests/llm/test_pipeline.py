"""The pipeline against its stages done by hand."""

import collections
import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import awkward, judged


def test_pipeline(spark, tmp_path):
    rows = [r for r in awkward(5, 200) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r, (_, ok) in zip(rows, judged(rows, 200), strict=True) if ok]
    groups = collections.defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    sets = {}
    for r in kept:
        w = r[1].encode().lower().split()
        sets[r[0]] = set(zip(w, w[1:], strict=False))
    label = {d: d for d in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    kept = [r for r in kept if label[r[0]] == r[0]]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: hashlib.sha256(" ".join(map(str, t.encode(r[1], add_special_tokens=False).ids)).encode()).hexdigest() for r in kept}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = collections.Counter(r["doc_id"] for r in out)
    assert set(times) <= set(want)
    assert max(times.values()) <= 3
    assert len(times) > len(want) / 4
    assert all(r["ids_sha256"] == want[r["doc_id"]] for r in out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
