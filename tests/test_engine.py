"""Index, operators, graph, scoring, suggestions and entry points on small corpora."""

import datetime as dt
import math
import random

import pytest

from tessera.api import UserError, relational, search, update_index
from tessera.config import EngineConfig
from tessera.operators import graph, index, postings
from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Relation, Wildcard, Zone
from tessera.plans.compile import Compiler
from tessera.plans.suggest import suggest
from tessera.sources import articles, schemas


def document(doc_id, infoboxes, main, citations, categories, links="", title=None, date=""):
    return (doc_id, title or f"t{doc_id}", f"abstract {doc_id}", categories, date, main, links, [{"itype": a, "text": b} for a, b in infoboxes], citations)


def build(spark, *docs, **options):
    return index.build(spark.createDataFrame(list(docs), schemas.DOCUMENT), **options)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def match(ix, q, **options):
    return rows(Compiler(ix, **options).postings(q).select("doc_id", "pos"))


def test_positions_and_frequencies(spark):
    ix = build(
        spark,
        document(0, [("infobox", "hello world"), ("infobox2", "hello")], "eggs world", ["this that", "that", "eggs"], "hello world"),
        document(1, [("infobox", "aaa aa"), ("infobox2", "aaa")], "eggs world", ["aaa aa", "aaa", "aa"], "aaa aaa"),
        rank=False,
    )
    df = {r["token"]: r["df"] for r in ix.dictionary.collect()}
    assert [df.get(t, 0) for t in ("hello", "world", "this", "that", "eggs", "kirby")] == [1, 2, 1, 1, 2, 0]
    tf = {(r["token"], r["doc_id"]): r["tf"] for r in ix.tf.collect()}
    assert [tf.get((t, 0), 0) for t in ("hello", "world", "this", "that", "eggs")] == [3, 3, 1, 2, 2]
    one = build(spark, document(2, [("", "aaa bbb")], "ccc ddd", ["eee fff"], "ggg hhh"), rank=False)
    at = {r["token"]: r["pos"] for r in one.postings.collect()}
    assert (at["aaa"], at["ddd"], at["ggg"]) == (0, 3, 6)
    assert rows(one.extents) == [("", 2, 0, 2), ("Category", 2, 6, 8), ("Citation", 2, 4, 6)]


def test_links_and_dates(spark):
    ix = build(spark, document(0, [], "", [], "", "1\t2"), document(1, [], "", [], "", "2\t 1 \tx\t-3"), document(2, [], "", [], "", "0\t1"))
    assert rows(ix.edges) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1)]
    d = spark.createDataFrame([(t,) for t in ("2015-07-01 08:59:60", "2015-7-1 8:9:6", "2015-07-01 08-59-60", "", "9999-99-99 99:99:99", None)], "t string")
    got = [r[0] for r in d.select(index.timestamp_of("t")).collect()]
    epoch = dt.datetime(1970, 1, 1)
    assert got == [dt.datetime(2015, 7, 1, 9), dt.datetime(2015, 7, 1, 8, 9, 6), epoch, epoch, epoch, epoch]


L = [(0, 1), (0, 3), (3, 42), (7, 2), (7, 5), (8, 5)]
R = [(0, 0), (0, 4), (2, 42), (6, 39), (7, 2)]


def test_merges(spark):
    frame = lambda x: spark.createDataFrame(x, "doc_id long, pos int")
    left, right = frame(L), frame(R)
    assert rows(postings.union(left, right)) == sorted(L + R)
    assert rows(postings.intersect(frame(L[:4]), right)) == [(0, 0), (0, 1), (0, 3), (0, 4), (7, 2), (7, 2)]
    assert rows(postings.difference(left, right)) == [(3, 42), (8, 5)]
    assert rows(postings.distance(left, right, 2)) == [(0, 3), (0, 4), (7, 2)]
    a = frame([(2, 0), (2, 3), (2, 5), (3, 0), (3, 8)])
    b = frame([(2, 1), (2, 4), (2, 6), (3, 1), (3, 7), (3, 9)])
    assert rows(postings.distance(a, b, 1)) == [(2, 0), (2, 1), (2, 3), (2, 4), (2, 5), (2, 6), (3, 0), (3, 1), (3, 8), (3, 9)]
    none = frame([])
    assert rows(postings.union(none, right)) == R
    assert rows(postings.intersect(none, right)) == rows(postings.distance(none, right, 3)) == []
    assert rows(postings.difference(left, none)) == L


def test_queries(spark):
    ix = build(
        spark,
        document(2, [("", "hello world momma")], "hello world", ["hello world"], "ooo ppp"),
        document(3, [("Infobox", "hello world momma")], "fff eee ddd", ["eee world"], "hello world"),
        rank=False,
    )
    assert match(ix, Phrase(("hello", "world", "momma"))) == [(2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert match(ix, Zone("Citation", Free(("hello", "world")))) == [(2, 5), (2, 6), (3, 7)]
    assert match(ix, Zone("infobox", Free(("hello",)))) == [(3, 0)]
    assert match(ix, Zone("Title", Free(("t2",)))) == []
    assert match(ix, Wildcard("e", "e")) == [(3, 4), (3, 6)]
    assert match(ix, Free(("nowhere",))) == []
    assert match(ix, Not(Free(("momma",)))) == [(2, 2), (3, 2)]
    assert {d for d, _ in match(ix, Binary("AND", Free(("world",)), Not(Free(("fff",)))), hard_not=True)} == {2}
    assert match(ix, Distance(2, "fff", "ddd")) == [(3, 3), (3, 5)]
    aa = build(spark, document(1, [], "a b b c a a", [], ""), rank=False)
    assert match(aa, Phrase(("a", "b", "c"))) == []
    assert match(aa, Phrase(("a", "a"))) == [(1, 4), (1, 5)]
    assert {d for d, _ in match(aa, Phrase(("a", "b", "c")), chained=True)} == {1}


def test_properties(spark):
    rng = random.Random(5)
    ix = build(spark, *[document(n, [], " ".join(rng.choice("abcd") for _ in range(12)), [], "") for n in range(40)], rank=False)
    docs = lambda q: {d for d, _ in match(ix, q)}
    a, b = Free(("a",)), Free(("b",))
    assert docs(Phrase(("a", "b"))) <= docs(Distance(1, "a", "b")) <= docs(Binary("AND", a, b)) <= docs(Binary("OR", a, b))


def test_hops(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src long, dst long")
    line = e((0, 1), (1, 2), (2, 3), (3, 4))
    for h in range(1, 6):
        assert dict(rows(graph.k_hop(line, 0, h))) == {k: k for k in range(min(h, 4) + 1)}
    assert dict(rows(graph.k_hop(e((1, 0), (1, 4), (2, 1), (2, 3)), 3, 2))) == {3: 0, 2: 1, 1: 2}
    assert dict(rows(graph.k_hop(e((0, 1), (0, 2), (1, 3), (2, 4)), 0, 2))) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}


def test_page_rank(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(20), rng.randrange(15)) for _ in range(60)]
    got = dict(rows(graph.page_rank(spark.createDataFrame(edges, "src long, dst long"))))
    pages = sorted({d for _, d in edges})
    out = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    pr = dict.fromkeys(pages, 1 / len(pages))
    for _ in range(71):
        new = {p: 0.85 / len(pages) + 0.15 * sum(pr.get(s, 0) / out[s] for s, d in edges if d == p) for p in pages}
        moved = sum(abs(new[p] - pr[p]) for p in pages)
        pr = new
        if moved < 1e-7:
            break
    total = sum(pr.values())
    assert got.keys() == pr.keys()
    assert all(math.isclose(got[p], pr[p] / total, rel_tol=1e-9) for p in pages)


WHALES = [
    document(1, [("", "aaa bbb")], "while this text mentions a whale it is in no way dedicated to aquatic mammals", ["eee fff"], "ggg hhh"),
    document(2, [("", "aaa bbb")], "there once was a big whale who ate a big tuna sandwich", ["eee fff"], "ggg hhh"),
    document(3, [], "something else", [], ""),
]


def test_scores(spark):
    ix = build(spark, *WHALES[:2], rank=False)
    c = Compiler(ix)
    big = (1 + math.log10(2)) * math.log10(2)
    assert dict(rows(c.scored(Free(("big", "whale"))))) == pytest.approx({1: 0, 2: 0.9 * big})
    assert dict(rows(c.scored(Relation(1, 0)))) == {1: 0.0}
    three = Compiler(build(spark, *WHALES, rank=False))
    w = math.log10(3 / 2)
    got = dict(rows(three.scored(Binary("AND", Free(("big",)), Not(Free(("whale",)))))))
    assert got == pytest.approx({2: 0.9 * ((1 + math.log10(2)) * math.log10(3) - 1000 * w)})


def test_suggestions(spark):
    ix = build(spark, document(0, [("infobox", "hello world"), ("infobox2", "hello")], "eggs world", ["this that"], "hello world"), rank=False)
    free = EngineConfig(suggest_frequent_only=False)
    assert suggest(Free(("worldd",)), ix.dictionary, EngineConfig(correction_threshold=2)) == "world"
    assert suggest(Binary("AND", Free(("worlddd",)), Free(("hell",))), ix.dictionary, free) == "world AND hello"
    assert suggest(Free(("",)), ix.dictionary) == ""


def tables(spark, dump=1, extra=()):
    f = lambda data, schema: spark.createDataFrame(data, schema)
    ids = [0, 1, 2, *extra]
    return {
        "article": f([(k, f"Page {k}", "en", 0, f"2020-01-0{9 - k} 00:00:00", dump) for k in ids], schemas.ARTICLE),
        "content": f([(k, "cat", f"about {k}", f"{(k + 1) % 3}", f"whale number{k}" + " tuna" * k) for k in ids], schemas.CONTENT),
        "infoboxes": f([(0, "Ship", "white whale")], schemas.INFOBOXES),
        "citations": f([(0, 2, "second"), (0, 1, "first")], schemas.CITATIONS),
    }


def test_api(spark, tmp_path):
    path = str(tmp_path / "index")
    assert update_index(spark, tables(spark), path)
    assert not update_index(spark, tables(spark), path)
    assert update_index(spark, tables(spark, 2, (3,)), path)
    ix = index.Index.load(spark, path)
    out = search(ix, "tuna", page=1, results_per_page=2)
    # Page 3 has the word most often, but no page links to it
    assert [d["title"] for d in out.documents] == ["Page 2", "Page 3"]
    assert len(search(ix, "tuna", page=2, results_per_page=2).documents) == 1
    assert [d["title"] for d in search(ix, "whale", sort_by="lastedited").documents] == ["Page 3", "Page 2", "Page 1", "Page 0"]
    near = relational(ix, "Page 0", 1)
    assert near.documents[0]["title"] == "Page 0"
    assert {"source": "Page 0", "destination": "Page 1"} in near.relations
    assert [d["hops"] for d in relational(ix, "Page 3", 2, "whale").documents] == [0, 1, 2, 2]
    for bad in (lambda: search(ix, "x" * 300), lambda: search(ix, ""), lambda: search(ix, "a", page=0), lambda: relational(ix, "nobody", 1)):
        with pytest.raises(UserError):
            bad()


def test_assembly_and_repeats(spark):
    docs = articles.assemble(tables(spark))
    first = docs.filter("doc_id = 0").first()
    assert first["citations"] == ["first", "second"]
    assert [b["itype"] for b in first["infoboxes"]] == ["Ship"]
    good, bad = articles.split_valid(docs.unionAll(docs.filter("doc_id = 1")))
    assert (good.count(), bad.count()) == (3, 1)


def test_streaming_refresh(spark, tmp_path):
    from tessera.streaming.refresh import refresh_on_arrival

    source, path = str(tmp_path / "src"), str(tmp_path / "index")
    for name, df in tables(spark, 7).items():
        df.write.parquet(f"{source}/{name}")
    refresh_on_arrival(spark, source, path, str(tmp_path / "ck")).awaitTermination(120)
    assert index.current(spark, path) == 7
