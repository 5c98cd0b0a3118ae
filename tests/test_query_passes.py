"""Queries make links and the tokens of texts once."""

import pytest

from tessera.plans import queries
from tessera.sources import corpus
from tests.test_passes import SF, counted


@pytest.mark.parametrize("name", ["search_full", "suggest_tree", "tfidf_topk", "not_soft"])
def test_texts_are_read_once(spark, monkeypatch, name):
    expected = sorted(map(tuple, queries.queries()[name](spark, SF).collect()))
    docs, seen = counted(corpus.documents(spark, SF), "main_text")
    monkeypatch.setattr(corpus, "documents", lambda *_: docs)
    assert sorted(map(tuple, queries.queries()[name](spark, SF).collect())) == expected
    assert seen.value == docs.count() > 100


@pytest.mark.parametrize("name", ["search_full", "relation_search", "relation_text", "relation_postings", "khop", "pagerank", "relational_subgraph", "relational_limit"])
def test_links_are_made_once(spark, monkeypatch, name):
    edges, seen = counted(corpus.edges(spark, SF), "dst")
    n = edges.count()
    monkeypatch.setattr(corpus, "edges", lambda *_: edges)
    before = seen.value
    assert queries.queries()[name](spark, SF).count() > 0
    assert seen.value - before == n > 100
