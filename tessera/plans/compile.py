"""From a query's tree to one plan over the index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import graph, postings, scoring
from tessera.operators.index import Index
from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Query, Relation, Wildcard, Zone


@dataclass(frozen=True)
class Compiler:
    """``hard_not``: NOT excludes; else it passes postings on and only the score falls. ``chained``: the looser phrase."""

    index: Index
    config: EngineConfig = field(default_factory=EngineConfig)
    hard_not: bool = False
    chained: bool = False

    def postings(self, q: Query) -> DataFrame:
        """The postings (doc_id, pos) that match ``q``."""
        p = self.index.postings
        match q:
            case Free(tokens=()):
                return p.filter(F.lit(False)).select("doc_id", "pos")
            case Free():
                return postings.free(p, q.tokens)
            case Phrase():
                if len(q.tokens) < 2:
                    return self.postings(Free(q.tokens))
                return (postings.phrase_chained if self.chained else postings.phrase)(p, q.tokens)
            case Distance():
                return postings.distance(postings.term(p, q.left), postings.term(p, q.right), q.distance)
            case Wildcard():
                return postings.wildcard(p, q.prefix, q.suffix)
            case Zone():
                return postings.zone(self.postings(q.sub), self.index.extents, q.elem)
            case Not():
                if self.hard_not:
                    all_docs = self.index.docs.select("doc_id", F.lit(0).alias("pos"))
                    return postings.difference(all_docs, self.postings(q.sub))
                return self.postings(q.sub)
            case Relation():
                hops = graph.k_hop(self.index.edges, q.root, q.hops, self.config)
                if q.sub is None:
                    return hops.select("doc_id", F.col("hops").alias("pos"))
                return postings.within(self.postings(q.sub), hops)
            case Binary(op="AND"):
                if self.hard_not and isinstance(q.right, Not):
                    return postings.difference(self.postings(q.left), self.postings(q.right.sub))
                return postings.intersect(self.postings(q.left), self.postings(q.right))
            case Binary():
                return postings.union(self.postings(q.left), self.postings(q.right))
        raise TypeError(q)

    def scored(self, q: Query, n_docs: int | None = None) -> DataFrame:
        """(doc_id, score) of all documents that match ``q``."""
        n = self.index.docs.count() if n_docs is None else n_docs
        text = scoring.text_scores(self.index.tf, self.index.dictionary, n, scoring.coefficients(q, self.config))
        return scoring.final_scores(self.postings(q), text, self.index.page_rank, self.config)

    def related(self, q: Query) -> DataFrame:
        """(doc_id, hops, score) of a relation query's documents, scored by PageRank; nothing for other queries."""
        none = self.index.docs.sparkSession.createDataFrame([], "doc_id long, hops int, score double")
        if not isinstance(q, Relation):
            return none
        hops = graph.k_hop(self.index.edges, q.root, q.hops, self.config)
        if q.sub is not None:
            hops = hops.join(self.postings(q.sub).select("doc_id").distinct(), "doc_id", "left_semi")
        return hops.join(self.index.page_rank, "doc_id", "left").select("doc_id", "hops", F.coalesce("pr", F.lit(0.0)).alias("score"))


def top(scored: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of results, best first, ties by id."""
    return scored.orderBy(F.desc("score"), "doc_id").offset(size * (page - 1)).limit(size)


def last_edited(docs: DataFrame, matching: DataFrame, page: int = 1, size: int = 20, descending: bool = False) -> DataFrame:
    """A page of results by date, oldest first unless ``descending``; all score 1."""
    order = F.col("last_updated").desc() if descending else F.col("last_updated").asc()
    rows = docs.join(matching.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.orderBy(order, "doc_id").offset(size * (page - 1)).limit(size).select("doc_id", "last_updated", F.lit(1.0).alias("score"))
