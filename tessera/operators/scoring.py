"""TF-IDF of queries. A query's score is linear in its terms, so a tree flattens to a coefficient a term, and one join scores all documents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.plans.ast import Binary, Free, Not, Phrase, Query, Relation, Zone


def coefficients(q: Query, config: EngineConfig = EngineConfig(), factor: float = 1.0) -> dict[str, float]:
    """Each term's coefficient: 1 a mention, times the factor of every NOT above it. Distances and wildcards score nothing."""
    out: Counter[str] = Counter()
    match q:
        case Free() | Phrase():
            for t in q.tokens:
                out[t] += factor
        case Binary():
            for side in (q.left, q.right):
                for t, c in coefficients(side, config, factor).items():
                    out[t] += c
        case Not():
            out.update(coefficients(q.sub, config, factor * config.not_factor))
        case Zone():
            out.update(coefficients(q.sub, config, factor))
        case Relation() if q.sub is not None:
            out.update(coefficients(q.sub, config, factor))
    return dict(out)


def text_scores(tf: DataFrame, dictionary: DataFrame, n_docs: int, terms: dict[str, float]) -> DataFrame:
    """(doc_id, text_score): sum of coefficient * (1 + log10 tf) * log10(N / df). The terms are few and reach both scans."""
    if not terms:
        return tf.sparkSession.createDataFrame([], "doc_id long, text_score double")
    weight = F.coalesce(*[F.when(F.col("token") == t, F.lit(float(c))) for t, c in terms.items()])
    idf = dictionary.filter(F.col("token").isin(*terms)).select("token", (F.log10(F.lit(float(n_docs)) / F.col("df")) * weight).alias("w"))
    rows = tf.filter(F.col("token").isin(*terms)).join(F.broadcast(idf), "token")  # a row a term of the query
    return rows.groupBy("doc_id").agg(F.sum((1 + F.log10("tf")) * F.col("w")).alias("text_score"))


def final_scores(docs: DataFrame, text: DataFrame, page_rank: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(doc_id, score) of ``docs``: text and PageRank, mixed."""
    score = F.lit(config.text_weight) * F.coalesce("text_score", F.lit(0.0)) + F.lit(config.rank_weight) * F.coalesce("pr", F.lit(0.0))
    return docs.select("doc_id").distinct().join(text, "doc_id", "left").join(page_rank, "doc_id", "left").select("doc_id", score.alias("score"))
