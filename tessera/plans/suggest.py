"""Spelling suggestions: rare words are replaced by near ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions.distance import positional_distance
from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Query, Relation, Zone


def words_of(q: Query) -> Iterator[str]:
    match q:
        case Free() | Phrase():
            yield from q.tokens
        case Distance():
            yield from (q.left, q.right)
        case Zone() | Not():
            yield from words_of(q.sub)
        case Relation() if q.sub is not None:
            yield from words_of(q.sub)
        case Binary():
            yield from words_of(q.left)
            yield from words_of(q.right)


def substitute(q: Query, new: dict[str, str]) -> Query:
    to = lambda w: new.get(w, w)
    match q:
        case Free() | Phrase():
            return replace(q, tokens=tuple(map(to, q.tokens)))
        case Distance():
            return replace(q, left=to(q.left), right=to(q.right))
        case Zone() | Not():
            return replace(q, sub=substitute(q.sub, new))
        case Relation() if q.sub is not None:
            return replace(q, sub=substitute(q.sub, new))
        case Binary():
            return replace(q, left=substitute(q.left, new), right=substitute(q.right, new))
    return q


def corrections(dictionary: DataFrame, words: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """(word, suggestion): for each word, the near token of the least radius, then of the nearest length, then the first.

    One pass over the dictionary for all words; nothing but a row a word and radius leaves a task.
    """
    radii = [config.correction_distance + k * config.correction_distance_step for k in range(config.correction_tries)]
    frequent = F.col("postings_count") >= config.correction_threshold if config.suggest_frequent_only else F.lit(True)
    each = []
    for w in words:
        size = F.abs(F.octet_length("token") - len(w.encode()))
        d = positional_distance(F.col("token"), w)
        radius = F.coalesce(*[F.when(d <= r, F.lit(k)) for k, r in enumerate(radii)])
        near = F.abs(F.length("token") - len(w)) <= radii[-1]
        each.append(F.when(near, F.struct(F.lit(w).alias("word"), radius.alias("radius"), size.cast("int").alias("size"))))
    if not each:
        return dictionary.sparkSession.createDataFrame([], "word string, suggestion string")
    rows = dictionary.filter(frequent).select("token", F.explode(F.array(*each)).alias("c")).filter(F.col("c.radius").isNotNull())
    best = F.min(F.struct("c.radius", "c.size", "token"))
    return rows.groupBy(F.col("c.word").alias("word")).agg(best.alias("b")).select("word", F.col("b.token").alias("suggestion"))


def suggest(q: Query, dictionary: DataFrame, config: EngineConfig = EngineConfig()) -> str:
    """The text of ``q`` with its rare words replaced, or "" if nothing changes."""
    words = sorted({w for w in words_of(q) if w})
    if not words:
        return ""
    known = {r["token"]: r["postings_count"] for r in dictionary.filter(F.col("token").isin(words)).collect()}
    rare = [w for w in words if known.get(w, 0) < config.correction_threshold]
    new = {r["word"]: r["suggestion"] for r in corrections(dictionary, rare, config).collect()} if rare else {}
    after = substitute(q, new)
    return "" if after == q else str(after)
