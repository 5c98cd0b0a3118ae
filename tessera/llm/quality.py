"""Quality rules: thresholds adapt to each language and source, by mergeable quantile sketches.

A sketch is a table of logarithmic bins: a value x > 0 falls in bin ceil(log(x) / log(GAMMA)), so a
quantile is right within 2 %; sketches merge by adding the counts of equal bins. Values are clipped
to [1e-3, 1e6], which bounds a sketch at about 1,050 bins. Sketches of (language, source) are built
with map-side combining and merged upwards into one per language and one of all documents.

Every cutoff is made of quantiles of its group:

- ``rare`` metrics are 0 in most documents; their sketches hold the others (values of LOW or more), and
  the cutoff is a tail quantile of those.
- ``spread`` metrics have the cutoff q75 + width * spread, where the spread is q75 - q25.

Small groups move towards larger ones by degrees, not by a switch: a tail quantile of n values counts
n / (n + PRIOR), that of the language, and then of all documents, the rest. A spread is weighed in the
same way against a quarter of the group's median: how long words are is a language's own matter.

A document is kept if it passes the base rule and no metric is above its cutoff. DataFrame functions
only.

Cases: a null text is the empty text, which fails the base rule; null language or source is a group
of its own; documents without words have ratios of 0; rows that repeat are judged alike; an empty
table gives an empty result; other columns pass through ``filter_quality`` and are not read else.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.bloom import bits_of, n_blocks, test_rows
from tessera.llm.common import cut, lookup_join, split_words, squeezed, whole

GAMMA = 1.02
LOW, HIGH = 1e-3, 1e6
#: metric: (kind, tail quantile or width)
RULES = {
    "symbol_ratio": ("rare", 0.95),  # symbols a word
    "dup_line_ratio": ("rare", 0.99),
    "repeat_ratio": ("rare", 0.99),
    "word_length": ("spread", 6.0),
}
PRIOR = 200  # values
QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
SYMBOLS = "#*$%&|<>"


def _with_repeats(d: DataFrame) -> DataFrame:
    """``d`` with n_repeat_words from ``grams``: the words covered by 5-word windows whose hash occurs twice or more.

    Each array is a column of its own, so that none is made twice; texts in which no window repeats stop at the first.
    """
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    empty = F.array().cast("array<struct<g:bigint,i:int>>")
    d = d.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(empty)).drop("grams")
    o = F.col("ordered")
    equal = lambda k, by: F.coalesce(F.get(o, k)["g"] == F.get(o, k + by)["g"], F.lit(False))
    at = F.filter(F.transform(o, lambda x, k: F.when(equal(k, -1) | equal(k, 1), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("at", F.when(F.size(o) == 0, F.array().cast("array<int>")).otherwise(F.sort_array(at))).drop("ordered")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("at", start, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return d.withColumn("n_repeat_words", covered).drop("at")


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A struct ``row`` of all columns of ``docs``, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    text = whole(F.col(f"row.{text_col}"))
    d = docs.select(F.struct("*").alias("row")).withColumn("words", F.filter(split_words(text), lambda w: w != ""))
    w = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        squeezed(text).alias("chars"),
        lines.alias("lines"),
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    bare = F.col("chars")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    ln = F.col("lines")
    d = _with_repeats(d.select(
        "row", "n_words", "grams",
        F.length("chars").cast("long").alias("word_chars"),
        (F.length("chars") - F.length(bare)).cast("long").alias("n_symbols"),
        F.size(ln).alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
    ))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "n_words").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"), per("word_chars", "n_words").alias("word_length"),
    )


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """A quantile sketch of each metric and group: rows (group, metric, bin, n); values below LOW are left out."""
    binned = lambda m: F.when(F.col(m) >= LOW, F.ceil(F.log(F.least(F.col(m), F.lit(HIGH))) / math.log(GAMMA)).cast("int"))
    bins = [F.struct(F.lit(m).alias("metric"), binned(m).alias("bin")) for m in RULES]
    return measured.select(*group, F.explode(F.array(*bins)).alias("b")).filter("b.bin is not null").groupBy(*group, "b.metric", "b.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of larger groups."""
    return sketch.groupBy(*group, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Rows (group, metric, n, q0, q1, ...)."""
    by = W.partitionBy(*group, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("of", F.sum("n").over(by))
    value = F.pow(F.lit(GAMMA), F.col("bin"))
    return ranked.groupBy(*group, "metric").agg(F.max("of").alias("n"), *[F.min(F.when(F.col("upto") >= q * F.col("of"), value)).alias(f"q{k}") for k, q in enumerate(qs)])


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per (language, source): the cutoff of each metric, null where neither it nor all documents have a value."""
    fine = cut(sketches(measured, [lang, source]))
    by_lang = cut(merged(fine, [lang]))
    named = lambda d, keys, name: quantiles(d, keys).select(*keys, "metric", F.struct("n", *[f"q{k}" for k in range(len(QUANTILES))]).alias(name))
    groups = cut(measured.groupBy(lang, source).agg(F.count("*").alias("rows"))).select(lang, source, F.explode(F.array(*map(F.lit, RULES))).alias("metric"))
    a = named(fine, [lang, source], "a").withColumnsRenamed({lang: "lang_a", source: "source_a", "metric": "metric_a"})
    b = named(by_lang, [lang], "b").withColumnsRenamed({lang: "lang_b", "metric": "metric_b"})
    c = named(merged(by_lang, []), [], "c").withColumnRenamed("metric", "metric_c")
    rows = groups.join(a, F.col(lang).eqNullSafe(F.col("lang_a")) & F.col(source).eqNullSafe(F.col("source_a")) & (F.col("metric") == F.col("metric_a")), "left")
    rows = rows.join(b, F.col(lang).eqNullSafe(F.col("lang_b")) & (F.col("metric") == F.col("metric_b")), "left").join(c, F.col("metric") == F.col("metric_c"), "left")

    def pulled(own: Column, n: Column, towards: Column) -> Column:
        """``own``, of ``n`` values, and ``towards`` for the rest; either alone if the other is null."""
        return F.coalesce((n * own + F.lit(prior) * towards) / (n + prior), own, towards)

    def cutoff(metric: str) -> Column:
        kind, x = RULES[metric]
        if kind == "rare":
            q = f"q{QUANTILES.index(x)}"
            language = pulled(F.col(f"b.{q}"), F.col("b.n"), F.col(f"c.{q}"))
            return pulled(F.col(f"a.{q}"), F.col("a.n"), language)
        spread = lambda s: (F.col(f"{s}.n") * (F.col(f"{s}.q2") - F.col(f"{s}.q0")) + prior * F.col(f"{s}.q1") / 4) / (F.col(f"{s}.n") + prior)
        fence = lambda s: F.col(f"{s}.q2") + x * spread(s)
        return pulled(fence("a"), F.col("a.n"), fence("b"))

    return rows.groupBy(lang, source).agg(*[F.max(F.when(F.col("metric") == m, cutoff(m))).alias(f"max_{m}") for m in RULES])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", prior: int = PRIOR) -> DataFrame:
    """Each document's id, mark, metrics, base_failed and kept. Documents of one mark are judged alike."""
    named = {"lang": F.col(f"row.{lang_col}"), "source": F.col(f"row.{source_col}"), "id": F.col(f"row.{id_col}")}
    m = with_metrics(docs, text_col).withColumns(named | {"mark": _mark(lambda c: F.col(f"row.{c}"), lang_col, source_col, text_col)})
    narrow = cut(m.drop("row"))
    d = lookup_join(narrow, cut(thresholds(narrow, prior=prior)), ["lang", "source"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passes = F.lit(True)
    for name in RULES:
        passes = passes & F.coalesce(F.col(name) <= F.col(f"max_{name}"), F.lit(True))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)


def _mark(column: Callable[[str], Column], *names: str) -> Column:
    """128 bits of all that a verdict depends on."""
    columns = [column(c) for c in names]
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("again"), *columns).alias("y"))


def quality_report(docs: DataFrame, **names: str) -> DataFrame:
    """One row per document: id, n_words, the four counts, base_failed, kept and the ratios."""
    d = judged(docs, **names)
    return d.select(F.col("id").alias(names.get("id_col", "doc_id")), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES)


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", prior: int = PRIOR) -> DataFrame:
    """The kept rows of ``docs``, its columns unchanged.

    Rows are measured once. The marks of rejected ones come back to the rows by a Bloom filter of
    bounded size, so that only rejected rows, and a few more, shuffle.
    """
    rejected = cut(judged(docs, text_col, lang_col, source_col, id_col, prior).filter(~F.col("kept")).select("mark.x", "mark.y").distinct())
    blocks = n_blocks(max(1, rejected.count()))
    rows = docs.select(F.struct("*").alias("row"), _mark(F.col, lang_col, source_col, text_col).alias("mark")).withColumn("h", F.col("mark.x"))
    tested = test_rows(rows, bits_of(rejected.select("x"), "x", blocks), "h", blocks)
    spared = tested.filter("maybe").join(rejected.hint("merge"), (F.col("mark.x") == F.col("x")) & (F.col("mark.y") == F.col("y")), "left_anti")
    return tested.filter(~F.col("maybe")).select("row.*").unionByName(spared.select("row.*"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, len(w) - 3)) AS u(i))
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM grams, range(5) AS r(k) WHERE times > 1 GROUP BY rid
), counts AS (
  SELECT t.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN repeated USING (rid)
), m AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_ratio, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length FROM counts
), long AS (
  UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, repeat_ratio, word_length FROM m) ON symbol_ratio, dup_line_ratio, repeat_ratio, word_length INTO NAME metric VALUE x
), bins AS (
  SELECT lang, source, metric, ceil(ln(least(x, 1e6)) / ln(1.02))::INT AS bin FROM long WHERE x >= 1e-3
), levels AS (
  SELECT 'a' AS level, lang, source, metric, bin FROM bins UNION ALL SELECT 'b', lang, NULL, metric, bin FROM bins UNION ALL SELECT 'c', NULL, NULL, metric, bin FROM bins
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS k, count(*) OVER (PARTITION BY level, lang, source, metric) AS n FROM levels
), q AS (
  SELECT level, lang, source, metric, max(n) AS n, pow(1.02, min(bin) FILTER (k >= 0.25 * n)) AS q25, pow(1.02, min(bin) FILTER (k >= 0.5 * n)) AS q50, pow(1.02, min(bin) FILTER (k >= 0.75 * n)) AS q75,
    pow(1.02, min(bin) FILTER (k >= 0.95 * n)) AS q95, pow(1.02, min(bin) FILTER (k >= 0.99 * n)) AS q99
  FROM ranked GROUP BY ALL
), own AS (
  SELECT *, CASE metric WHEN 'symbol_ratio' THEN q95 WHEN 'word_length' THEN q75 + 6.0 * (n * (q75 - q25) + 200 * q50 / 4) / (n + 200) ELSE q99 END AS c FROM q
), groups AS (
  SELECT DISTINCT lang, source, metric FROM m, (VALUES ('symbol_ratio'), ('dup_line_ratio'), ('repeat_ratio'), ('word_length')) AS v(metric)
), cutoffs AS (
  SELECT g.lang, g.source, g.metric, coalesce((a.n * a.c + 200 * bc) / (a.n + 200), a.c, bc) AS most
  FROM (SELECT g.*, CASE WHEN g.metric = 'word_length' THEN b.c ELSE coalesce((b.n * b.c + 200 * c.c) / (b.n + 200), b.c, c.c) END AS bc
    FROM groups g LEFT JOIN own b ON b.level = 'b' AND b.metric = g.metric AND b.lang IS NOT DISTINCT FROM g.lang LEFT JOIN own c ON c.level = 'c' AND c.metric = g.metric) g
  LEFT JOIN own a ON a.level = 'a' AND a.metric = g.metric AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source
), limits AS (
  SELECT lang, source, max(most) FILTER (metric = 'symbol_ratio') AS s, max(most) FILTER (metric = 'dup_line_ratio') AS d, max(most) FILTER (metric = 'repeat_ratio') AS r, max(most) FILTER (metric = 'word_length') AS l
  FROM cutoffs GROUP BY lang, source
), judged AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(symbol_ratio <= s, true) AND coalesce(dup_line_ratio <= d, true) AND coalesce(repeat_ratio <= r, true) AND coalesce(word_length <= l, true) AS passes
  FROM m JOIN limits x ON m.lang IS NOT DISTINCT FROM x.lang AND m.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept, symbol_ratio, dup_line_ratio, repeat_ratio, word_length FROM judged
"""
