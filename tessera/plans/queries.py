"""The engine's queries on the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import update_index
from tessera.config import EngineConfig
from tessera.functions.distance import positional_distance
from tessera.functions.normalise import normalise
from tessera.operators import graph, index, postings, scoring
from tessera.operators.tools import discard, forget, kept, scratch
from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Relation, Wildcard, Zone
from tessera.plans.compile import Compiler, last_edited, top
from tessera.plans.parser import parse
from tessera.plans.suggest import corrections, suggest, words_of
from tessera.sources import articles, corpus

Query = Callable[[SparkSession, str], DataFrame]
RANK_STEPS = 8


def _index(spark: SparkSession, sf_dir: str, rank: bool = False) -> index.Index:
    """The index as a lazy plan: each query computes what it reads."""
    return index.build(corpus.documents(spark, sf_dir), edges=corpus.edges(spark, sf_dir), rank=rank)


def _linked(spark: SparkSession, sf_dir: str, rank: bool = True) -> index.Index:
    """The same with its links kept, as rounds and steps read them again, and their PageRank."""
    ix = replace(_index(spark, sf_dir), edges=kept(corpus.edges(spark, sf_dir)))
    return replace(ix, page_rank=graph.page_rank(ix.edges, iterations=RANK_STEPS, converge=False)) if rank else ix


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dictionary_of_documents(corpus.documents(spark, sf_dir))


def _compiled(q, **options) -> Query:
    return lambda spark, sf_dir: Compiler(_index(spark, sf_dir), **options).postings(q)


def _root(edges: DataFrame) -> int:
    return edges.agg(F.min("src")).first()[0]


def _khop(hops: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = kept(corpus.edges(spark, sf_dir))
        return graph.k_hop(e, _root(e), hops)

    return run


def _page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kept(corpus.edges(spark, sf_dir))
    ranks = graph.page_rank(e, iterations=RANK_STEPS, converge=False)
    forget(e)
    return ranks.select("doc_id", F.round("pr", 9).alias("pr"))


def _tfidf(q) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = Compiler(index.only(_index(spark, sf_dir), words_of(q))).scored(q)
        return top(scored.select("doc_id", F.round("score", 6).alias("score")))

    return run


def _search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and PageRank mixed, with titles. PageRank is that of the link graph, whose ids overlap those of documents."""
    q = Free(("the", "of", "and"))
    ix = index.only(_linked(spark, sf_dir), q.tokens)
    best = top(Compiler(ix).scored(q).select("doc_id", F.round("score", 6).alias("score")))
    return ix.docs.join(F.broadcast(best), "doc_id").select("doc_id", "title", "abstract", "score")


def _last_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _index(spark, sf_dir)
    return last_edited(ix.docs, postings.term(ix.postings, "the"), page=2, size=10).select("doc_id", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "score")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kept(corpus.edges(spark, sf_dir))
    near = graph.k_hop(e, _root(e), 2).orderBy("hops", "doc_id").limit(150)
    return graph.induced(e, near.select("doc_id", F.concat(F.lit("page"), "doc_id").alias("title")))


def _relation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _linked(spark, sf_dir)
    return Compiler(ix).related(Relation(_root(ix.edges), 3)).select("doc_id", "hops", F.round("score", 9).alias("score"))


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections(_dictionary(spark, sf_dir), ["thee", "annd", "offf", "dxr"], EngineConfig(correction_threshold=20))


def _neighbour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionary(spark, sf_dir).select("token", positional_distance(F.col("token"), "that").alias("distance"))
    return d.filter("distance <= 2")


DIST = Distance(3, "the", "of")
OR = Binary("OR", Free(("the",)), Free(("der",)))
AND = Binary("AND", Free(("the",)), Free(("of",)))


#: Query texts, with the trees that they stand for after normalising.
TEXTS = {
    "text_and": "de AND la",
    "text_or": "de OR the la",
    "text_phrase": '"de la"',
    "text_distance": "#DIST,3,de,la",
    "text_zone": "#category, en",
    "text_wildcard": "d*r",
    "text_nested": "der OR de AND la",
    "text_not": "de AND NOT la",
}
#: Texts and what their trees read like: operators of any case, zones by name, words lowered, stemmed, without stop words.
READINGS = [
    ("Cats AND the running dogs", "cat AND run dog"),
    ('"The databases"', "databas"),
    ('"The relational databases"', '"relat databas"'),
    ('"steam engines of the north"', '"steam engin north"'),
    ("#CITATION, Ponies", "#CITATION, poni"),
    ("#DIST,2,Hopping,Ponies", "#DIST,2,hop,poni"),
    ("NOT caresses", "NOT caress"),
    ("ca*s", "ca*s"),
    ("#LINKSTO 5,2,Trees", "#LINKSTO 5,2,tree"),
]


def _text(text: str) -> Query:
    return lambda spark, sf_dir: Compiler(_index(spark, sf_dir)).postings(normalise(parse(text)))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, their normalised trees as text, and whether that text parses to the same tree."""
    rows = []
    for text, _ in READINGS:
        q = normalise(parse(text))
        rows.append((text, str(q), parse(str(q)) == q))
    return spark.createDataFrame(rows, "text string, reading string, parses_back boolean")


def _suggest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words of a whole tree are replaced, frequent ones stay."""
    q = Binary("AND", Free(("thee", "the")), Not(Phrase(("annd", "offf"))))
    return spark.createDataFrame([(str(q), suggest(q, kept(_dictionary(spark, sf_dir)), EngineConfig(correction_threshold=20)))], "text string, suggestion string")


def _related_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation with a query in it: pages near the root that hold a word, by PageRank."""
    ix = _linked(spark, sf_dir)
    return Compiler(ix).related(Relation(_root(ix.edges), 2, Free(("der",)))).select("doc_id", "hops", F.round("score", 9).alias("score"))


def _related_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = _linked(spark, sf_dir, rank=False)
    return Compiler(ix).postings(Relation(_root(ix.edges), 2, Free(("der", "la"))))


def _relational_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest 60 pages, of many more."""
    e = kept(corpus.edges(spark, sf_dir))
    return graph.k_hop(e, _root(e), 2).orderBy("hops", "doc_id").limit(60)


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = articles.assemble(corpus.store(spark, sf_dir))
    boxes = F.concat_ws("|", F.transform("infoboxes", lambda b: F.concat(b["itype"], F.lit("="), b["text"])))
    return d.select("doc_id", "title", "abstract", "categories", "last_updated", F.md5("main_text").alias("main_md5"), "links", boxes.alias("infoboxes"), F.size("citations").alias("n_citations"), F.md5(F.concat_ws("|", "citations")).alias("citations_md5"))


def _split(good: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus.crowded(spark, sf_dir, articles.assemble(corpus.store(spark, sf_dir)))
        accepted, rejected = articles.split_valid(docs)
        return accepted.select("doc_id", "title") if good else rejected.select("doc_id", "title", "reason")

    return run


def _store_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.assemble(corpus.store(spark, sf_dir))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built from the store, saved, and loaded again: a second call finds nothing new."""
    path = scratch(spark, "index")
    store = corpus.store(spark, sf_dir)
    first, second = update_index(spark, store, path), update_index(spark, store, path)
    ix = index.Index.load(spark, path)
    counts = [ix.docs.count(), ix.postings.count(), ix.tf.count(), ix.dictionary.count(), ix.extents.count(), ix.edges.count()]
    row = spark.createDataFrame([(first, second, index.current(spark, path), *counts)], "built boolean, built_again boolean, dump_id long, docs long, postings long, tf long, tokens long, extents long, links long")
    discard(spark, path)
    return row


def queries() -> dict[str, Query]:
    on_index = lambda f: lambda spark, sf_dir: f(_index(spark, sf_dir))
    return {
        "postings": on_index(lambda x: x.postings),
        "tf": on_index(lambda x: x.tf),
        "dictionary": _dictionary,
        "extents": on_index(lambda x: x.extents),
        "docs": on_index(lambda x: x.docs.select("doc_id", "title", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))),
        "freetext": _compiled(Free(("the", "der", "la"))),
        "freetext_repeated": _compiled(Free(("der", "der", "nowhere"))),
        "or_postings": _compiled(OR),
        "and_postings": _compiled(AND),
        "and_docs": on_index(lambda x: postings.intersect_docs(postings.term(x.postings, "the"), postings.term(x.postings, "of"))),
        "difference": on_index(lambda x: postings.difference(postings.term(x.postings, "the"), postings.term(x.postings, "of"))),
        "distance": _compiled(DIST),
        "phrase2": _compiled(Phrase(("of", "the"))),
        "phrase3": _compiled(Phrase(("anea.", "Eriner", "thanea."))),
        "wildcard": _compiled(Wildcard("th", "")),
        "wildcard_mid": _compiled(Wildcard("e", ".")),
        "zone_category": _compiled(Zone("Category", Free(("en", "fr")))),
        "zone_citation": _compiled(Zone("Citation", Free(("the", "of")))),
        "zone_infobox": _compiled(Zone("lead", Free(("the", "der")))),
        "not_soft": _tfidf(Binary("AND", Free(("the",)), Not(Free(("of",))))),
        "not_hard": _compiled(Binary("AND", Free(("the",)), Not(Free(("of",)))), hard_not=True),
        "tfidf_topk": _tfidf(Free(("the", "of", "and"))),
        "last_edited_page": _last_edited,
        "backlinks": lambda spark, sf_dir: corpus.edges(spark, sf_dir).select(F.col("dst").alias("doc_id"), F.col("src").alias("linked_from")),
        "neighbours": lambda spark, sf_dir: graph.neighbours(corpus.edges(spark, sf_dir)),
        "khop": _khop(3),
        "pagerank": _page_rank,
        "relation_search": _relation_search,
        "relational_subgraph": _related,
        "suggest": _suggest,
        "neighbour_match": _neighbour_match,
        "search_full": _search_full,
        **{name: _text(text) for name, text in TEXTS.items()},
        "query_readings": _readings,
        "suggest_tree": _suggest_tree,
        "relation_text": _related_text,
        "relation_postings": _related_postings,
        "relational_limit": _relational_limit,
        "store_version": lambda spark, sf_dir: spark.createDataFrame([(articles.dump_id(corpus.store(spark, sf_dir)["article"]),)], "dump_id long"),
        "assembled": _assembled,
        "accepted": _split(True),
        "rejected": _split(False),
        "parsed_links": lambda spark, sf_dir: index.edges_of(_store_docs(spark, sf_dir)),
        "parsed_dates": lambda spark, sf_dir: _store_docs(spark, sf_dir).select("doc_id", F.date_format(index.timestamp_of("last_updated"), "yyyy-MM-dd HH:mm:ss").alias("last_updated")),
        "root_lookup": on_index(lambda x: x.docs.filter(F.col("title") == "doc5").select("doc_id", "title", "abstract")),
        "rebuilt": _rebuilt,
    }


_SEG = r"""
seg0 AS (
  SELECT doc_id, lang, source, translate(coalesce(text, ''), chr(10) || chr(9), '  ') AS flat, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), seg AS (
  SELECT doc_id, 0 AS ord, 'lead' AS elem, translate(lines[1], chr(9), ' ') AS text FROM seg0
  UNION ALL SELECT doc_id, 1, NULL, flat FROM seg0
  UNION ALL SELECT doc_id, 2, 'Citation', translate(lines[-1], chr(9), ' ') FROM seg0 WHERE len(lines) >= 2
  UNION ALL SELECT doc_id, 3, 'Category', concat_ws(' ', lang, source) FROM seg0
), toks AS (
  SELECT doc_id, ord, elem, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM seg
), placed AS (
  SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM toks
), postings AS (
  SELECT unnest(t) AS token, doc_id, CAST(start + generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM placed
), extents AS (
  SELECT elem, doc_id, CAST(min(start) AS INTEGER) AS start_pos, CAST(max(start + len(t)) AS INTEGER) AS end_pos FROM placed WHERE elem IS NOT NULL GROUP BY ALL
), tf AS (
  SELECT token, doc_id, count(*) AS tf FROM postings GROUP BY ALL
), dictionary AS (
  SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS postings_count FROM tf GROUP BY token
)"""
_EDGES = """
edges AS (
  SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst FROM lineitem WHERE l_linenumber % 2 = 1
  UNION ALL SELECT * FROM (SELECT DISTINCT l_suppkey + 10000000 AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber % 2 = 0)
), both_ways AS (
  SELECT src AS doc_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges
)"""


def _index_sql(body: str, more: str = "") -> str:
    return f"WITH {_SEG}{more} {body}"


def _edge_sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_EDGES}{more} {body}"


def _hop_sql(hops: int) -> str:
    return f""", walk(doc_id, hops) AS (
  SELECT min(src), 0 FROM edges
  UNION SELECT b.other, w.hops + 1 FROM walk w JOIN both_ways b USING (doc_id) WHERE w.hops < {hops}
), khop AS (SELECT doc_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY doc_id)"""


def _rank_sql() -> str:
    d = EngineConfig().teleport
    out = """, pages AS (SELECT DISTINCT dst AS doc_id FROM edges), n AS (SELECT count(*) AS n FROM pages),
deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
links AS (SELECT e.src, e.dst, 1.0::DOUBLE / deg AS share FROM edges e JOIN deg USING (src) SEMI JOIN pages ON e.src = pages.doc_id),
r0 AS (SELECT doc_id, 1.0::DOUBLE / n AS pr FROM pages, n)"""
    for k in range(1, RANK_STEPS + 1):
        out += f""",
r{k} AS (SELECT doc_id, {d} / n + (1 - {d}) * coalesce(got, 0) AS pr FROM r{k - 1} CROSS JOIN n LEFT JOIN (SELECT dst, sum(pr * share) AS got FROM links JOIN r{k - 1} ON src = doc_id GROUP BY dst) g ON g.dst = doc_id)"""
    return out + f""",
page_rank AS (SELECT doc_id, pr / (SELECT sum(pr) FROM r{RANK_STEPS}) AS pr FROM r{RANK_STEPS})"""


def _in(*tokens: str) -> str:
    return ", ".join(f"'{t}'" for t in tokens)


def _and_sql(a: str, b: str) -> str:
    side = lambda t: f"(SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM postings WHERE token = '{t}')"
    return f", pairs AS (SELECT l.doc_id, l.pos AS p, r.pos AS q FROM {side(a)} l JOIN {side(b)} r USING (doc_id, rn))"


def _tfidf_sql(terms: dict[str, float], matching: str, rank: str = "0.0", join: str = "") -> str:
    weights = ", ".join(f"('{t}', {c})" for t, c in terms.items())
    return f"""SELECT doc_id, round(0.9 * coalesce(s, 0) + 0.1 * {rank}, 6) AS score FROM (SELECT DISTINCT doc_id FROM {matching}) m
LEFT JOIN (SELECT doc_id, sum((1 + log10(tf)) * log10((SELECT count(*) FROM documents)::DOUBLE / df) * c) AS s
  FROM tf JOIN dictionary USING (token) JOIN (VALUES {weights}) w(token, c) USING (token) GROUP BY doc_id) t USING (doc_id) {join}
ORDER BY score DESC, doc_id LIMIT 20"""


_STORE = r"""
marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
boxed AS (SELECT doc_id, string_agg('Quality' || quality || '=toxic ' || toxic, '|' ORDER BY quality, toxic) AS boxes FROM labels GROUP BY doc_id),
store AS (
  SELECT doc_id, 'doc' || doc_id AS title, substr(text, 1, 20) AS abstract, source AS categories, text, string_split(text, chr(10)) AS lines, boxes,
    concat_ws(chr(9), doc_id + 1, 'x', ' ' || doc_id * 2 || ' ', '-3', '99999999999', '', doc_id + 1) AS links,
    CASE doc_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-1-' || (doc_id % 28 + 1) || ' 3:4:5' WHEN 2 THEN '2016-12-31 23:59:60' WHEN 3 THEN NULL ELSE '2023-02-' || lpad((doc_id % 40 + 1)::VARCHAR, 2, '0') || ' 00:00:00' END AS last_updated
  FROM documents LEFT JOIN boxed USING (doc_id) WHERE text IS NOT NULL
)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _text_sql(some: Callable[..., str]) -> dict[str, str]:
    """The SQL of the query texts, by their tokens."""
    both = "SELECT doc_id, p AS pos FROM pairs UNION ALL SELECT doc_id, q FROM pairs"
    return {
        "text_and": _index_sql(both, _and_sql("de", "la")),
        "text_or": _index_sql(f"SELECT doc_id, pos FROM {some('de')} UNION ALL SELECT doc_id, pos FROM {some('la')}"),
        "text_phrase": _index_sql(f"SELECT DISTINCT doc_id, unnest([a.pos, b.pos]) AS pos FROM {some('de')} a JOIN {some('la')} b USING (doc_id) WHERE b.pos = a.pos + 1"),
        "text_distance": _index_sql(f"SELECT DISTINCT doc_id, unnest([a.pos, b.pos]) AS pos FROM {some('de')} a JOIN {some('la')} b USING (doc_id) WHERE b.pos - a.pos BETWEEN 0 AND 3"),
        "text_zone": _index_sql(f"SELECT p.doc_id, p.pos FROM {some('en')} p JOIN extents e ON e.elem = 'Category' AND e.doc_id = p.doc_id AND p.pos >= start_pos AND p.pos < end_pos"),
        "text_wildcard": _index_sql("SELECT doc_id, pos FROM postings WHERE token LIKE 'd_r'"),
        # AND binds looser than OR
        "text_nested": _index_sql("SELECT doc_id, p AS pos FROM pairs UNION ALL SELECT doc_id, q FROM pairs", _and_sql("der", "la").replace("token = 'der'", "token IN ('der', 'de')")),
        "text_not": _index_sql(both, _and_sql("de", "la")),
    }


def oracle_sql() -> dict[str, str]:
    some = lambda *tokens: f"(SELECT * FROM postings WHERE token IN ({_in(*tokens)}))"
    zone = lambda elem, *tokens: _index_sql(f"SELECT p.doc_id, p.pos FROM {some(*tokens)} p JOIN extents e ON e.elem = '{elem}' AND e.doc_id = p.doc_id AND p.pos >= start_pos AND p.pos < end_pos")
    phrase = lambda *tokens: _index_sql(
        "SELECT DISTINCT p0.doc_id, CAST(p0.pos + k AS INTEGER) AS pos FROM " + " ".join(f"{'JOIN' if k else ''} {some(t)} p{k} {f'ON p{k}.doc_id = p0.doc_id AND p{k}.pos = p0.pos + {k}' if k else ''}" for k, t in enumerate(tokens)) + f", range({len(tokens)}) r(k)"
    )
    near = lambda a, b: f"(SELECT count(*) FROM range(greatest(length({a}), length({b}))) i(i) WHERE substr({a}, CAST(i + 1 AS BIGINT), 1) <> substr({b}, CAST(i + 1 AS BIGINT), 1))"
    words = "(VALUES ('thee'), ('annd'), ('offf'), ('dxr')) w(word)"
    full_text = scoring.coefficients(Free(("the", "of", "and")))
    soft = scoring.coefficients(Binary("AND", Free(("the",)), Not(Free(("of",)))))
    return {
        "postings": _index_sql("SELECT token, doc_id, pos FROM postings"),
        "tf": _index_sql("SELECT token, doc_id, tf FROM tf"),
        "dictionary": _index_sql("SELECT * FROM dictionary"),
        "extents": _index_sql("SELECT elem, doc_id, start_pos, end_pos FROM extents"),
        "docs": "SELECT doc_id, 'doc' || doc_id AS title, strftime(make_timestamp(doc_id * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') AS last_updated FROM documents",
        "freetext": _index_sql(f"SELECT doc_id, pos FROM {some('the', 'der', 'la')}"),
        "freetext_repeated": _index_sql(f"SELECT doc_id, pos FROM {some('der')}, range(2)"),
        "or_postings": _index_sql(f"SELECT doc_id, pos FROM {some('the')} UNION ALL SELECT doc_id, pos FROM {some('der')}"),
        "and_postings": _index_sql("SELECT doc_id, p AS pos FROM pairs UNION ALL SELECT doc_id, q FROM pairs", _and_sql("the", "of")),
        "and_docs": _index_sql(f"SELECT doc_id FROM {some('the')} INTERSECT SELECT doc_id FROM {some('of')}"),
        "difference": _index_sql(f"SELECT doc_id, pos FROM {some('the')} WHERE doc_id NOT IN (SELECT doc_id FROM {some('of')})"),
        "distance": _index_sql(f"SELECT doc_id, unnest([l.pos, r.pos]) AS pos FROM {some('the')} l JOIN {some('of')} r USING (doc_id) WHERE r.pos - l.pos BETWEEN 0 AND 3").replace("SELECT doc_id, unnest([l.pos", "SELECT DISTINCT doc_id, unnest([l.pos"),
        "phrase2": phrase("of", "the"),
        "phrase3": phrase("anea.", "Eriner", "thanea."),
        "wildcard": _index_sql("SELECT doc_id, pos FROM postings WHERE token LIKE 'th_'"),
        "wildcard_mid": _index_sql("SELECT doc_id, pos FROM postings WHERE token LIKE 'e_.'"),
        "zone_category": zone("Category", "en", "fr"),
        "zone_citation": zone("Citation", "the", "of"),
        "zone_infobox": zone("lead", "the", "der"),
        "not_soft": _index_sql(_tfidf_sql(soft, "pairs"), _and_sql("the", "of")),
        "not_hard": _index_sql(f"SELECT doc_id, pos FROM {some('the')} WHERE doc_id NOT IN (SELECT doc_id FROM {some('of')})"),
        "tfidf_topk": _index_sql(_tfidf_sql(full_text, some("the", "of", "and"))),
        "last_edited_page": _index_sql(f"SELECT doc_id, strftime(make_timestamp(doc_id * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') AS last_updated, 1.0::DOUBLE AS score FROM documents SEMI JOIN {some('the')} p USING (doc_id) ORDER BY doc_id LIMIT 10 OFFSET 10"),
        "backlinks": _edge_sql("SELECT dst AS doc_id, src AS linked_from FROM edges"),
        "neighbours": _edge_sql("SELECT doc_id, other FROM both_ways"),
        "khop": _edge_sql("SELECT doc_id, hops FROM khop", _hop_sql(3)),
        "pagerank": _edge_sql("SELECT doc_id, round(pr, 9) AS pr FROM page_rank", _rank_sql()),
        "relation_search": _edge_sql("SELECT doc_id, hops, round(coalesce(pr, 0), 9) AS score FROM khop LEFT JOIN page_rank USING (doc_id)", _rank_sql() + _hop_sql(3)),
        "relational_subgraph": _edge_sql("SELECT DISTINCT 'page' || src AS source, 'page' || dst AS destination FROM edges SEMI JOIN near a ON src = a.doc_id SEMI JOIN near b ON dst = b.doc_id", _hop_sql(2) + ", near AS (SELECT * FROM khop ORDER BY hops, doc_id LIMIT 150)"),
        "suggest": _index_sql(
            f"SELECT word, arg_min(token, (d, size, token)) AS suggestion FROM (SELECT word, token, abs(strlen(token) - strlen(word)) AS size, greatest(1, {near('token', 'word')}) AS d FROM dictionary, {words} WHERE postings_count >= 20 AND abs(length(token) - length(word)) <= 3) WHERE d <= 3 GROUP BY word"
        ),
        "neighbour_match": _index_sql(f"SELECT token, CAST(d AS INTEGER) AS distance FROM (SELECT token, {near('token', chr(39) + 'that' + chr(39))} AS d FROM dictionary WHERE length(token) <= 6) WHERE d <= 2"),
        **_text_sql(some),
        "query_readings": f"SELECT * FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)}, true)' for a, b in READINGS)}) v(text, reading, parses_back)",
        "suggest_tree": _index_sql(
            f"SELECT 'thee the AND NOT \"annd offf\"' AS text, max(b) FILTER (word = 'thee') || ' the AND NOT \"' || max(b) FILTER (word = 'annd') || ' ' || max(b) FILTER (word = 'offf') || '\"' AS suggestion FROM (SELECT word, arg_min(token, (d, size, token)) AS b FROM (SELECT word, token, abs(strlen(token) - strlen(word)) AS size, greatest(1, {near('token', 'word')}) AS d FROM dictionary, {words} WHERE word NOT IN (SELECT token FROM dictionary WHERE postings_count >= 20) AND postings_count >= 20 AND abs(length(token) - length(word)) <= 3) WHERE d <= 3 GROUP BY word UNION ALL SELECT token, token FROM dictionary WHERE postings_count >= 20 AND token IN ('thee', 'annd', 'offf'))"
        ),
        "relation_text": f"WITH RECURSIVE {_EDGES}{_rank_sql()}{_hop_sql(2)}, {_SEG} SELECT doc_id, hops, round(coalesce(pr, 0), 9) AS score FROM khop LEFT JOIN page_rank USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM {some('der')})",
        "relation_postings": f"WITH RECURSIVE {_EDGES}{_hop_sql(2)}, {_SEG} SELECT doc_id, pos FROM {some('der', 'la')} WHERE doc_id IN (SELECT doc_id FROM khop)",
        "relational_limit": _edge_sql("SELECT doc_id, hops FROM khop ORDER BY hops, doc_id LIMIT 60", _hop_sql(2)),
        "store_version": "SELECT max(doc_id) + 100 AS dump_id FROM documents",
        "assembled": f"WITH {_STORE} SELECT doc_id, title, abstract, categories, last_updated, md5(text) AS main_md5, links, coalesce(boxes, '') AS infoboxes, len(lines) AS n_citations, md5(array_to_string(lines, '|')) AS citations_md5 FROM store",
        "accepted": f"WITH {_STORE} SELECT doc_id, title FROM store",
        "rejected": f"WITH {_STORE} SELECT doc_id, 'z' || title AS title, 'repeated id' AS reason FROM store JOIN marks USING (doc_id) WHERE quality = 0 UNION ALL SELECT NULL, title, 'no id' FROM store JOIN marks USING (doc_id) WHERE toxic = 1",
        "parsed_links": f"WITH {_STORE} SELECT doc_id AS src, unnest([doc_id + 1, doc_id * 2, doc_id + 1]) AS dst FROM store",
        "parsed_dates": f"WITH {_STORE} SELECT doc_id, strftime(CASE doc_id % 5 WHEN 1 THEN make_timestamp(2024, 1, doc_id % 28 + 1, 3, 4, 5) WHEN 2 THEN TIMESTAMP '2017-01-01 00:00:00' WHEN 4 THEN coalesce(try_cast('2023-02-' || lpad((doc_id % 40 + 1)::VARCHAR, 2, '0') AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00') ELSE TIMESTAMP '1970-01-01 00:00:00' END, '%Y-%m-%d %H:%M:%S') AS last_updated FROM store",
        "root_lookup": _index_sql("SELECT doc_id, 'doc' || doc_id AS title, substr(flat, 1, 80) AS abstract FROM seg0 WHERE doc_id = 5"),
        "rebuilt": f"""WITH {_STORE}, seg AS (
  SELECT doc_id, 0 AS ord, 'quality' || quality AS elem, 'toxic ' || toxic AS text FROM store JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 1, NULL, text FROM store
  UNION ALL SELECT doc_id, 2, 'Citation', unnest(lines) FROM store
  UNION ALL SELECT doc_id, 3, 'Category', categories FROM store
), tok AS (SELECT doc_id, elem, unnest(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS token FROM seg)
SELECT true AS built, false AS built_again, (SELECT max(doc_id) + 100 FROM documents) AS dump_id, (SELECT count(*) FROM store) AS docs, count(*) AS postings, count(DISTINCT (doc_id, token)) AS tf, count(DISTINCT token) AS tokens,
  (SELECT count(DISTINCT (doc_id, elem)) FROM seg WHERE elem IS NOT NULL) AS extents, 3 * (SELECT count(*) FROM store) AS links FROM tok""",
        "search_full": f"WITH RECURSIVE {_EDGES}{_rank_sql()}, {_SEG}, best AS ({_tfidf_sql(full_text, some('the', 'of', 'and'), 'coalesce(pr, 0)', 'LEFT JOIN page_rank USING (doc_id)')}) SELECT doc_id, 'doc' || doc_id AS title, substr(flat, 1, 80) AS abstract, score FROM best JOIN seg0 USING (doc_id)",
    }
