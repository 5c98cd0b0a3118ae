"""Schemas of source tables, documents and index tables."""

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "short": T.ShortType(), "string": T.StringType()}


def _table(columns: str) -> T.StructType:
    """A schema from "name kind, ..."; it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


ARTICLE = _table("articleid long, title string, domain string, namespace short, lastupdated string, dumpid long")
CONTENT = _table("articleid long, categories string, abstracts string, links string, text string")
INFOBOXES = _table("articleid long, infoboxtype string, body string")
CITATIONS = _table("articleid long, citationid long, body string")

DOCUMENT = _table("doc_id long, title string, abstract string, categories string, last_updated string, main_text string, links string")
DOCUMENT = DOCUMENT.add("infoboxes", T.ArrayType(_table("itype string, text string"))).add("citations", T.ArrayType(T.StringType()))

INDEX = {
    "postings": "token string, doc_id long, pos int",
    "tf": "token string, doc_id long, tf long",
    "dictionary": "token string, df long, postings_count long",
    "extents": "elem string, doc_id long, start_pos int, end_pos int",
    "edges": "src long, dst long",
    "docs": "doc_id long, title string, abstract string, last_updated timestamp_ntz",
    "page_rank": "doc_id long, pr double",
}
