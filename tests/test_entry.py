"""The entry module's contract, with and without the training-data subpackage."""

import __spark_entry__ as entry


def test_keys_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"postings", "search_full", "pagerank"} <= set(entry.queries())
