"""What is dear to make is made once a query: documents of a store, links of a graph, tokens of texts."""

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import index
from tessera.sources import articles, corpus

SF = "/root/testdata/sf0.001"


def counted(df: DataFrame, column: str):
    """``df`` that counts how often its rows are made where ``column`` is read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(same, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_an_update_assembles_once(spark, tmp_path, monkeypatch):
    store = corpus.store(spark, SF)
    docs, seen = counted(articles.assemble(store), "links")
    monkeypatch.setattr(articles, "assemble", lambda _: docs)
    assert api.update_index(spark, store, str(tmp_path / "ix"))
    ix = index.Index.load(spark, str(tmp_path / "ix"))
    assert ix.docs.count() == seen.value > 100
    assert not [p for p in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("kept-*") if any("infoboxes" in spark.read.parquet(str(f)).columns for f in p.glob("*.parquet"))]


def test_a_dictionary_of_ids_that_repeat(spark):
    texts = [(1, "a b a"), (1, "a c"), (2, "a"), (None, "a d"), (None, "d d"), (3, ""), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, main_text string").select("doc_id", F.lit("t").alias("title"), F.lit(None).cast("string").alias("categories"), "main_text", F.expr("array(named_struct('itype', 'X', 'text', 'b  e'))").alias("infoboxes"), F.expr("array('a', cast(null as string), ' ')").alias("citations"))
    for d in (docs, docs.filter("doc_id > 1"), docs.limit(0)):
        expected = index.dictionary_of(index.tf_of(index.postings_of(index.words(d))))
        assert sorted(index.dictionary_of_documents(d).collect()) == sorted(expected.collect())


def test_places_of_many_stretches(spark):
    lines = ["", "a b", " ", "c"] * 300
    docs = spark.createDataFrame([(7, "x  y", lines, "z")], "doc_id long, main_text string, citations array<string>, categories string").withColumn("infoboxes", F.expr("array(named_struct('itype', 'Box', 'text', 'q'))"))
    found = {(r["elem"], r["start_pos"], r["end_pos"]) for r in index.extents_of(index.segments(docs)).collect()}
    assert found == {("box", 0, 1), ("Citation", 3, 903), ("Category", 903, 904)}
    tokens = [r["token"] for r in index.postings_of(index.words(docs)).orderBy("pos").collect()]
    assert tokens == ["q", "x", "y", *["a", "b", "c"] * 300, "z"]
