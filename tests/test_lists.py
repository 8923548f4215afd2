"""Postings and vectors as lists: what they hold as rows, repeated keys, and how many rows a batch writes."""

from pyspark.sql import functions as F

from plantscribe.operators import retrieval as R
from plantscribe.sources.keyed import KeyedTables
from plantscribe.streaming import jobs as J

from .test_terms import ODD

KEYS = ["doc_id", "chunk_index"]


def rows_of(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def test_lists_hold_what_the_rows_hold(spark):
    """Repeated keys add up, a null among them too; without any the lists are never shuffled."""
    odd = spark.createDataFrame([(k, 0, t) for k, t in enumerate(ODD)], "doc_id long, chunk_index int, text string")
    assert "Exchange" not in R.term_lists(odd, KEYS)._jdf.queryExecution().executedPlan().toString()
    more = odd.unionByName(spark.createDataFrame([(3, 0, "the pump"), (3, 0, "pump"), (None, 0, "pump seal"), (None, 0, "seal pump")], odd.schema))
    for rows in (odd, more, odd.limit(0)):
        lists = R.term_lists(rows, KEYS)
        assert lists.count() == lists.distinct().count() == R.postings(rows, KEYS).select(*KEYS).distinct().count()
        assert rows_of(R.posted(lists).select(*KEYS, "term", "tf")) == rows_of(R.postings(rows, KEYS))
        assert rows_of(R.pointed(R.vector_lists(lists, KEYS))) == rows_of(R.term_vectors(rows, KEYS))


def test_a_batch_writes_a_row_a_chunk(spark, tmp_path):
    """It was a row for each term and dimension, which every replacement and compaction handled again."""
    root, tables = str(tmp_path / "store"), KeyedTables(spark, str(tmp_path / "store"), "doc_id")
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(0).alias("version"), F.concat(F.lit("pump seal valve P-1 "), F.col("id").cast("string")).alias("text"))
    for number, own in ((0, docs), (1, docs.where("doc_id < 3").withColumn("text", F.lit("other words")))):
        batch = tables.batch()
        J.described(batch, own, ["doc_id", "version"], number)
        tables.commit(batch, own, "load", number)
    tables.compact()
    tables.clear()
    (data,) = (tmp_path / "store" / "data").iterdir()
    assert {t: spark.read.parquet(str(data / t)).count() for t in ("chunks", "postings", "vectors")} == {"chunks": 20, "postings": 20, "vectors": 20}
    assert {(r.term, r.tf) for r in J.current(spark, root, "postings").where("doc_id = 2").collect()} == {("other", 0.5), ("words", 0.5)}
    assert J.current(spark, root, "postings").where("doc_id = 12").count() == 5 and J.current(spark, root, "vectors").where("weight > 0").select("doc_id").distinct().count() == 20


def test_texts_of_a_batch_are_told_apart(spark, tmp_path):
    rows = [(1, "b"), (1, "a"), (1, "b"), (2, None), (2, None), (2, "c"), (None, "d"), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    J.ingest(J.table_stream(spark, str(tmp_path / "docs")), str(tmp_path / "out")).awaitTermination()
    (texts,) = (tmp_path / "out" / "data").glob("*/texts")
    assert rows_of(spark.read.parquet(str(texts)).select("doc_id", "text", "version")) == sorted(map(repr, [(1, "a", 0), (1, "b", 1), (2, None, 0), (2, "c", 1), (None, "d", 0)]))
