"""Terms counted outside the JVM, unit vectors, and what the retrieval queries ask for."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plantscribe.functions import text as X
from plantscribe.operators import retrieval as R
from plantscribe.plans import quality as Q, retrieval as P

ODD = [None, "", "a", "The pump", "the-pump _x -- 9 42", "\u212aelvin \u0130stanbul \u00c5ngstr\u00f6m caf\u00e9s", "it its it's  xx\tyy\nzz", "a b c", "not-a-stop THE_x\u00a0yy", "\U0001f600ok ok"]


def test_terms_are_those_of_the_column_function(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k long, text string")
    want = {r.k: Counter(r.t) for r in rows.select("k", X.index_tokens(F.col("text")).alias("t")).collect() if r.t}
    got = {r.k: (r._n, dict(zip(r._terms, r._counts, strict=True))) for r in R.counted_terms(rows, ["k"]).collect()}
    assert got == {k: (c.total(), dict(c)) for k, c in want.items()}


def test_rows_that_repeat_their_keys_add_up(spark):
    """Three equal rows of two tokens: the chunk stays, as the SQL has it (it was taken for one without a token)."""
    rows = spark.createDataFrame([(1, 0, "pump seal")] * 3 + [(2, 0, "pump"), (3, 0, "the")], "doc_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(7, "pump"), (7, "seal")], "query_id long, term string")
    told = {(r.doc_id, r.term): r.tf for r in R.asked_postings(rows, terms, ["doc_id", "chunk_index"]).collect()}
    assert told == {(1, "pump"): 1.5, (1, "seal"): 1.5, (1, ""): 1.5, (2, "pump"): 1.0, (2, ""): 1.0}
    assert {(r.doc_id, r.term): r.tf for r in R.postings(rows, ["doc_id", "chunk_index"]).collect()} == {k: v for k, v in told.items() if k[1]}
    weights = {(r.doc_id, r.dimension): r.weight for r in R.term_vectors(rows, ["doc_id"]).collect()}
    assert sorted(weights.values()) in ([0.707107, 0.707107, 1.0], [1.0, 1.0])


def test_unit_vectors_are_linear_in_their_length(spark):
    rows = spark.range(4).select(F.sequence(F.lit(1), F.lit(20_000)).cast("array<double>").alias("v"))
    began = time.time()
    got = rows.select(X.unit(F.col("v")).alias("u")).select(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert [r.n for r in got] == pytest.approx([1] * 4) and time.time() - began < 20


def test_only_questions_that_are_asked_are_searched(spark, monkeypatch):
    seen, nearest = [], R.nearest
    monkeypatch.setattr(R, "nearest", lambda queries, *a, **kw: seen.append(queries.count()) or nearest(queries, *a, **kw))
    P.merged(spark, "/root/testdata/sf0.01").count()
    assert seen == [spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0").join(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), F.col("vec_id") == F.col("item_id")).count()]


def test_runs_of_words(spark):
    text = "a b c  d\te f a b c"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "a b")], "k long, text string")
    got = {r.k: r.runs for r in Q.word_runs(rows, 3).collect()}
    assert len(got[1]) == 6 and got[2] == got[3] == []  # seven runs, one of them twice
    assert set(Q.run_hashes(b"f a b", 3).tolist()) <= set(got[1])


def test_citations_read_one_retrieval(spark):
    got = Q.cited(spark, "/root/testdata/sf0.001")[1]
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # each reader would score every cell again
