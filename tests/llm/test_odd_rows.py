"""Null and repeated doc_ids, columns with clashing names and a text of a megabyte, for operators whose own tests have none."""

import zlib

import pytest
from pyspark.sql import functions as F

from plantscribe.llm import nbest_pieces, queries, simhash, token_orc, toxicity
from plantscribe.llm.tokens import default_vocabulary, encoder

from .conftest import TEXTS

LONG = "the quick brown fox, " * 50_000  # a megabyte


@pytest.fixture(scope="module")
def rows(spark, odd_docs):
    """All texts twice, with a null and a repeated doc_id, and a long text under three ids."""
    long = spark.createDataFrame([(500, LONG), (501, LONG), (None, LONG)], "doc_id long, text string")
    twice = odd_docs.unionByName(odd_docs).selectExpr("if(doc_id = 3, null, if(doc_id = 5, 4, doc_id)) AS doc_id", "text")
    return twice.unionByName(long).selectExpr("*", "1 AS n_tokens", "2 AS start", "'x' AS fingerprint", "3 AS component_id", "4 AS score", "5 AS predicted").repartition(3).cache()


def test_simhash_rows(rows):
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    by_text = {simhash.fingerprint(t): t for t in [*TEXTS, LONG]}
    assert {int(r.fingerprint, 16) for r in got} == set(by_text)
    for r in got:
        ids = [x.doc_id for x in got if x.component_id == r.component_id and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_token_files(spark, rows, tmp_path):
    path = token_orc.write_tokens(rows, str(tmp_path / "ids"))
    got = token_orc.token_index(spark, path).orderBy("start").collect()
    assert len(got) == rows.count()
    at = 0
    for r in got:  # gapless, ids ascending
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)
    packed = encoder(default_vocabulary()).packed([LONG])
    (ids,) = list(packed)
    assert {(r.n_tokens, r.ids_crc32) for r in got if r.doc_id in (500, 501)} == {(len(ids) // 4, zlib.crc32(bytes(ids)))}


def test_toxicity_rows(spark, rows):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(12)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = toxicity.classify(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1


def test_nbest_of_long_stretches(spark):
    """Whole texts of a megabyte, with blanks and without."""
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (None, "abcdefghij" * 100_000)], "doc_id long, text string")
    coded = nbest_pieces.encode(docs, keep_ids=True).cache()
    got = coded.collect()
    assert len(got) == 3 and all(r.round_trip and r.nbest_scores == sorted(r.nbest_scores, reverse=True) and len(r.nbest_scores) == nbest_pieces.N_BEST for r in got)
    assert len({r.ids_crc32 for r in got if r.doc_id == 1}) == 1
    assert {(r.doc_id, r.text) for r in nbest_pieces.decode(coded).collect()} == {(1, LONG), (None, "abcdefghij" * 100_000)}


def test_queries_are_named_once():
    names = list(queries.queries())
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []
    assert set(queries.oracle_sql()) <= set(names)
