"""Golden passages of all lengths against SQL."""

import duckdb
import numpy as np
import pytest

from plantscribe import plans
from plantscribe.plans import quality as Q

from .oracle import compare

TEXTS = [
    "the pumps  leak at night", "pump house\nvalve", "a café stop", "café", "international pump", "Pump", "", None, "  ", "x\ty pump\tvalve", "seal ring pump valve oil",
    "lubrication oil of the pump valve", "valve pump", "ump", "pump valve gear hose and the long international pumping station", "internationalised",
]
PASSAGES = [
    "ump", "pump", "pump valve", "mp va", "e pump", "international", "internationally", "fé", "café stop", " pump", "valve ", "", " ", "  ", "\t", None, "nowhere", "p", "pump\tvalve",
    "pump valve oil", "seal ring pump valve", "the long international pumping stat",
]
QUERIES = ("first_golden_hit", "recall_by_category", "retrieval_metrics")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts and passages of a few words; the last question has no id."""
    path = tmp_path_factory.mktemp("golden")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*enumerate(PASSAGES), (None, "pump house valve")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return str(path), con


def test_short_passages_have_all_their_sources(spark, odd):
    names = Q.golden(spark, odd[0])[1].where("NOT main").select("query_id", "slug").collect()
    want = {(q, str(d)) for q, p in enumerate(PASSAGES) for d, t in enumerate(TEXTS) if p is not None and t is not None and p in t}
    assert len(names) == len(want) and {tuple(r) for r in names} == want


@pytest.mark.parametrize("name", QUERIES)
def test_short_passages_count_as_in_sql(spark, odd, name):
    compare(plans.queries()[name](spark, odd[0]), odd[1], plans.oracle_sql()[name])


def test_runs_of_bytes():
    assert Q.byte_runs(b"", 0).tolist() == [0] and Q.byte_runs(b"ab", 3).tolist() == []
    assert Q.byte_runs(b"aba", 1).tolist() == [97, 98, 97]
    text = bytes(range(256)) * 2
    assert len(np.unique(Q.byte_runs(text, 8))) == 256
