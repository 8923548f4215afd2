"""Tags are searched once in each text."""

import re

from plantscribe.operators import graph as G
from plantscribe.plans.graph import typed_pairs

TEXTS = [("1", "CMP-1 feeds P-2, FT103 and P-2"), ("2", "P-7 alone"), ("3", None), ("4", "none here"), ("5", "FT101 FT102"), ("6", "UNIT-1 holds K-9")]


def searches(df):
    return len(re.findall(r"regexp_extract_all\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_pairs_of_tags_with_one_search(spark):
    rows = spark.createDataFrame(TEXTS, "k string, text string")
    pairs = typed_pairs(rows, ["k"])
    want = {("1", "CMP-1", "IS_PART_OF", "P-2"), ("1", "P-2", "IS_PART_OF", "CMP-1"), ("1", "FT103", "MONITORS", "CMP-1"), ("1", "FT103", "MONITORS", "P-2"), ("6", "K-9", "IS_PART_OF", "UNIT-1")}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) and searches(pairs) == 1


def test_entities_with_one_search(spark):
    found = G.extract_entities(spark.createDataFrame(TEXTS, "k string, text string"), ["k"])
    assert sorted((r.k, r.pos, r.tag) for r in found.collect())[:4] == [("1", 0, "CMP-1"), ("1", 1, "P-2"), ("1", 2, "FT103"), ("1", 3, "P-2")] and searches(found) == 1
