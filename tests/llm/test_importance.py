import hashlib
import math
import re
import zlib

import pytest

from plantscribe.llm import importance

from .conftest import TEXTS

TARGET = ["the quick brown fox jumps, the End", None, "ünïcode WÖRDS 12,345", ""]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in runs(x)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out, able = {}, []
    for d, x in docs:
        w, f = runs(x)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[d] = (len(f), weight, score, None)
        able += [(-score, d)] if len(w) >= least else []
    for k, (_, d) in enumerate(sorted(able)[: len(able) * percent // 100]):
        out[d] = (*out[d][:3], k + 1)
    return out


def taken(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    docs = [(k, t) for k, t in enumerate(TEXTS * 5)] + [(k, "Lorem ipsum x9 " * (k % 13)) for k in range(100, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    assert taken(importance.resample(df, target, longest=longest)) == brute(docs, TARGET, longest)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    rows = odd_docs.unionByName(odd_docs).selectExpr("if(doc_id = 9, null, doc_id) AS doc_id", "text", "1 AS weight", "2 AS score", "3 AS n_words", "4 AS rank")
    got = importance.resample(rows, target, percent=100).collect()
    assert len(got) == 2 * len(TEXTS)
    ranks = [r["rank"] for r in got if r["rank"]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) == 4
    assert all(r.weight == 0 and r["rank"] is None for r in got if r.n_features == 0)
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(odd_docs, target.limit(0)).count() == len(TEXTS)


def test_megabyte_text(spark):
    text = "Word a1b2 " * 100_000 + "x" * 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    target = spark.createDataFrame([("word",)], "text string")
    assert taken(importance.resample(df, target)) == brute([(1, text)], ["word"])


def test_table_of_bytes():
    assert importance.words("Ab-9\x00É~z|Q_r") == [b"ab", b"9", "É".encode(), b"z", b"q", b"r"]
    assert importance.words(None) == importance.words(" .,;") == []
