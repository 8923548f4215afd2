"""What the quality model learns from: every labelled row, whatever the blocks and partitions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscribe.llm import quality_model as Q
from plantscribe.llm.common import table

SF = "/root/testdata/sf0.01"


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """In blocks of 40 rows: moments, quantile and median are those of all rows, and partitions make no difference."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept, fit = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda blocks, grams: kept.append(blocks) or fit(blocks, grams, at_once=5))
    model = Q.train(docs, labels, block_rows=40)
    again = Q.train(docs.repartition(7), labels.repartition(3), block_rows=40)
    for name in ("mean", "scale", "weights", "threshold", "temperature", "grams"):
        assert np.array_equal(getattr(model, name), getattr(again, name))
    good, bad = (np.concatenate([np.frombuffer(r[k], "<f8").reshape(-1, 13) for r in kept[0].collect()]) for k in ("good", "bad"))
    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = [(marks[r.doc_id], r.text) for r in docs.collect() if r.doc_id in marks]
    for own, label in ((good, 1), (bad, 0)):
        assert sorted(map(tuple, own[:, :12].tolist())) == sorted(Q.features(t) for y, t in texts if y == label)
    x = np.concatenate((good, bad))
    assert kept[0].count() > 5 and model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(x.std(axis=0))
    s = np.sort(((x - model.mean) / model.scale * model.weights).sum(axis=1))
    assert model.threshold == pytest.approx((s[len(bad) - 1] + s[len(bad)]) / 2, abs=1e-12)
    assert model.temperature == pytest.approx(np.median(np.abs(s - model.threshold)) / 3, abs=1e-12)


def test_repeated_rows_stay_within_a_block(spark):
    """A row that comes a thousand times is one key; a task takes it in parts."""
    docs = spark.range(1000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("good pump text").alias("text")).union(spark.createDataFrame([(4, "BAD !!! ###")], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k != 4)) for k in range(3, 6)], "doc_id long, quality int")
    seen = Q.train(docs, labels, block_rows=50)
    assert np.isfinite(seen.weights).all() and np.isfinite(seen.threshold)
