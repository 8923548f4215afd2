"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased letters and single blanks give character n-grams of 1 to 3, hashed to DIMENSIONS. Document frequencies are
counted over every learnable document; the weights are learned by follow-the-regularised-leader with elastic-net penalties
on a bounded sample (SAMPLE_ROWS documents with the smallest hashes of their ids), a fifth of which is left for fitting the
temperature. A model is a table of at most DIMENSIONS x languages numbers, whatever the corpus holds.

Texts that are null or have no letter are ``und`` with score 0, as all are when nothing could be learned. Rows with a null
language or doc_id aren't learned from. Of equally likely languages the first in the alphabet is told. Rows that repeat a doc_id are each
told by their text, and are learned from within the bound of the sample. Texts of any length are read whole, in their own task. An empty
table gives no rows. Other columns are never read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import append_from_text, hash_sample, held_out

DIMENSION_BITS, SAMPLE_ROWS, EPOCHS = 15, 3000, 2
DIMENSIONS = 1 << DIMENSION_BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_is_letter: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with all but letters as single blanks, one at either end."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    c = np.concatenate(([32], np.where(_is_letter[c], c, 32), [32]))
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams present and their counts; both empty where the text has no letter."""
    c = letters(text or "").astype(np.uint64)
    if not (c != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift, code, found = np.uint64(64 - DIMENSION_BITS), np.zeros(len(c), np.uint64), []
    for n in range(3):
        code = code[: len(c) - n] * np.uint64(0x100000001B3) + c[n:]
        found.append((code + np.uint64(n + 1)) * SALTS[n] >> shift)
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = grams(text.as_py())
            total[at] += 1
            docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())], ["gram", "n"])


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "lang", "grams", "counts"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMENSIONS + 1 rows, the last is the bias
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Per-coordinate FTRL-proximal over the rows, EPOCHS times; weights whose |z| stays within L1 are exactly zero."""
    z = np.zeros((DIMENSIONS + 1, len(model.languages)))
    squares = np.zeros_like(z)

    def weights(zs, ns):
        return np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, counts, label in rows:
            own, x = np.append(at, DIMENSIONS), np.append(model.features(at, counts), 1.0)
            zs, ns = z[own], squares[own]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            new = ns + g * g
            z[own] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
            squares[own] = new
    model.weights = weights(z, squares).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a grid between 1/20 and 20."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 61):
        p = softmax(logits / t)[np.arange(len(labels)), labels]
        best = min(best, (-float(np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    return best[1]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``(doc_id, text, lang)`` that aren't held out and have a language."""
    learnable = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    seen = learnable.select("text").mapInArrow(_count_documents, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most DIMENSIONS + 1 rows
    sample = hash_sample(learnable, "doc_id", sample_rows).mapInArrow(_sample_grams, "doc_id long, lang string, grams array<int>, counts array<int>")
    sample = sample.orderBy(F.xxhash64("doc_id"), "lang", "grams", "counts").limit(sample_rows)  # ids may repeat
    rows = sorted(((r.doc_id, r.lang, np.array(r.grams, np.int64), np.array(r.counts, np.int64)) for r in sample.collect() if r.grams), key=lambda r: (hash_order(r[0]), r[1], len(r[2])))
    frequency = np.zeros(DIMENSIONS)
    total = int(seen.n[seen.gram == -1].sum())
    known = seen[seen.gram >= 0]
    frequency[known.gram.to_numpy()] = known.n.to_numpy()
    model = Model(sorted({r[1] for r in rows}), np.log((1 + total) / (1 + frequency)) + 1, np.zeros((DIMENSIONS + 1, 0)))
    if not rows:
        return model
    coded = [(at, counts, model.languages.index(lang)) for _, lang, at, counts in rows]
    apart = len(coded) // 5
    follow_the_leader(model, coded[apart:] or coded)
    if apart >= 20:
        model.temperature = fit_temperature(np.stack([model.logits(at, n) for at, n, _ in coded[:apart]]), np.array([y for *_, y in coded[:apart]]))
    return model


def hash_order(doc_id: int | None) -> int:
    """A fixed shuffle of the rows for training."""
    return ((doc_id or 0) * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64) >> 20


def _predict(model: Model):
    def run(texts: pa.Array) -> list[pa.Array]:
        found = [model.predict(x.as_py()) for x in texts]
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row; no shuffle."""
    found = append_from_text(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _predict(model), "lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "_found.lang_pred", "_found.score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least that probability."""
    found = append_from_text(docs, _predict(model), "lang_pred string, score double")
    return found.where((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= least)).select(*docs.columns)
