"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of the lower-cased text (runs of letters; characters beyond ASCII count as letters), hashed to
DIMENSIONS; words of one hash are one term. A term weighs (1 + log of its count) x idf x emphasis. Document frequencies are
counted over all documents. The emphasis is at least 1 and grows with the smoothed share of toxic examples among those
that have the term, so that telling words outweigh chance ones; no term is left out.

Every labelled example of the sample is indexed on all its terms. Examples with the same frequent words lie together, in
blocks of BLOCK. The lists of the FREQUENT commonest terms are kept as full rows, which one matrix product adds up for many
queries; short lists are added whole. Of the others the largest weight in each block bounds what the block can still reach.
Blocks are visited by falling bound until none can reach the k-th neighbour, so the neighbours are exact (ties: smaller doc_id). Neighbours vote with weights 1 / (distance + 0.05); votes are calibrated on the examples, each
without itself, and come with the neighbours as evidence.

The index holds SAMPLE_ROWS labelled documents at most and is sent to the tasks; its bound doesn't grow with the corpus.

Null texts count as empty; texts without a word get the smoothed toxic share of the examples. Without examples every score
is one half. Rows that repeat a doc_id are scored each; contradicting labels of a document are left out, and so are null ones. Texts of
any length are read whole, a row at a time. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, hash_sample, held_out

SAMPLE_ROWS, DIMENSION_BITS = 4000, 18
DIMENSIONS = 1 << DIMENSION_BITS
EMPHASIS_PRIOR, EMPHASIS_POWER = 10, 2
BLOCK, SHORT, FREQUENT, NEIGHBOURS, CACHE_WORDS = 64, 12, 512, 15, 300_000
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
BLANKED = bytes.maketrans(NOT_LETTERS, b" " * len(NOT_LETTERS))


class Terms(dict):
    """Word -> its hashed term."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - DIMENSION_BITS)
        return found


TERMS = Terms()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their counts."""
    words = Counter((text or "").lower().encode("utf-8", "replace").translate(BLANKED).split())
    at, n = np.fromiter(map(TERMS.__getitem__, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
    order = np.argsort(at)
    at, n = at[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
    return at[first], np.add.reduceat(n, first) if len(at) else n


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total[terms(text.as_py())[0]] += 1
            rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["term", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(x.as_py()) for x in batch.column(1)]
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["doc_id", "toxic", "terms", "counts"])


@dataclass
class Example:
    doc_id: int
    toxic: int
    terms: np.ndarray
    counts: np.ndarray


def arranged(examples: list[Example]) -> list[Example]:
    """Examples with the same most frequent words side by side."""
    return sorted(examples, key=lambda e: (*e.terms[np.lexsort((e.terms, -e.counts))[:3]].tolist(), e.doc_id))


class Index:
    """Posting lists by term, examples ascending, with the start and the largest weight of each block of the long ones."""

    def __init__(self, idf: np.ndarray, examples: list[Example]):
        self.ids = np.array([e.doc_id for e in examples], np.int64)
        self.labels = np.array([e.toxic for e in examples], np.int64)
        self.share = (self.labels.sum() + 0.5) / (len(examples) + 1)
        self.slope, self.shift = 1.0, 0.0
        flat = np.concatenate([np.empty(0, np.int64), *(e.terms for e in examples)])
        owner = np.repeat(np.arange(len(examples)), [len(e.terms) for e in examples])
        having, toxic = np.bincount(flat, minlength=DIMENSIONS), np.bincount(flat, self.labels[owner], DIMENSIONS)
        shared = (toxic + EMPHASIS_PRIOR * self.share) / (having + EMPHASIS_PRIOR)
        self.weight = (idf * np.maximum(1, shared / self.share) ** EMPHASIS_POWER).astype(np.float32)
        w = np.concatenate([np.empty(0), *(self.weigh(e.terms, e.counts) for e in examples)])
        self.blocks = max(1, -(-len(examples) // BLOCK))
        common = np.sort(np.argsort(-having, kind="stable")[:FREQUENT])
        self.row = np.full(DIMENSIONS, -1, np.int16)
        self.row[common] = np.arange(FREQUENT)
        dense = self.row[flat] >= 0
        self.rows = np.zeros((FREQUENT, self.blocks * BLOCK), np.float32)
        self.rows[self.row[flat[dense]], owner[dense]] = w[dense]
        flat, owner, w = flat[~dense], owner[~dense], w[~dense]
        having[common] = 0
        order = np.argsort(flat, kind="stable")
        self.docs, self.w = owner[order].astype(np.int32), w[order].astype(np.float32)
        own = np.flatnonzero(having)
        self.column = np.full(DIMENSIONS, -1, np.int32)
        self.column[own] = np.arange(len(own))
        self.length = having[own]
        self.first = np.cumsum(self.length) - self.length
        long = np.flatnonzero(self.length > SHORT)
        self.long = np.full(len(own), -1, np.int32)
        self.long[long] = np.arange(len(long))
        cell = np.repeat(self.long, self.length).astype(np.int64) * self.blocks + self.docs // BLOCK  # below 0: short
        self.maxima = np.zeros(len(long) * self.blocks, np.float32)
        np.maximum.at(self.maxima, cell[cell >= 0], self.w[cell >= 0])
        sizes = np.bincount(cell[cell >= 0], minlength=len(self.maxima)).reshape(-1, self.blocks)
        self.maxima = self.maxima.reshape(-1, self.blocks)
        self.starts = np.concatenate((np.zeros((len(long), 1), np.int64), sizes.cumsum(axis=1)), axis=1) + self.first[long][:, None]
        self.starts = self.starts.astype(np.int32)

    def weigh(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[at]
        return w / max(float(np.linalg.norm(w)), 1e-12)

    def _add(self, starts: np.ndarray, lengths: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What stretches of posting lists add to the cosine of each example."""
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.docs[at], np.repeat(w, lengths) * self.w[at], self.blocks * BLOCK).astype(float)

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the commonest terms add to the cosine of each query and example."""
        q = np.zeros((len(queries), FREQUENT), np.float32)
        for k, (at, w) in enumerate(queries):
            row = self.row[at]
            q[k, row[row >= 0]] = w[row >= 0]
        return q @ self.rows

    def nearest(self, at: np.ndarray, w: np.ndarray, common: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0."""
        column = self.column[at]
        w, column = w[column >= 0], column[column >= 0]
        long = self.long[column]
        short = column[long < 0]
        cosine = common + self._add(self.first[short], self.length[short], w[long < 0])
        rows, w = long[long >= 0], w[long >= 0]
        bound = cosine.reshape(-1, BLOCK).max(axis=1) + w @ self.maxima[rows]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        seen, worst, done, step = np.empty(0, np.int64), 0.0, 0, 4
        while done < len(order):
            now = order[done : done + step]
            now = now[bound[now] >= worst - 1e-6]
            if not len(now):
                break
            begin, end = self.starts[rows[:, None], now], self.starts[rows[:, None], now + 1]
            cosine += self._add(begin.ravel().astype(np.int64), (end - begin).ravel(), np.repeat(w, len(now)))
            if without >= 0:
                cosine[without] = 0
            seen = np.concatenate((seen, (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()))
            if len(seen) > k:
                worst = float(np.partition(cosine[seen], -k)[-k])
            done, step = done + step, step * 4
        seen = seen[cosine[seen] > 1e-9]
        if len(seen) > k:
            seen = seen[cosine[seen] >= worst - 1e-6]
        seen = seen[np.lexsort((seen, self.ids[seen], -np.round(cosine[seen], 6)))[:k]]
        return seen, cosine[seen]

    def neighbours(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query's terms and counts; ``own``: the queries are the examples in their order, each without itself."""
        for first in range(0, len(queries), 64):
            part = [(at, self.weigh(at, n)) for at, n in queries[first : first + 64]]
            for j, ((at, w), common) in enumerate(zip(part, self.common_part(part), strict=True)):
                yield self.nearest(at, w, common, k, first + j if own else -1)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (1 - np.minimum(cosines, 1) + 0.05)
        return float((w @ self.labels[found] + 0.5 * self.share) / (w.sum() + 0.5))  # a little of the share of all, so that few far neighbours count less

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[dict]]]:
        if not len(self.ids):
            yield from ((0.5, []) for _ in texts)
            return
        for found, cosines in self.neighbours([terms(t) for t in texts]):
            if not len(found):
                yield float(self.share), []
                continue
            raw = min(max(self.vote(found, cosines), 1e-4), 1 - 1e-4)
            p = 1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift)))
            yield float(p), [{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in zip(self.ids[found].tolist(), cosines.tolist(), self.labels[found].tolist(), strict=True)]


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from the votes' log odds to the labels, smoothed by one row of each kind."""
    x = np.log(np.clip(votes, 1e-4, 1 - 1e-4) / np.clip(1 - votes, 1e-4, 1))
    x, y = np.concatenate((x, [-6.0, 6.0])), np.concatenate((labels, [0, 1]))
    a = np.array([1.0, 0.0])
    d = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ a, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(2)
        step = np.linalg.solve(h, d.T @ (p - y) + 0.1 * (a - [1.0, 0.0]))
        a -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a[0]), 0.05), float(a[1])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are; at most DIMENSIONS + 1 rows come to the driver."""
    seen = docs.select(F.col("text").cast("string")).mapInArrow(_count_documents, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency, known = np.zeros(DIMENSIONS), seen[seen.term >= 0]
    frequency[known.term.to_numpy()] = known.n.to_numpy()
    return frequency, int(seen.n[seen.term == -1].sum())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Index:
    """The calibrated index of ``sample_rows`` labelled documents that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(~held_out() & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    sampled = F.broadcast(cut(hash_sample(marks, "doc_id", sample_rows)))  # at most sample_rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sampled, "doc_id").select("doc_id", "text", "toxic")
    rows = texts.mapInArrow(_vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").orderBy("doc_id", "terms", "counts").limit(sample_rows).collect()
    frequency, total = document_frequencies(docs)
    examples = arranged([Example(r.doc_id, r.toxic, np.array(r.terms, np.int64), np.array(r.counts, np.int64)) for r in rows if r.terms])
    index = Index(np.log((1 + total) / (1 + frequency)) + 1, examples)
    if examples:
        votes = [index.vote(*x) for x in index.neighbours([(e.terms, e.counts) for e in examples], own=True)]
        index.slope, index.shift = calibrate(np.array(votes), index.labels)
    return index


EVIDENCE = pa.list_(pa.struct({"doc_id": pa.int64(), "cosine": pa.float64(), "toxic": pa.int32()}))


def _score(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                scores, evidence = zip(*index.score(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(evidence, EVIDENCE)], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence``; no shuffle."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(index), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
