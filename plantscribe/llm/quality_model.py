"""Quality classifier: Bradley-Terry scores from preference pairs.

A good document is preferred to a bad one with probability sigmoid(s(good) - s(bad)); s is linear in text
features, so the model is a logistic regression without intercept on feature differences. The features are counts, standardised, and
shares of hashed words and byte trigrams. The shares' weights are learned first, from sparse differences of pairs, in two halves of the
rows; what the other half's weights give a row (``grams``) then stands beside its counts, so that no row is judged by weights that
have seen it. Scores are cut at the quantile that leaves the bad share of the training rows below, and scaled so that the cut is 0.5.

Training learns from every labelled row that isn't held out: each is measured once and stored, rows are dealt by a hash into blocks of some
BLOCK_ROWS, and partners are drawn within a block. The shares' weights are learned block by block and averaged by numbers of pairs; the final weights
take Newton steps over the pairs of all blocks (PAIRS_PER_ROW for each row of the rarer kind); means, deviations and the quantile are those of
all rows. Scoring measures every text once, in Python, and is a column expression over the measured features.

Null texts count as empty ones and are scored like any other. Without rows of both labels every score is 0.5. A score at the cut itself
is 0.5 and predicts 1. Rows that repeat a doc_id are scored each and learned from each; a document with contradicting labels
is left out of training. Texts of any length are measured whole, in their own task. An empty table gives no rows. Other columns are never
read and may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import append_from_text, held_out, split_words, stored
from .quality_rules import LETTERS, UPPER

#: Rows of a block (a task holds twice as many at most), partners of each of the rarer kind.
BLOCK_ROWS, PAIRS_PER_ROW, RIDGE = 2_000, 20, 1e-2
#: Pairs for each row in shares, passes over them, buckets of words and as many of trigrams.
GRAM_PAIRS, GRAM_PASSES, BUCKETS, FEW = 4, 3, 1 << 12, 500
#: Labels that are broadcast to the texts at most (more are joined by a shuffle), scores that are sorted at once, and parts of their range otherwise.
BROADCAST_ROWS, SORTED_ROWS, PARTS = 1 << 19, 100_000, 1024
MARKS, DIGITS = b"!?;:*#$%&|<>=+_/\\^~@", b"0123456789"
FEATURES = ("log_words", "word_length", "long_words", "marks", "kinds_of_marks", "digits", "upper", "repeated_next", "distinct", "repeated_lines", "line_words", "sentence_ends")


def parsed(text: str | None) -> tuple[bytes, list[bytes], list[bytes]]:
    """The text's bytes, its words, and these without full stops and commas in lower case."""
    words = split_words(text)
    return (text or "").encode("utf-8", "replace"), words, [w.strip(b".,").lower() for w in words]


def bucket_counts(raw: bytes, bare: list[bytes]) -> np.ndarray:
    """How often a bucket occurs: one for each word and, behind those, one for each byte trigram (A-Z as a-z)."""
    words = np.fromiter(map(zlib.crc32, bare), np.int64, len(bare)) & (BUCKETS - 1)
    at = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    found = np.bincount(words, minlength=2 * BUCKETS)
    if len(at) > 2:
        found += np.bincount(((at[:-2] * 0x9E3779B1 + at[1:-1] * 0x85EBCA77 + at[2:] * 0xC2B2AE3D) >> np.uint32(20)).astype(np.int64) + BUCKETS, minlength=2 * BUCKETS)
    return found


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the roots of their shares, of FEW more words and trigrams than the text has: short texts say little."""
    raw, _, bare = parsed(text)
    return sparse(bucket_counts(raw, bare))


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at.astype(np.int32), np.sqrt(counts[at] / (counts.sum() + FEW)).astype(np.float32)


def features(text: str | None) -> tuple[float, ...]:
    return counted(*parsed(text))


def counted(raw: bytes, words: list[bytes], bare: list[bytes]) -> tuple[float, ...]:
    n = max(len(words), 1)
    n_marks, n_letters = len(raw) - len(raw.translate(None, MARKS)), len(raw) - len(raw.translate(None, LETTERS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(bare, bare[1:], strict=False))
    kinds = sum(w[-1:] in b"!*#$%&|<>" for w in words)
    return (
        math.log1p(len(words)),
        min(sum(map(len, words)) / n, 40.0),
        sum(len(w) > 20 for w in words) / n,
        math.sqrt(min(n_marks / n, 4.0)),
        math.sqrt(kinds / n),
        (len(raw) - len(raw.translate(None, DIGITS))) / max(len(raw), 1),
        (len(raw) - len(raw.translate(None, UPPER))) / max(n_letters, 1),
        math.sqrt(same / n),
        len(set(bare)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        math.sqrt(sum(w[-1:] in b".!?" for w in words) / n),
    )


MEASURED = ", ".join(f"{f} double" for f in (*FEATURES, "grams"))


def _measure(weights: np.ndarray | None):
    def run(texts: pa.Array) -> list[pa.Array]:
        found, grams = np.zeros((len(texts), len(FEATURES))), np.zeros(len(texts))
        for k, x in enumerate(texts):
            own = parsed(x.as_py())
            found[k] = counted(*own)
            if weights is not None:
                counts = bucket_counts(own[0], own[2])
                grams[k] = np.sqrt(counts) @ weights / math.sqrt(counts.sum() + FEW)
        return [*(pa.array(found[:, k]) for k in range(len(FEATURES))), pa.array(grams)]

    return run


def measure(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with the struct ``_found`` of FEATURES of their texts and what the weights give their shares; no shuffle."""
    return append_from_text(docs, _measure(weights), MEASURED)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    temperature: float = 1.0
    grams: np.ndarray | None = None  # weights of the buckets


def differences(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS_PER_ROW, seed: int = 7) -> np.ndarray:
    """Good less bad of ``pairs`` partners for each row of the rarer kind."""
    few, many = sorted((good, bad), key=len)
    a = np.repeat(few, pairs, axis=0)
    b = many[np.random.default_rng(seed).integers(0, max(len(many), 1), len(a))]
    return a - b if few is good else b - a


def slopes(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the summed logistic loss over differences."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d


def newton(told: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """``n`` weights of least loss with a small ridge, where ``told(weights)`` is the number of pairs, the gradient and the Hessian."""
    w = np.zeros(n)
    for _ in range(30):
        pairs, gradient, hessian = told(w)
        if not pairs:
            break
        step = np.linalg.solve(hessian / pairs + RIDGE * np.eye(n), gradient / pairs + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS_PER_ROW, seed: int = 7) -> np.ndarray:
    """Weights of least logistic loss over (good - bad) differences, by Newton's method with a small ridge."""
    d = differences(good, bad, pairs, seed)
    return newton(lambda w: (len(d), *slopes(d, w)), good.shape[1])


def gram_pairs(y: np.ndarray) -> int:
    """Pairs of a pass over rows with these labels."""
    n = sorted((int((y == 1).sum()), int((y == 0).sum())))
    return GRAM_PAIRS * min(n[1], 4 * n[0])


def rank_shares(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of buckets by logistic loss over sparse differences of pairs, good less bad; steps shrink with what a bucket has seen."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(2 * BUCKETS, np.float32), np.full(2 * BUCKETS, 1e-3, np.float32)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return weights
    for _ in range(GRAM_PASSES):
        n = gram_pairs(y)
        for g, b in zip(rng.choice(good, n), rng.choice(bad, n), strict=True):
            (i, u), (j, v) = rows[g], rows[b]
            p = 1 / (1 + np.exp(np.clip(weights[i] @ u - weights[j] @ v, -30, 30)))  # how much the pair surprises
            for at, step in ((i, -p * u), (j, p * v)):
                step = step + 1e-4 * weights[at]
                seen[at] += step * step
                weights[at] -= 0.5 * step / np.sqrt(seen[at])
    return weights


def two_halves(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weights of two halves, and of each row what the other half's weights give it."""
    side = np.arange(len(rows)) % 2
    both = [rank_shares([rows[k] for k in np.flatnonzero(side == h)], y[side == h]) for h in (0, 1)]
    given = np.array([both[1 - side[k]][at] @ value for k, (at, value) in enumerate(rows)])
    return (both[0] + both[1]) / 2, given


LEARNED = "doc_id long, quality int, h long, found array<double>, at binary, value binary"


def _told_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, quality, h, text`` -> the texts' features and shares; buckets as 16-bit, shares as 32-bit little-endian numbers."""
    for batch in batches:
        found, at, value = [], [], []
        for x in batch.column(3):
            raw, words, bare = parsed(x.as_py())
            found.append(counted(raw, words, bare))
            own = sparse(bucket_counts(raw, bare))
            at.append(own[0].astype("<u2").tobytes())
            value.append(own[1].astype("<f4").tobytes())
        lists = [pa.array(found, pa.list_(pa.float64())), pa.array(at, pa.binary()), pa.array(value, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["doc_id", "quality", "h", "found", "at", "value"])


def _shares_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    both = zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True)
    return [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4")) for a, v in both]


def _by_block(batches: Iterator[pa.RecordBatch], most: int, take: Callable[[pa.RecordBatch], list]) -> Iterator[tuple[int, list]]:
    """Rows in the order of their ``block`` -> each block with what ``take`` gives for its rows; one beyond ``most`` rows comes in parts."""
    held, now = [], None
    for batch in batches:
        for block, row in zip(batch.column("block").to_pylist(), take(batch), strict=True):
            if held and (block != now or len(held) >= most):
                yield now, held
                held = []
            now = block
            held.append(row)
    if held:
        yield now, held


#: Weights are added up as whole numbers of this size, so that the order of blocks makes no difference.
UNIT = 2.0**-20


def _learn(most: int):
    """Rows by block -> of a task and half the number of pairs, and the blocks' weights times their numbers of pairs, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pairs = np.zeros((2, 2 * BUCKETS), np.int64), [0, 0]
        for block, rows in _by_block(batches, most, lambda b: list(zip(b.column("half").to_pylist(), b.column("quality").to_pylist(), _shares_of(b), strict=True))):
            for half in (0, 1):
                own, y = [r[2] for r in rows if r[0] == half], np.array([r[1] for r in rows if r[0] == half], int)
                if n := gram_pairs(y):
                    sums[half] += np.rint(rank_shares(own, y, seed=7 + block) * (n / UNIT)).astype(np.int64)
                    pairs[half] += n
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(pairs), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["half", "pairs", "sums"])

    return run


def _given(both: np.ndarray):
    """Rows with shares -> their features and what the other half's weights give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [float(both[1 - h][at] @ value) for h, (at, value) in zip(batch.column("half").to_pylist(), _shares_of(batch), strict=True)]
            x = [[*f, g] for f, g in zip(batch.column("found").to_pylist(), given, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "h", "block")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "h", "block", "x"])

    return run


def _pack(most: int):
    """Rows by block -> a row for each block, its good and bad rows as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches, most, lambda b: list(zip(b.column("quality").to_pylist(), b.column("x").to_pylist(), strict=True))):
            good, bad = (np.array([x for y, x in rows if y == label], "<f8").tobytes() for label in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([good], pa.binary()), pa.array([bad], pa.binary())], ["block", "good", "bad"])

    return run


def _over_blocks(blocks: DataFrame, found: Callable[[int, np.ndarray, np.ndarray], list], ddl: str) -> DataFrame:
    """What ``found(block, good, bad)`` gives for each block, a list of rows."""
    names, n = [c.split()[0] for c in ddl.split(", ")], len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                told = found(row["block"], *(np.frombuffer(row[k], "<f8").reshape(-1, n) for k in ("good", "bad")))
                yield pa.RecordBatch.from_pydict({c: [r[k] for r in told] for k, c in enumerate(names)}, schema=schema)

    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    return blocks.mapInArrow(run, ddl)


def neighbours(blocks: DataFrame, value: Callable[[np.ndarray], np.ndarray], rows: int, k: int, at_once: int = SORTED_ROWS) -> tuple[float, float]:
    """The values of all rows at places ``k`` and ``k + 1`` of their order, exactly: the range is narrowed down until few enough are left to sort."""
    lo, hi, left = -math.inf, math.inf, rows
    while True:
        within = lambda good, bad: (v := value(np.concatenate((good, bad))))[(v >= lo) & (v <= hi)]  # noqa: B023, E731
        if left <= at_once:
            s = np.sort([r.v for r in _over_blocks(blocks, lambda _, g, b: [(x,) for x in within(g, b).tolist()], "v double").collect()])
            return float(s[k]), float(s[k + 1])
        edges = np.linspace(lo, hi, PARTS + 1)[1:-1] if lo > -math.inf else np.zeros(0)

        def parts(_, good, bad):
            v = np.sort(within(good, bad))  # noqa: B023
            part, first, n = np.unique(np.searchsorted(edges, v, side="right"), return_index=True, return_counts=True)  # noqa: B023
            return [(int(p), int(m), float(v[i]), float(v[i + m - 1])) for p, i, m in zip(part, first, n, strict=True)]

        told = _over_blocks(blocks, parts, "part long, n long, lo double, hi double").groupBy("part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("part").collect()
        ends = np.cumsum([r.n for r in told])
        a, b = np.searchsorted(ends, (k, k + 1), side="right")
        if a != b:
            return told[a].hi, told[b].lo
        if told[a].lo == told[a].hi:
            return told[a].lo, told[a].lo
        lo, hi, left, k = told[a].lo, told[a].hi, told[a].n, k - int(ends[a] - told[a].n)


def fit(blocks: DataFrame, grams: np.ndarray | None = None, at_once: int = SORTED_ROWS) -> Model:
    """The model of packed blocks. The driver gets sums of each block, one for some BLOCK_ROWS rows."""
    n = len(FEATURES) + 1

    def moments(block, good, bad):
        x = np.concatenate((good, bad))
        return [(block, len(good), len(bad), x.mean(axis=0).tolist(), ((x - x.mean(axis=0)) ** 2).sum(axis=0).tolist())]

    told = _over_blocks(blocks, moments, "block long, good long, bad long, mean array<double>, off array<double>").orderBy("block", "good", "bad", "mean").collect()
    n_good, n_bad = sum(r.good for r in told), sum(r.bad for r in told)
    if not n_good or not n_bad:
        return Model(np.zeros(n), np.ones(n), np.zeros(n), grams=grams)
    size, means = np.array([[r.good + r.bad] for r in told]), np.array([r.mean for r in told])
    mean = (size * means).sum(axis=0) / size.sum()
    scale = np.sqrt((np.array([r.off for r in told]) + size * (means - mean) ** 2).sum(axis=0) / size.sum())
    scale = np.where(scale > 1e-9, scale, 1.0)

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def of(block, good, bad):
            d = differences(good / scale, bad / scale, seed=7 + block) if len(good) and len(bad) else np.zeros((0, n))
            gradient, hessian = slopes(d, w)
            return [(block, len(d), gradient.tolist(), hessian.ravel().tolist())]

        rows = _over_blocks(blocks, of, "block long, pairs long, gradient array<double>, hessian array<double>").orderBy("block", "pairs", "gradient").collect()
        return sum(r.pairs for r in rows), np.sum([r.gradient for r in rows], axis=0), np.sum([r.hessian for r in rows], axis=0).reshape(n, n)

    model = Model(mean, scale, newton(sums, n), grams=grams)
    value = lambda x: ((x - mean) / scale * model.weights).sum(axis=1)  # noqa: E731  equal rows, equal values
    rows = n_good + n_bad
    model.threshold = sum(neighbours(blocks, value, rows, n_bad - 1, at_once)) / 2  # the quantile of the bad share
    off = neighbours(blocks, lambda x: np.abs(value(x) - model.threshold), rows, (rows - 1) // 2, at_once)
    model.temperature = float(max((off[0] if rows % 2 else sum(off) / 2) / 3, 1e-6))  # a third of the median
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality, text`` of every row whose label a model may see."""
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(~held_out() & F.col("quality").isin(0, 1))
    marks = stored(marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other"), "marks")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return own.where(~held_out()).join(F.broadcast(marks) if few else marks, "doc_id").select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> Model:
    """``(doc_id, text)`` and ``(doc_id, quality)`` -> model, from all labelled rows that aren't held out; their texts are measured once."""
    rows = labelled(docs, labels).select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    told = stored(rows.mapInArrow(_told_batches, LEARNED), "told")
    n, hashed = max(1, math.ceil(told.count() / block_rows)), F.xxhash64("doc_id", "h")
    told = told.withColumns({"block": F.pmod(F.shiftright(hashed, 8), F.lit(n)), "half": F.pmod(hashed, F.lit(2)).cast("int")})
    by_block = lambda x: x.repartition("block").sortWithinPartitions("block", "doc_id", "h")
    learned = by_block(told.drop("found")).mapInArrow(_learn(2 * block_rows), "half long, pairs long, sums array<long>")
    learned = learned.select("half", "pairs", F.posexplode("sums").alias("at", "w")).groupBy("half", "at").agg(F.sum("w").alias("w"), F.sum("pairs").alias("pairs"))
    both = np.zeros((2, 2 * BUCKETS), np.float32)
    for r in learned.where("w <> 0").collect():  # one for each half and bucket at most
        both[r.half, r.at] = r.w * UNIT / r.pairs
    given = told.mapInArrow(_given(both), "doc_id long, quality int, h long, block long, x array<double>")
    blocks = stored(by_block(given).mapInArrow(_pack(2 * block_rows), "block long, good binary, bad binary"), "blocks")
    return fit(blocks, both.mean(axis=0))


def score_column(model: Model) -> Column:
    """The score as an expression over ``_found``."""
    total = F.lit(float(-(model.mean / model.scale) @ model.weights - model.threshold))
    for name, w in zip((*FEATURES, "grams"), model.weights / model.scale, strict=True):
        total = total + F.col(f"_found.{name}") * F.lit(float(w))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total / F.lit(model.temperature)))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; no shuffle."""
    measured = measure(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model.grams)
    scored = measured.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected; texts are never shuffled."""
    model = train(docs, labels)
    return measure(docs, model.grams).where(score_column(model) >= 0.5).select(*docs.columns)
