"""Importance resampling towards a target distribution, by hashed runs of words.

A 256-byte table lower-cases A-Z and blanks every byte that is neither a letter, a digit nor beyond ASCII, so UTF-8 is translated and
split without decoding. A run of words is hashed by chaining ``zlib.crc32``: the seed of a longer run is the checksum of the run
before its last word. Counters reduce a task's features to BUCKETS numbers before anything is shuffled. A bucket's gain is the
logarithm of its share in the target over its share in the documents, both smoothed by one; a document's weight is the mean gain of
its features. Gumbel noise of the seeded hash of the doc_id is added, so that the highest scores are a sample drawn by importance.

Null, empty and blank texts, and texts of separators alone, have no features, weight 0 and are never drawn, having too few words. Rows that
repeat a doc_id are scored one by one, and a row without one is hashed by an empty id and comes last among ties. Of equal scores the
smaller doc_id is first. Texts of any length are read whole. Empty tables give no rows; an empty target has no features, its buckets the same share.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import positions
from .common import CRC_TABLE_SQL, crc32_sql, stored

#: Longest run of words, number of buckets, seed of the noise, words that a drawn document has, and percent drawn.
LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(TABLE).split()


def checksums(own: list[bytes], longest: int = LONGEST) -> Iterator[list[int]]:
    """The CRC-32 of all runs of one word, of two words, ... joined by one space."""
    seeds = list(map(zlib.crc32, own))
    yield seeds
    for k in range(1, longest):
        seeds = [zlib.crc32(word, zlib.crc32(b" ", seed)) for seed, word in zip(seeds, own[k:], strict=False)]
        yield seeds


def _count(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for runs in checksums(words(text.as_py()), longest):
                    found.update([crc % buckets for crc in runs])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(text)`` -> ``(bucket, n)``; a task sends no more rows than there are buckets."""
    each = texts.select(F.col("text").cast("string")).mapInArrow(_count(longest, buckets), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket, rounded down. Two times ``buckets`` numbers come to the driver, whatever the tables hold."""
    own, aim = ([0] * buckets for _ in range(2))
    for texts, into in ((docs, own), (target, aim)):
        for bucket, n in bucket_counts(texts, longest, buckets).collect():
            into[bucket] = n
    total, aimed = sum(own), sum(aim)
    return np.array([math.floor(1000 * math.log((t + 1) * (total + buckets) / ((s + 1) * (aimed + buckets)))) for s, t in zip(own, aim, strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, text in enumerate(batch.column(1)):
                own = words(text.as_py())
                n_words[k] = len(own)
                for runs in checksums(own, longest):
                    n_features[k] += len(runs)
                    weight[k] += gain[np.array(runs, np.int64) % len(gain)].sum() if runs else 0
            weight //= np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise of the hash of ``seed:doc_id``, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each document; texts are read where they lie and never shuffled."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    weighed = own.mapInArrow(_weigh(gains(own, target, longest, buckets), longest), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **settings: int) -> DataFrame:
    """``scored`` with the ``rank`` of drawn documents, ``percent`` of those with ``least_words`` or more; null elsewhere."""
    rows = stored(scored(docs, target, **settings), "scored").withColumn("_able", F.col("n_words") >= least_words)
    drawn = F.lit(rows.agg(F.count_if("_able").alias("n")).first()["n"] * percent // 100)
    order = [F.desc("_able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.xxhash64(F.monotonically_increasing_id())]
    rank = F.when(F.col("_able") & (F.col("_place") < drawn), F.col("_place") + 1)
    return positions(rows, order, "_place").withColumn("rank", rank).drop("_able", "_place")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Runs of one word: distinct words are hashed once.
ORACLE_SQL = f"""WITH own AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents), aim AS (SELECT {_WORDS_SQL} AS ws FROM benchmark),
vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM own UNION ALL SELECT ws FROM aim)), hashed AS (SELECT w, {crc32_sql('w')} % {BUCKETS} AS bucket FROM vocabulary, (SELECT {CRC_TABLE_SQL} AS crc_table)),
each AS (SELECT doc_id, unnest(ws) AS w FROM own), s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(ws) AS w FROM aim) JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM each JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM own LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND k <= n * {PERCENT} // 100 THEN k END AS rank FROM ranked"""
