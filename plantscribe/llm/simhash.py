"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has the majority of each bit over the hashes of a text's word shingles. Two fingerprints link at RADIUS or
fewer differing bits. With the 64 bits cut into RADIUS + 2 blocks, linked fingerprints agree on two blocks at least, so every
pair of blocks is a table of buckets and no link is lost. Where a billion fingerprints would crowd the buckets, three of RADIUS + 3
blocks or four of RADIUS + 4 have to agree, which loses none either. Rows of a partition are compared in blocks: bit planes lie
vertically, one machine word holds the same bit of 64 fingerprints, carry-save counters add up 64 distances at once, and a
block is abandoned once all of its distances exceed the radius. A bucket beyond CHUNK rows is dealt in pairs of chunks, so
that no task holds more than two chunks of it. A block gives the edges of a spanning forest of its links, not all pairs.

Copies with one fingerprint are one node. Null, empty and blank texts have fingerprint zero and link like any other. Rows
without a doc_id get the component of their fingerprint, null if no row with a doc_id has it. Rows that repeat a doc_id are nodes of their
own fingerprints; where these differ, the doc_id names both components. Texts of any length are hashed whole, in their own task. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, cut, hot_keys, spread_join

SHINGLE, SEED, RADIUS, CHUNK, BLOCK = 4, 42, 4, 2048, 1024
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fp)``; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def links_of(fps: np.ndarray, first: int, last: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, first <= i < last and i < j, within the radius, by vertical counters."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, words * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view(np.uint64)
    rows = np.arange(first, last)
    over = np.packbits(np.arange(words * 64)[None, :] <= rows[:, None], axis=1, bitorder="little").view(np.uint64)  # no pair twice
    if n % 64:
        over[:, -1] |= ALL << np.uint64(n % 64)
    counters = [np.zeros_like(over) for _ in range((radius + 1).bit_length())]

    def beyond() -> np.ndarray:
        more, same = np.zeros_like(over), np.full_like(over, ALL)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more

    for p in range(64):
        carry = planes[p][None, :] ^ (np.uint64(0) - bits[rows, p].astype(np.uint64))[:, None]
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry  # a counter ran over: never below the radius again
        if p % 8 == 7:
            over |= beyond()
            alive = (over != ALL).any(axis=1)
            if not alive.any():
                return rows[:0], rows[:0]
            if alive.mean() < 0.7:
                rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
    i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join all linked rows of a block, at most one fewer than rows."""
    root, edges = np.arange(len(fps)), []
    for first in range(0, len(fps), 256):
        rows, others = links_of(fps, first, min(first + 256, len(fps)), radius)
        for i, js in zip(np.unique(rows), np.split(others, np.flatnonzero(np.diff(rows)) + 1), strict=True) if len(rows) else ():
            for j in js[np.unique(root[js], return_index=True)[1]]:
                if root[j] != root[i]:
                    edges.append((int(i), int(j)))
                    root[root == root[j]] = root[i]
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> edges. Whole buckets are put together up to BLOCK rows, larger ones stand alone."""

    def flush(fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(fps) > 1 and (edges := forest(fps)):
            e = np.array(edges)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[e[:, 0]]), pa.array(nodes[e[:, 1]])], ["a", "b"])

    held = [np.empty(0, np.int64)] * 3  # fp, node, bucket
    for batch in batches:
        held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
        starts = np.flatnonzero(np.concatenate(([True], held[2][1:] != held[2][:-1])))
        done = 0
        for k in range(1, len(starts)):  # the last bucket may go on in the next batch
            nxt = starts[k + 1] if k + 1 < len(starts) else len(held[0])
            if nxt - done > BLOCK or k + 1 == len(starts):
                yield from flush(held[0][done : starts[k]].view(np.uint64), held[1][done : starts[k]])
                done = starts[k]
        held = [h[done:] for h in held]
    yield from flush(held[0].view(np.uint64), held[1])


def bucket_masks(radius: int = RADIUS, agreeing: int = 2) -> list[int]:
    """Masks of ``agreeing`` of radius + agreeing blocks each, as signed longs."""
    n = radius + agreeing
    cuts = [round(64 * k / n) for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(own) for own in combinations(blocks, agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def agreeing_blocks(fingerprints: int, per_bucket: int = 512, radius: int = RADIUS) -> int:
    """Blocks to agree on, so that evenly spread fingerprints leave no more than ``per_bucket`` in a bucket: 2 to 4."""
    for n in (2, 3):
        if fingerprints <= per_bucket << (64 * n // (radius + n)):
            return n
    return 4


def edges(nodes: DataFrame, chunk: int = CHUNK, agreeing: int | None = None) -> DataFrame:
    """Distinct fingerprints ``(fp, node)`` -> forest edges ``(a, b)`` of all links."""
    masks = bucket_masks(agreeing=agreeing or agreeing_blocks(nodes.count()))
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)))
    dealt = nodes.select("fp", "node", F.explode(tables).alias("b")).select("fp", "node", "b.t", "b.key")
    met = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = dealt.join(cut(met.select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))), ["t", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int"))
    partners = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("own")))
    rows = rows.withColumn("other", F.explode(partners))
    bucket = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))  # mixing two buckets adds only true links
    placed = rows.select("fp", "node", bucket.alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row."""
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    labels = connected_components(edges(nodes.where("node IS NOT NULL").select("fp", "node")))
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    met = spread_join(marked, named, ["fp"], hot_keys(nodes, ["fp"]))
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
