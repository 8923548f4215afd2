"""Substring deduplication by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among its MMER-word runs. Consecutive windows
that share a minimiser form a super-k-mer, which travels as one packed string to the bucket of that minimiser; equal
windows always meet there. A word goes when a window over it also starts in a document with a smaller doc_id.

What travels is cut down first, exactly:
1. per super-k-mer only minimiser, place and a digest of its words leave the texts. A minimiser of one document settles itself;
   one whose super-k-mers are all equal strings leaves the smallest document whole and covers the others;
2. where strings differ, each distinct one is packed once, by the smallest document that has it; holders beyond that
   document are covered in full;
3. in a bucket the windows of the packed strings are sorted and each is counted, word by word, by 128-bit digests.

A bucket has as many parts as its windows need, at PART_WINDOWS windows a part (some 10 MB in its task). In a bucket of one part
strings travel as they are; where there are more, a window goes to the part that its digest names, and a super-k-mer sends one packed
run of digests to each part. So no task holds more than a part, and rows grow with the strings. Minimisers, strings and
documents that hold more than a thousandth of the rows are dealt over several tasks when they are joined.

Strings count as equal when their minimisers (64 bits) and digests (64 bits) agree, windows by 128 bits.

Null, empty and short texts (under WINDOW words) keep all their words. Rows without a doc_id keep all their words and remove none
elsewhere. Rows that repeat a doc_id are judged one by one and never remove words from each other. Texts of any length are cut up
in their own task, so the longest text has to fit there. An empty table gives no rows. Other columns are ignored, but for those in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import HOT_ROWS, HOT_SHARE, cut, hot_keys, split_words, spread_join

WINDOW, MMER, PART_WINDOWS = 50, 8, 1 << 17
KEY = ["doc_id", "text_key"]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def super_kmers(words: list[bytes], window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers and first windows of the super-k-mers; the last one ends with the text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = np.zeros(len(words) - mmer + 1, np.uint64)
    for k in range(mmer):
        runs *= np.uint64(0xD6E8FEB86659FD93)
        runs += one[k : k + len(runs)]
    low, have, span = _mix(runs), 1, window - mmer + 1
    while have < span:  # minimum over `have` runs, doubled until it spans the window
        step = min(have, span - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[first].view(np.int64), first


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lows, firsts, counts, digests, sizes = [], [], [], [], [0]
            for text in part.column(2):
                words = split_words(text.as_py())
                low, first = super_kmers(words)
                count = np.diff(np.append(first, max(len(words) - WINDOW + 1, 0))) if len(first) else first
                digests.append(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[a : a + n + WINDOW - 1])) for a, n in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(first)).view(np.int64))
                lows.append(low), firsts.append(first), counts.append(count), sizes.append(sizes[-1] + len(low))
            offsets = pa.array(sizes, pa.int32())
            listed = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((lows, pa.int64()), (digests, pa.int64()), (firsts, pa.int32()), (counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *listed], [*KEY, "low", "digest", "first", "n"])


def window_digests(words: list[bytes]) -> np.ndarray:
    """128 bits of each window, as two columns."""
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    view, starts = memoryview(joined), (ends - sizes).tolist()
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts, ends[WINDOW - 1 :].tolist(), strict=False)), np.uint64).reshape(-1, 2)


RUN = np.dtype([("k", "<i4"), ("a", "<u8"), ("b", "<u8")])  # a window's place in its string and its digest


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings of super-k-mers; for buckets of several parts, runs of their windows' digests."""
    names = ["low", "part", *KEY, "first", "whole", "packed"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows, held = [], 0
        for doc_id, key, text, spans in zip(*(batch.column(k) for k in range(4)), strict=True):
            words = split_words(text.as_py())
            for s in spans.as_py():
                own = words[s["first"] : s["first"] + s["n"] + WINDOW - 1]
                place = (doc_id.as_py(), key.as_py(), s["first"])
                if s["parts"] == 1:
                    rows.append((s["low"], 0, *place, True, b" ".join(own)))
                    held += len(rows[-1][-1])
                else:
                    found = window_digests(own)
                    run = np.empty(len(found), RUN)
                    run["k"], run["a"], run["b"] = np.arange(len(found)), found[:, 0], found[:, 1]
                    part = (found[:, 0] % np.uint64(s["parts"])).astype(np.int32)
                    for r in np.unique(part).tolist():
                        rows.append((s["low"], r, *place, False, run[part == r].tobytes()))
                    held += run.nbytes
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)


def covered_in_part(rows: list[tuple[int, int, int, bool, bytes]]) -> list[np.ndarray]:
    """``(doc_id, text_key, first, whole, packed)`` of one part of a bucket -> columns ``doc_id, text_key, start, end`` of words to remove."""
    runs = []
    for *_, whole, packed in rows:
        if whole:
            found = window_digests(packed.split(b" "))
            run = np.empty(len(found), RUN)
            run["k"], run["a"], run["b"] = np.arange(len(found)), found[:, 0], found[:, 1]
        else:
            run = np.frombuffer(packed, RUN)
        runs.append(run)
    windows, own = np.concatenate(runs), np.repeat(np.arange(len(rows)), [len(r) for r in runs])
    doc_id, key, first = (np.array([r[k] for r in rows], np.int64)[own] for k in range(3))
    order = np.lexsort((doc_id, windows["b"], windows["a"]))
    a, b = windows["a"][order], windows["b"][order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    smallest = doc_id[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    covered = order[smallest < doc_id[order]]
    covered = covered[np.lexsort((windows["k"][covered], own[covered]))]
    k, own = windows["k"][covered], own[covered]
    if not len(k):
        return [np.empty(0, np.int64)] * 4
    start = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (k[1:] - k[:-1] > WINDOW))))
    end = np.append(start[1:], len(k)) - 1
    at = covered[start]
    return [doc_id[at], key[at], first[at] + k[start], first[at] + k[end] + WINDOW]


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, part and place -> covered spans; one part in memory at a time, a repeated row once."""

    def flush(group: list) -> Iterator[pa.RecordBatch]:
        if len(group) > 1 and len((found := covered_in_part(group))[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*KEY, "start", "end"])

    now, group = None, []
    for batch in batches:
        for low, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (low, part) != now:
                yield from flush(group)
                now, group = (low, part), []
            if not group or group[-1][:3] != tuple(row[:3]):
                group.append(tuple(row))
    yield from flush(group)


def covered_spans(docs: DataFrame, described: DataFrame, part_windows: int) -> DataFrame:
    """``(doc_id, text_key, text)`` -> ``(doc_id, text_key, start, end)``: words to remove, spans may overlap."""
    each = described.select(*KEY, F.explode(F.arrays_zip("low", "digest", "first", "n")).alias("s")).select(*KEY, "s.*")
    ends = (F.col("first") + F.col("n") + (WINDOW - 1)).alias("end")

    # 1. minimisers of several documents, one row each
    counts = each.groupBy("low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), (F.min("digest") != F.max("digest")).alias("differ"), F.count("*").alias("rows"))
    total = described.agg(F.sum(F.size("low")).alias("n")).first()["n"] or 0
    busy = F.col("rows") > F.lit(max(total / HOT_SHARE, HOT_ROWS))
    shared = cut(counts.where((F.col("owner") < F.col("last")) | busy))
    frequent = shared.where(busy).select("low")
    met = cut(spread_join(each, shared.where("owner < last").select("low", "owner", "differ"), ["low"], frequent))
    alike = met.where("NOT differ AND doc_id > owner").select(*KEY, F.col("first").alias("start"), ends)

    # 2. distinct strings of the others, with the smallest document of each and the number of parts of the bucket
    differing = met.where("differ").drop("owner", "differ")
    strings = cut(differing.groupBy("low", "digest").agg(F.min("doc_id").alias("owner"), F.max("n").alias("n"), F.count("*").alias("rows")))
    parts = strings.groupBy("low").agg(F.ceil(F.sum("n") / part_windows).cast("int").alias("parts"))
    known = cut(spread_join(strings.select("low", "digest", "owner"), parts, ["low"], frequent))
    owned = spread_join(differing, known, ["low", "digest"], hot_keys(strings, ["low", "digest"], "rows"))
    holders = owned.where("doc_id > owner").select(*KEY, F.col("first").alias("start"), ends)

    # 3. packed strings to their buckets
    spans = owned.where("doc_id = owner").groupBy(*KEY).agg(F.collect_set(F.struct("low", "first", "n", "parts")).alias("spans"))
    packed = docs.select(*KEY, "text").join(spans, KEY).mapInArrow(_pack, "low long, part int, doc_id long, text_key long, first int, whole boolean, packed binary")
    placed = packed.repartition("low", "part").sortWithinPartitions("low", "part", *KEY, "first")
    return alike.unionByName(holders).unionByName(placed.mapInArrow(_count_windows, "doc_id long, text_key long, start int, end int"))


def _apply(names: list[str]):
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}

    def one(text: str | None, spans: list[dict] | None) -> tuple:
        words = split_words(text)
        kept = words
        if spans:
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, [s["start"] for s in spans], 1)
            np.add.at(gone, [s["end"] for s in spans], -1)
            kept = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
        joined = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), text if len(kept) == len(words) else joined.decode("utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = zip(*map(one, part.column(0).to_pylist(), part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(x, t) for x, t in zip(found, kinds.values(), strict=True))], [*names, *kinds])

    return run


def deduplicate(docs: DataFrame, keep: tuple[str, ...] = (), part_windows: int = PART_WINDOWS) -> DataFrame:
    """``doc_id``, the columns named in ``keep``, ``n_words, n_removed, kept_sha256, kept_text`` of each row.

    kept_text is the text itself where nothing goes, else the kept words joined by single blanks.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"), *keep)
    described = cut(keyed.where("doc_id IS NOT NULL").select(*KEY, "text").mapInArrow(_describe, "doc_id long, text_key long, low array<long>, digest array<long>, first array<int>, n array<int>"))
    spans = covered_spans(keyed, described, part_windows).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    repeated = hot_keys(described.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)
    names = ["doc_id", *keep]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*names).schema.fields)
    met = spread_join(keyed, spans, KEY, repeated, "left")
    return met.select("text", "gone", *names).mapInArrow(_apply(names), f"{kept}, n_words long, n_removed long, kept_sha256 string, kept_text string")
