"""Near-duplicates by bit-sliced SimHash comparison, confirmed by exact Jaccard similarity of word shingles.

Two texts link where the sets of their WORDS-word shingles (lower-cased A-Z) have a Jaccard similarity of SIMILAR or more.
Texts with equal sets are one node (128-bit digest of the set). A fingerprint wide enough for 0.8 can't be cut into blocks that
agree, so groups are formed first: nodes that share one of BANDS MinHash keys of ROWS minima each are joined to the key's smallest
node, not in pairs, and nodes joined by such links are a group; rows grow with the nodes only. At a similarity of 0.8 a pair
shares no key with a probability of 0.0004. Each group meets in a task, where the SimHash fingerprints of the shingles are compared
bit-sliced (``simhash.links_of``): at 0.8 some 10 of 64 bits differ, and more than RADIUS with a probability below 0.0001. Pairs
within the radius that aren't joined yet are compared exactly. A group beyond CHUNK nodes is dealt in chunks, and its smallest node, the
leader, is compared in each of them. Nodes that are joined to the leader then need no comparison among each other: only the rest is
compared with the group, in pairs of chunks. A group of copies of one text travels once, whatever its size.

Shingles are 64-bit hashes. Null, empty and blank texts have the empty set and are copies of each other; shorter texts have one
shingle. Rows are told apart by a number of their own, so rows that repeat a doc_id or have none are compared like any other.
Texts of any length are hashed whole, in their own task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, cut, hot_keys, spread_join, stored
from .simhash import links_of

WORDS, SIMILAR, RADIUS, BANDS, ROWS, CHUNK, SEED = 5, 0.8, 26, 20, 5, 1024, 42
FACTORS, SHIFTS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    length = min(WORDS, len(words))
    runs = np.zeros(len(words) - length + 1 if words else 0, np.uint64)
    for k in range(length):
        runs = runs * STEP + one[k : k + len(runs)]
    return np.unique(_mix(runs + np.uint64(length)))


def bands(own: np.ndarray) -> np.ndarray:
    """The MinHash key of each band; none for the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(own), 4096):
        low = np.minimum(low, (own[k : k + 4096, None] * FACTORS + SHIFTS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * STEP + low[k::ROWS])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in rows)])))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py()) for x in batch.column(1)]
        digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, _lists([bands(x) for x in sets])], ["row", "digest", "bands"])


def fingerprint(own: np.ndarray) -> int:
    """The majority of each bit over the shingles, as a signed long."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(x.as_py()) for x in part.column(1)]
            prints = pa.array([fingerprint(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), prints, _lists(sets)], ["node", "joined", "buckets", "fp", "own"])


def forest(nodes: list[int], joined: list[int], fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join all linked nodes of a group, at most one fewer than nodes. Nodes with one ``joined`` are joined already."""
    root, sizes, edges = np.unique(joined, return_inverse=True)[1], np.array([len(x) for x in sets]), []
    for first in range(0, len(nodes), 256):
        rows, others = links_of(fps, first, min(first + 256, len(nodes)), RADIUS)
        for i, js in zip(np.unique(rows).tolist(), np.split(others, np.flatnonzero(np.diff(rows)) + 1), strict=True) if len(rows) else ():
            js = js[(root[js] != root[i]) & (np.minimum(sizes[js], sizes[i]) >= SIMILAR * np.maximum(sizes[js], sizes[i]))]
            for j in js.tolist():
                if root[j] != root[i] and jaccard(sets[i], sets[j]) >= SIMILAR:
                    edges.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> edges."""

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        node, joined, prints, sets = zip(*rows, strict=True) if rows else ((), (), (), ())
        if len(rows) > 1 and (found := forest(node, joined, np.array(prints, np.int64).view(np.uint64), sets)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    held, bucket = [], None
    for batch in batches:
        for k, (b, node, joined, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if b != bucket:
                yield from flush(held)
                held, bucket = [], b
            held.append((node, joined, fp, batch.column(4)[k].values.to_numpy().view(np.uint64).copy()))  # a view would hold its whole batch
    yield from flush(held)


def _meet(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """``dealt(row, joined, buckets)``: the texts go to all of their buckets; edges ``(a, b)`` of the links within. Mixing two buckets adds only true links."""
    found = rows.select("row", "text").join(dealt.select("row", "joined", "buckets"), "row").mapInArrow(_sets, "node long, joined long, buckets array<long>, fp long, own array<long>")
    placed = found.select(F.explode("buckets").alias("bucket"), "node", "joined", "fp", "own").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_compare, "a long, b long")


def _chunk(n: str, size: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(1)), F.greatest(F.ceil(F.col(n) / size), F.lit(1))).cast("int")


def _numbers(n: Column) -> Column:
    """0 up to n, exclusive; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _rest(rows: DataFrame, members: DataFrame, near: DataFrame, chunk: int) -> DataFrame:
    """Edges in groups beyond a chunk that the leader and the single chunks left open: nodes that aren't joined to the leader, with all."""
    labels = connected_components(near)
    large = cut(members.where(F.col("n") > chunk).select("row", "grp").join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("joined", F.coalesce("component", "row")))
    open_ = F.col("joined") != F.col("grp")  # the leader is the smallest of its group
    sizes = cut(large.groupBy("grp").agg(F.count_if(open_).alias("n_open"), F.count_if(~open_).alias("n_done"), F.count("*").alias("n")).where("n_open > 0"))
    met = spread_join(large, sizes.drop("n"), ["grp"], hot_keys(sizes, ["grp"]))
    chunks = lambda n: F.ceil(F.col(n) / chunk)
    mine = F.when(open_, _chunk("n_open", chunk)).otherwise(_chunk("n_done", chunk))
    pair = lambda kind, a, b: F.xxhash64("grp", F.lit(kind), a, b)
    among = F.transform(_numbers(chunks("n_open")), lambda k: pair(0, F.least("mine", k), F.greatest("mine", k)))
    across = F.transform(_numbers(chunks("n_done")), lambda k: pair(1, F.col("mine"), k))
    to_open = F.transform(_numbers(chunks("n_open")), lambda k: pair(1, k, F.col("mine")))
    buckets = F.when(open_, F.concat(among, across)).otherwise(to_open)
    return _meet(rows, cut(met.withColumn("mine", mine).withColumn("buckets", buckets).select("row", "joined", "buckets")))


def edges(rows: DataFrame, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Texts of ``rows`` and distinct sets ``(node, bands)`` -> forest edges ``(a, b)`` of all links."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a", "n")
    first = cut(first)
    met = spread_join(keyed, first.select("key", "a"), ["key"], hot_keys(first, ["key"]))
    groups = connected_components(met.where("node <> a").select("a", F.col("node").alias("b")).distinct())
    sizes = cut(groups.groupBy("component").agg(F.count("*").alias("n")))
    sized = spread_join(groups, sizes, ["component"], hot_keys(sizes, ["component"]))
    members = cut(sized.select(F.col("node").alias("row"), F.col("component").alias("grp"), "n"))
    places = F.when(F.col("row") == F.col("grp"), _numbers(F.ceil(F.col("n") / chunk))).otherwise(F.array(_chunk("n", chunk)))
    dealt = members.select("row", F.col("row").alias("joined"), F.transform(places, lambda k: F.xxhash64("grp", k)).alias("buckets"))
    near = _meet(rows, dealt)
    if members.where(F.col("n") > chunk).isEmpty():
        return near
    near = stored(near, "near")
    return near.unionByName(_rest(rows, members, near, chunk))


def components(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(row, text)``, rows numbered and stored -> ``(row, component)``, the smallest row of each group."""
    marked = cut(rows.select("row", F.col("text").cast("string")).mapInArrow(_describe, "row long, digest binary, bands array<long>"))
    counted = cut(marked.groupBy("digest").agg(F.min("row").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    labels = connected_components(edges(rows, counted.select("node", "bands"), chunk))
    named = counted.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return spread_join(marked.select("row", "digest"), named, ["digest"], hot_keys(counted, ["digest"])).select("row", "component")


def representatives(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(row, doc_id, text)`` -> the ``row`` of each group that has the smallest doc_id; one without a doc_id only where no row has one."""
    met = components(rows, chunk).join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")
    return met.groupBy("component").agg(first).select("m.row")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, as a stored table."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, component_id`` of each row: the smallest doc_id of its group, null if none has one."""
    rows = numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    met = cut(components(rows, chunk).join(rows.select("row", "doc_id"), "row"))
    named = cut(met.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    return spread_join(met, named.drop("n"), ["component"], hot_keys(named, ["component"])).select("doc_id", "component_id")
