"""Lexical, dense and merged retrieval for a table of queries; each step is a join or an aggregate over all queries at once."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as X
from ..session import stored

K1, TOP_CAP, RERANK_CAP, BUDGET_TOKENS = 1.5, 50, 12, 6000
DIMENSIONS = 64


#: Bytes of lower-cased UTF-8 that index terms consist of; all others part them. Stop words and single characters are no terms.
TERM_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_-" else 32 for b in range(256))
NO_TERMS = (*(w.encode() for w in X.INDEX_STOP_WORDS if len(w) > 1), *(bytes([b]) for b in sorted(set(TERM_BYTES) - {32})))
#: Chunks that are counted at a time, and terms whose dimensions a task remembers.
COUNTED_CHUNKS, KNOWN_TERMS = 512, 1 << 18


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms that ``X.index_tokens`` finds in a lower-cased text, each with its number."""
    found = Counter(text.translate(TERM_BYTES).split())
    for word in NO_TERMS:
        found.pop(word, None)
    return found


#: Forms of counted terms; ``joined`` has the distinct terms in one string, parted by spaces, which no term holds.
COUNTED = {
    "lists": {"_n": "int", "_terms": "array<string>", "_counts": "array<long>"}, "joined": {"_n": "int", "_terms": "string", "_counts": "array<long>"},
    "dimensions": {"_n": "int", "_counts": "array<long>"},
}


def _counted(form: str):
    """Rows whose last column is a lower-cased text -> in its place the number of terms, and the distinct ones with their numbers, or
    the numbers by dimension."""
    hashed = form == "dimensions"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def dimensions(found: Counter[bytes]) -> list[int]:
            own = [0] * DIMENSIONS
            for term, n in found.items():
                at = known.get(term)
                if at is None:
                    if len(known) >= KNOWN_TERMS:
                        known.clear()
                    at = known[term] = int(hashlib.md5(term).hexdigest()[:7], 16) % DIMENSIONS
                own[at] += n
            return own

        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_CHUNKS):
                batch = whole.slice(at, COUNTED_CHUNKS)
                names, counts, ends, sizes = [], [], [0], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    found = term_counts(text)
                    sizes.append(found.total())
                    if form == "joined":
                        names.append(b" ".join(found))
                    elif not hashed:
                        names.extend(found)
                    counts.extend(dimensions(found) if hashed else found.values())
                    ends.append(len(counts))
                listed = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)  # noqa: B023, E731
                told = [] if hashed else [pa.array(names, pa.binary()).cast(pa.string())]
                told = [*(told if form == "joined" else map(listed, told)), listed(pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32()), *told], [*batch.schema.names[:-1], *COUNTED[form]])

    return run


def counted_terms(chunks: DataFrame, keys: list[str], text: str = "text", form: str = "lists") -> DataFrame:
    """``keys, _n, _terms, _counts`` of each row with a term: its terms' number, and the distinct ones beside their numbers; or the
    numbers of all dimensions (``form``, of COUNTED). No shuffle."""
    rows = chunks.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in COUNTED[form].items())).fields])
    return rows.mapInArrow(_counted(form), schema).where("_n > 0")


def postings(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, term, tf``: the share of a term among its chunk's kept tokens.

    Terms are counted within their row, and rows are dealt by their keys while their terms are still lists, so that nothing shuffles
    again; rows that repeat their keys add up.
    """
    each = counted_terms(chunks, keys, text).repartition(*keys).select(*keys, "_n", F.explode(F.arrays_zip("_terms", "_counts")).alias("_x"))
    return each.groupBy(*keys, "_n", F.col("_x._terms").alias("term")).agg(F.sum("_x._counts").alias("_c")).select(*keys, "term", (F.col("_c") / F.col("_n")).alias("tf"))


def term_vectors(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, dimension, weight``: sparse unit vectors of hashed term counts, the embedder that needs no model.

    Counts by dimension and norms are summed up within the row; rows are dealt by their keys once, since those that repeat them add up.
    """
    whole = counted_terms(chunks, keys, text, "dimensions").groupBy(*keys).agg(F.collect_list("_counts").alias("_all"))  # rows that repeat their keys
    both = F.aggregate("_all", F.array_repeat(F.lit(0).cast("long"), DIMENSIONS), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    whole = whole.select(*keys, F.when(F.size("_all") == 1, F.get("_all", 0)).otherwise(both).alias("_all"))
    norm = F.sqrt(F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + x * x))
    each = whole.withColumn("_norm", norm).select(*keys, "_norm", F.posexplode_outer("_all").alias("dimension", "_n")).where("_n > 0")
    return each.select(*keys, "dimension", F.round(F.col("_n") / F.col("_norm"), 6).alias("weight"))


def term_lists(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, n_tokens, terms, counts``: the postings of a chunk in one row, its distinct terms parted by spaces, and their numbers.

    Rows are packed where they lie, without a shuffle; only those that repeat their keys meet, and add up to one.
    """
    each = counted_terms(chunks, keys, text, "joined").select(*keys, F.col("_n").alias("n_tokens"), F.col("_terms").alias("terms"), F.col("_counts").alias("counts"))
    twice = stored(chunks.groupBy(*keys).count().where("count > 1").select(*(F.col(c).alias(f"_{c}") for c in keys)), "repeats")
    if twice.isEmpty():
        return each
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))
    found = each.join(twice, same, "left_semi").select(*keys, "n_tokens", F.explode(F.arrays_zip(split_terms(), "counts")).alias("_x"))
    found = found.groupBy(*keys, F.col("_x.terms").alias("_t")).agg(F.max("n_tokens").alias("_n"), F.sum("_x.counts").alias("_c"))
    met = found.groupBy(*keys).agg(F.max("_n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("_t", "_c"))).alias("_x"))
    return each.join(twice, same, "left_anti").unionByName(met.select(*keys, "n_tokens", F.array_join("_x._t", " ").alias("terms"), F.col("_x._c").alias("counts")))


def split_terms() -> Column:
    """The terms of ``term_lists`` as an array."""
    return F.split("terms", " ").alias("terms")


def posted(lists: DataFrame) -> DataFrame:
    """``term_lists`` as postings, ``term, tf`` beside the other columns."""
    rest = [c for c in lists.columns if c not in ("n_tokens", "terms", "counts")]
    each = lists.select(*rest, "n_tokens", F.explode(F.arrays_zip(split_terms(), "counts")).alias("_x"))
    return each.select(*rest, F.col("_x.terms").alias("term"), (F.col("_x.counts") / F.col("n_tokens")).alias("tf"))


def _dimension_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are terms and their numbers -> in their place the numbers of all dimensions and their norm; a term is hashed once a batch."""
    for batch in batches:
        terms, counts, n = pc.split_pattern(batch.column(batch.num_columns - 2), " "), batch.column(batch.num_columns - 1), batch.num_rows
        names = terms.flatten().dictionary_encode()
        at = np.array([int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % DIMENSIONS for t in names.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy())
        sums = np.bincount(row * DIMENSIONS + at[names.indices.to_numpy()], counts.flatten().to_numpy(), n * DIMENSIONS).astype(np.int64) if len(at) else np.zeros(n * DIMENSIONS, np.int64)
        own = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIMENSIONS, pa.int32()), pa.array(sums))
        norm = np.sqrt((sums.reshape(n, DIMENSIONS) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], own, pa.array(norm)], [*batch.schema.names[:-2], "_all", "_norm"])


def vector_lists(lists: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, weights`` from ``term_lists``: ``term_vectors`` in one row, null in dimensions without a term. No shuffle."""
    rows = lists.select(*keys, "terms", "counts")
    whole = rows.mapInArrow(_dimension_counts, StructType([*rows.schema.fields[:-2], *StructType.fromDDL("_all array<long>, _norm double").fields]))
    return whole.select(*keys, F.transform("_all", lambda x: F.when(x > 0, F.round(x / F.col("_norm"), 6))).alias("weights"))


def pointed(lists: DataFrame) -> DataFrame:
    """``vector_lists`` as rows, ``dimension, weight`` beside the other columns."""
    rest = [c for c in lists.columns if c != "weights"]
    return lists.select(*rest, F.posexplode("weights").alias("dimension", "weight")).where("weight IS NOT NULL")


def document_frequencies(rows: DataFrame, document: str = "doc_id", scope: list[str] = ()) -> DataFrame:
    return rows.groupBy(*scope, "term").agg(F.countDistinct(document).alias("df"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "query_text", extra: list[str] = ()) -> DataFrame:
    """Distinct index terms of each query."""
    return queries.select(query, *extra, F.explode(F.array_distinct(X.index_tokens(F.col(text)))).alias("term"))


def asked_postings(chunks: DataFrame, terms: DataFrame, keys: list[str], scope: list[str] = (), text: str = "text") -> DataFrame:
    """``keys, scope, term, tf`` of the terms that queries ask for, and of the empty term, which every chunk with a token has.

    One pass over the texts: terms that nobody asks for go before anything is counted or shuffled, and the empty term's rows give the
    size of the corpus. What is left is written as a table, since frequencies, size and scores all read it.
    """
    wanted = terms.select(*scope, "term").distinct()
    wanted = wanted.unionByName(wanted.select(*scope, F.lit("").alias("term")).distinct())
    own = [c for c in scope if c not in keys]
    tokens = counted_terms(chunks, [*keys, *own], text)
    whole = F.struct(F.lit("").alias("_terms"), F.lit(1).cast("long").alias("_counts"))
    each = tokens.select(*keys, *own, "_n", F.explode(F.array_append(F.arrays_zip("_terms", "_counts"), whole)).alias("_x"))
    each = each.select(*keys, *own, "_n", F.col("_x._terms").alias("term"), "_x._counts").join(wanted, [*scope, "term"], "left_semi")
    counted = each.groupBy(*keys, *own, "_n", "term").agg(F.sum("_counts").alias("_c"))
    return stored(counted.select(*keys, *own, "term", (F.col("_c") / F.col("_n")).alias("tf")), "asked")


#: Postings and queries of a cell that a task holds while it scores.
CELL_POSTINGS, CELL_QUERIES = 1 << 20, 2048


def _starts(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Where sorted rows differ from the row before; nulls are equal."""
    new = np.arange(len(columns[0])) == 0
    for c in columns:
        at = c.combine_chunks().dictionary_encode(null_encoding="encode")
        at = (pa.concat_arrays(at.chunks) if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy(zero_copy_only=False)
        new[1:] |= at[1:] != at[:-1]
    return new


def _scores(keys: list[str], k: int):
    """A cell's weights of queries' terms, then its postings in the order of ``keys`` -> the k best chunks of each query within the cell."""

    def best(cell: pa.Table) -> pa.RecordBatch | None:
        asked, held = cell.filter(pc.equal(cell["kind"], 0)), cell.filter(pc.equal(cell["kind"], 1))
        if not asked.num_rows or not held.num_rows:
            return None
        names = held["term"].combine_chunks().dictionary_encode()
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        term, tf = names.indices.to_numpy(), held["value"].to_numpy()
        first = _starts([held[c] for c in keys])
        place = np.cumsum(first) - 1
        by_term = np.argsort(term, kind="stable")
        place, tf, term = place[by_term], tf[by_term], term[by_term]
        ends = np.searchsorted(term, np.arange(len(names.dictionary) + 1))
        twice = bool(((place[1:] == place[:-1]) & (term[1:] == term[:-1])).any())  # rows that repeat their keys
        wanted = pc.index_in(asked["term"], value_set=names.dictionary).to_numpy()
        weight, heads = asked["value"].to_numpy(), np.flatnonzero(_starts([asked["query_id"]]))
        queries, chunks, found = [], [], []
        score = np.zeros(int(first.sum()))
        for lo, hi in zip(heads, [*heads[1:], len(weight)], strict=True):
            score[:] = 0
            for t, idf in zip(wanted[lo:hi], weight[lo:hi], strict=True):
                if t == t:  # terms without a posting here are null
                    own = slice(ends[int(t)], ends[int(t) + 1])
                    more = idf * tf[own] * (K1 + 1) / (tf[own] + K1)
                    if twice:
                        np.add.at(score, place[own], more)
                    else:
                        score[place[own]] += more
            at = np.flatnonzero(score)
            told = np.round(score[at], 9)
            if len(at) > k:  # all from the k-th best score on, ties included
                near = told >= np.partition(told, -k)[-k]
                at, told = at[near], told[near]
            order = np.lexsort((at, -told))[:k]
            queries.append(np.full(len(order), lo))
            chunks.append(at[order])
            found.append(told[order])
        rows = held.select(keys).take(np.flatnonzero(first)[np.concatenate(chunks)])
        out = [asked["query_id"].take(np.concatenate(queries)), *(rows[c] for c in keys), pa.chunked_array([np.concatenate(found)])]
        return pa.table(out, ["query_id", *keys, "_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def told() -> Iterator[pa.RecordBatch]:
            found = best(pa.Table.from_batches(parts)) if parts else None
            if found is not None:
                yield from found.to_batches()

        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if cells[lo] != current:
                        yield from told()
                        current, parts = cells[lo], []
                    parts.append(batch.slice(lo, hi - lo))
        yield from told()

    return run


def bm25(chunks: DataFrame, terms: DataFrame, keys: list[str], document: str = "doc_id", scope: list[str] = (), k: int = 10) -> DataFrame:
    """Best chunks of each query: ``query_id, keys, score, rank``; scores over the query's best score.

    The postings that queries ask for are dealt by chunk, the queries by id: a cell of that grid scores its queries over its chunks and
    gives the best of each, so that matches of queries and postings, many times the postings, are neither shuffled nor written. A cell has about
    CELL_POSTINGS postings (a chunk's are together) and CELL_QUERIES queries. The formula has no length normalisation.
    """
    k = min(k, TOP_CAP)
    rows = asked_postings(chunks, terms, keys, scope)
    total = rows.where("term = ''").groupBy(*scope).agg(F.countDistinct(document).alias("_N"))
    asked = rows.where("term <> ''")
    matched = terms.join(document_frequencies(asked, document, scope), [*scope, "term"])
    matched = matched.join(total, list(scope)) if scope else matched.join(F.broadcast(total))  # one row
    idf = F.log((F.col("_N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    term = F.to_json(F.struct(*scope, "term")) if scope else F.col("term")
    weights = stored(matched.select("query_id", term.alias("term"), idf.alias("value")), "weights")
    n_postings, n_queries = asked.count(), weights.select("query_id").distinct().count()
    across = max(1, -(-n_queries // CELL_QUERIES))
    down = max(1, -(-n_postings // CELL_POSTINGS), min(rows.sparkSession.sparkContext.defaultParallelism, n_postings // 1000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    nulls = {c: F.lit(None).cast(rows.schema[c].dataType) for c in keys}
    held = asked.select(*keys, term.alias("term"), F.col("tf").alias("value")).withColumns({"kind": F.lit(1), "query_id": F.lit(None).cast(weights.schema["query_id"].dataType), "_d": place(down, *keys), "_a": every(across)})
    if across > 1:  # postings go only where a query of the cell asks for them
        held = held.join(weights.select(place(across, "query_id").alias("_a"), "term").distinct(), ["_a", "term"], "left_semi")
    sent = weights.withColumns({"kind": F.lit(0), **nulls, "_a": place(across, "query_id"), "_d": every(down)}).unionByName(held)
    cell = (F.col("_a") * F.lit(down).cast("long") + F.col("_d")).alias("cell")
    cells = sent.select(cell, "kind", "query_id", *keys, "term", "value").repartition(across * down, "cell").sortWithinPartitions("cell", "kind", "query_id", *keys)
    schema = StructType([*(cells.schema[c] for c in ("query_id", *keys)), StructField("_s", DoubleType())])
    scored = cells.mapInArrow(_scores(keys, k), schema)
    best = W.partitionBy("query_id").orderBy(F.desc("_s"), *keys)
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    peak = F.max("_s").over(W.partitionBy("query_id"))
    return top.select("query_id", *keys, F.round(F.col("_s") / F.when(peak == 0, 1.0).otherwise(peak), 6).alias("score"), "rank")


#: Vectors of a block, query blocks and row blocks of a cell, and pivots that vectors are put together by.
BLOCK, QUERY_BLOCKS, ROW_BLOCKS, PIVOTS = 1024, 4, 64, 16
BLOCKS = "block long, ids array<long>, vectors binary, middle binary, reach double"


def _packed(pivots: np.ndarray, size: int):
    """Unit vectors -> blocks of near ones: ids, the matrix, its middle as a unit vector and the largest angle to it."""

    def block(number: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> tuple:
        ids_, flat = np.concatenate(ids), np.concatenate(rows)
        middle = flat.mean(axis=0)
        length = float(np.sqrt(middle @ middle))
        zero = (flat * flat).sum(axis=1) < 0.5  # a zero vector has no direction: such a block is never skipped
        reach = float(np.arccos(np.clip(flat @ (middle / length), -1, 1)).max()) if length > 1e-9 and not zero.any() else np.pi
        return number, ids_.tolist(), np.ascontiguousarray(flat, "<f8").tobytes(), (middle / max(length, 1e-9)).astype("<f8").tobytes(), reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        sizes: dict[int, int] = {}
        done, part = 0, TaskContext.get().partitionId() << 32

        def told(p: int) -> pa.RecordBatch:
            nonlocal done
            done += 1
            found = block(part + done, *held.pop(p))
            del sizes[p]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["block", "ids", "vectors", "middle", "reach"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            rows = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            near = (rows @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(ids), np.int64)
            for p in np.unique(near).tolist():
                own = np.flatnonzero(near == p)
                for at in range(0, len(own), size):
                    cut_ = own[at : at + size]
                    kept = held.setdefault(p, ([], []))
                    kept[0].append(ids[cut_])
                    kept[1].append(rows[cut_].copy())
                    sizes[p] = sizes.get(p, 0) + len(cut_)
                    if sizes[p] >= size:
                        yield told(p)
        for p in list(held):
            yield told(p)

    return run


def _search(k: int, exclude_self: bool, item: str):
    """A cell's query blocks, then its row blocks one by one -> the k best rows of each query within the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for q in asked:
                at, place = np.nonzero(np.isfinite(q["score"]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(q["ids"][at]), pa.array(q["item"][at, place]), pa.array(q["score"][at, place])], ["query_id", item, "_s"])

        def matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.array(row["ids"], np.int64)
            return ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1), np.frombuffer(row["middle"], "<f8")

        for batch in batches:
            for row in (r for n in range(batch.num_rows) for r in batch.slice(n, 1).to_pylist()):
                if row["cell"] != cell:
                    yield from told()
                    cell, asked = row["cell"], []
                ids, vectors, middle = matrix(row)
                if row["kind"] == 0:
                    asked.append({"ids": ids, "vectors": vectors.copy(), "middle": middle.copy(), "reach": row["reach"], "item": np.zeros((len(ids), k), np.int64), "score": np.full((len(ids), k), -np.inf)})
                    continue
                for q in asked:
                    gap = np.arccos(np.clip(float(q["middle"] @ middle), -1, 1)) - q["reach"] - row["reach"]
                    if np.cos(max(gap, 0.0)) + 1e-8 < q["score"][:, -1].min():
                        continue  # no row of the block can come among the k best of any query
                    score = np.round(q["vectors"] @ vectors.T, 9)
                    if exclude_self:
                        score[q["ids"][:, None] == ids[None, :]] = -np.inf
                    better = np.flatnonzero((score >= q["score"][:, -1:]).any(axis=1))
                    score = score[better]
                    if score.shape[1] > k:  # all rows from the k-th best score on, ties included
                        floor = np.partition(score, -k, axis=1)[:, -k]
                        keep = (score >= np.maximum(floor, q["score"][better, -1])[:, None]).sum(axis=1).max(initial=0)
                        few = np.argpartition(-score, min(keep, score.shape[1] - 1), axis=1)[:, : max(keep, k)]
                    else:
                        few = np.broadcast_to(np.arange(score.shape[1]), score.shape)
                    both = np.concatenate((q["score"][better], np.take_along_axis(score, few, axis=1)), axis=1)
                    named = np.concatenate((q["item"][better], ids[few]), axis=1)
                    order = np.lexsort((named, -both), axis=1)[:, :k]
                    q["score"][better], q["item"][better] = np.take_along_axis(both, order, axis=1), np.take_along_axis(named, order, axis=1)
        yield from told()

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, query: str = "query_id", item: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact cosine neighbours of a table of queries in a table of rows: ``query_id, item, score, rank``.

    Both sides are packed where they are read into blocks of unit vectors that are near one of a few pivots (rows with the smallest
    hashes). Pairs of blocks are dealt as a grid of cells: a cell has at most QUERY_BLOCKS query blocks, which its task holds, and about
    ROW_BLOCKS row blocks, which pass by. A pair is skipped where the angle between the middles, less both reaches, is too wide for any of the
    queries. The plan has one size whatever the tables hold; the driver sees the pivots and two counts. Ties: the smaller id.
    """
    k, spark = min(k, TOP_CAP), rows.sparkSession
    some = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    unit = lambda df: df.withColumn("v", X.unit(F.col("v")))
    few = unit(some(rows, item).orderBy(F.xxhash64("id")).limit(PIVOTS)).collect()
    asked, held = unit(some(queries, query)), unit(some(rows, item))
    pivots = np.array([r.v for r in few])
    left, right = (stored(df.mapInArrow(_packed(pivots, block), BLOCKS), name) for df, name in ((asked, "query-blocks"), (held, "row-blocks")))
    spare = spark.sparkContext.defaultParallelism
    n_rows = right.count()
    across, down = max(1, -(-left.count() // QUERY_BLOCKS)), max(1, -(-n_rows // ROW_BLOCKS), min(n_rows, spare))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = left.withColumns({"kind": F.lit(0), "_a": place(across), "_d": every(down)}).unionByName(right.withColumns({"kind": F.lit(1), "_d": place(down), "_a": every(across)}))
    cells = sent.select((F.col("_a") * F.lit(down).cast("long") + F.col("_d")).alias("cell"), "kind", "ids", "vectors", "middle", "reach").repartition("cell").sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(_search(k, exclude_self, item), f"query_id long, {item} long, _s double")
    order = W.partitionBy("query_id").orderBy(F.desc("_s"), item)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", item, F.round("_s", 6).alias("score"), "rank")


def merge_candidates(lexical: DataFrame, dense: DataFrame, keys: list[str]) -> DataFrame:
    """One row per query and chunk with the higher score; on ties the lexical one."""
    both = lexical.withColumn("source", F.lit("lexical")).unionByName(dense.withColumn("source", F.lit("vector")), allowMissingColumns=True)
    order = W.partitionBy("query_id", *keys).orderBy(F.desc("score"), "source")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def rerank_pool(merged: DataFrame, keys: list[str], cap: int = RERANK_CAP, by: str = "score") -> DataFrame:
    """The candidates that a costly scorer sees: the best by score, or in the order of insertion (``by='arrival'``)."""
    first = [F.desc("score")] if by == "score" else [F.col("source"), F.col("rank")]
    order = W.partitionBy("query_id").orderBy(*first, *keys)
    return merged.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= cap)


def overlap_scorer(query_text: str, text: str):
    """Share of the query's terms that a text has; the scorer that needs no model."""
    q, t = F.array_distinct(X.index_tokens(F.col(query_text))), F.array_distinct(X.index_tokens(F.col(text)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def token_budget(ranked: DataFrame, budget: int = BUDGET_TOKENS, text: str = "text", rank: str = "rank", group: str = "query_id") -> DataFrame:
    """Ranked rows up to the first that doesn't fit; running sums never fall, so no later row fits either."""
    spent = F.sum(X.approximate_tokens(F.col(text))).over(W.partitionBy(group).orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("spent_tokens", spent).where(F.col("spent_tokens") <= budget)


def ordered_text(parts: str, rank: str = "rank", separator: str = "\n\n---\n\n"):
    """Aggregate of text parts in rank order; groups are bounded by the budget."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(parts).alias("t")))), lambda x: x["t"]), separator)


def chunk_block(chunk_id, title, page, text):
    """A chunk as the synthesis prompt shows it; a missing or zero page is ``p.?``."""
    place = F.when(F.coalesce(page, F.lit(0)) == 0, "p.?").otherwise(F.concat(F.lit("p."), page.cast("string")))
    return F.concat(F.lit("[chunk_id: "), chunk_id, F.lit(" | "), title, F.lit(", "), place, F.lit("]\n"), text)


def keep_share(text, share: float = 0.7):
    """A compressor that needs no model: the first words, stop words left out, up to that share of all words."""
    words = X.words(text)
    told = F.filter(words, lambda w: ~F.lower(w).isin(*X.INDEX_STOP_WORDS))
    return F.array_join(F.slice(told, 1, F.ceil(F.size(words) * F.lit(share)).cast("int")), " ")


def compress(contexts: DataFrame, text: str = "context", least_tokens: int = 2000, scorer=None) -> DataFrame:
    """Contexts under ``least_tokens`` pass; longer ones go through ``scorer`` (a column function), if there is one."""
    before = X.approximate_tokens(F.col(text))
    long = before >= least_tokens
    new = F.when(long, scorer(F.col(text))).otherwise(F.col(text)) if scorer else F.col(text)
    return contexts.withColumns({"compressed": new, "was_compressed": long & F.lit(scorer is not None)}).withColumn("ratio", F.when(before > 0, X.approximate_tokens(F.col("compressed")) / before).otherwise(1.0))
