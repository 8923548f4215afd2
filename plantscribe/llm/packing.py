"""Best-fit packing by sums of squares.

Documents become runs of token ids; only those longer than a sequence are cut. A piece goes where the sum of the squared
counts of open sequences per residual gap becomes smallest (ties: the smallest gap left), which keeps gaps of every size
in stock instead of piling up one useless kind. Pieces are placed longest first.

Placement is sequential by nature, so pieces are numbered, dealt by a hash of their number into groups of about GROUP_PIECES and
each group is packed by one task: the groups' number grows with the input, their size doesn't, whatever the rows repeat. A group of
that size wastes about one part in a thousand.

Null texts pack as empty ones: their end id. Texts of any length are cut in their own task. Repeated rows are packed each, equal lengths
in the order of doc_id and piece. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .tokens import default_vocabulary, encoder

CAPACITY, GROUP_PIECES = 4096, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.packed(batch.column(1).to_pylist()), strict=True):
                n = len(ids) // 4
                rows += [(doc_id, k, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)])) for k, a in enumerate(range(0, n, capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` -> PIECES; the ids themselves never leave the task."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut_pieces(vocabulary or default_vocabulary(), capacity), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in the order of placement: the sequence of each and its offset there."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, used = 0, []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        gap, best = capacity, 0 if size == capacity else 2 * int(count[capacity - size]) + 1
        if size < capacity:
            have = count[size:capacity]
            change = np.where(have > 0, 2 * (count[: capacity - size] - have) + 2, never)
            if have[0]:
                change[0] = 1 - 2 * have[0]  # fills it: no gap is left to count
            at = int(change.argmin())
            if change[at] <= best and change[at] != never:
                gap = at + size
        if gap == capacity:
            b, bins = bins, bins + 1
            used.append(0)
        else:
            b = open_at[gap].pop()
            count[gap] -= 1
        sequence[k], offset[k] = b, used[b]
        used[b] += size
        if gap > size:
            open_at[gap - size].append(b)
            count[gap - size] += 1
    return sequence, offset


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, pdf["offset"] = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["pack_group"].to_numpy() * (1 << 32) + sequence
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PIECES -> PIECES, sequence_id, offset. The pieces are materialised once: their number sets that of the groups."""
    pieces = cut(pieces.withColumn("number", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("number"), F.lit(groups))).drop("number")
    return dealt.groupBy("pack_group").applyInPandas(_pack_group(capacity), PIECES + ", sequence_id long, offset long")
