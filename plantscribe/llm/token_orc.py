"""Token ids as ORC: integer run lengths, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of doc_id and sorted before they are encoded, so the files hold the ids in ascending doc_id
order. Rows of one doc_id may spread over several files, in any order; within a file they are in the order of their texts, nulls first. Each row keeps its start
within its file; the start in the whole output needs one sum per file. Readers take stripes in parallel, skip stripes and
row groups by the index of doc_id, and by its Bloom filter for point look-ups.

Null and empty texts are the end id alone. Texts of any length are encoded whole, in their own task. An empty table gives no rows.
Other columns of the input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "compression": "zstd"}


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = encoder(vocabulary), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                packed = list(own.packed(part.column(1).to_pylist()))
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends[:-1] + start, pa.int64()), pa.array(np.diff(ends), pa.int64()), ids], ["doc_id", "file_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> str:
    """Encode ``(doc_id, text)`` and write ORC files to ``path``, a folder that driver and executors share."""
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_any", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)))
    ordered = ordered.repartitionByRange("doc_id", "_any").drop("_any").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(vocabulary or default_vocabulary()), SCHEMA).write.options(**OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA and the number of the file; Spark splits files by stripes."""
    return spark.read.schema(SCHEMA).orc(path).withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of a few documents; the pushed filter prunes by row indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, start, part, ids = batch.columns
        ends, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<i4", copy=False)
        crc = [zlib.crc32(memoryview(flat[a:b]).cast("B")) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([doc, start, part, pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file_start", "part", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files' own ids."""
    rows = read_tokens(spark, path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file; reads the counts only
    before = files.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    digests = rows.select("doc_id", "file_start", "part", "ids").mapInArrow(_digest, "doc_id long, file_start long, part long, n_tokens long, ids_crc32 long")
    return digests.join(before, "part").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
