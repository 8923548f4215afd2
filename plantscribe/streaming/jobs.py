"""Streaming runs: incremental ingestion, newest status per document and warnings, each replayable from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_id, token_windows
from ..operators.graph import extract_entities
from ..operators.relational import progress
from ..operators.retrieval import pointed, posted, term_lists, vector_lists
from ..sources.keyed import Batch, KeyedTables


def replayable(stream: DataFrame, name: str, root: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; progress is kept under ``root``, a folder that driver and executors share."""
    return stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/_progress/{name}").trigger(availableNow=True).foreachBatch(batch).start()


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files with the schema of what is there; written as a pattern, the path may be a file or a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def described(batch: Batch, own: DataFrame, keys: list[str], number: int) -> None:
    """What a batch of texts becomes: chunks, and of the chunks postings, vectors, entities and edges. A text without words has none of them.

    Postings and vectors are stored as lists, a row a chunk, so that writing, replacing and merging batches handles chunks and not terms.
    """
    chunk = [*keys, "chunk_index"]
    numbered = lambda rows: rows.withColumn("batch_number", F.lit(number))
    chunks = batch.put("chunks", numbered(token_windows(own, keys)))
    lists = batch.put("postings", numbered(term_lists(chunks, chunk)))
    batch.put("vectors", numbered(vector_lists(lists, chunk)))
    entities = batch.put("entities", numbered(extract_entities(chunks, chunk)))
    id_of = chunk_id(F.col(keys[0]), F.col("chunk_index"))
    holds = chunks.select(*chunk, F.lit("HAS_CHUNK").alias("relation"), F.col(keys[0]).cast("string").alias("src"), id_of.alias("dst"))
    names = entities.select(*chunk, F.lit("MENTIONS").alias("relation"), id_of.alias("src"), F.col("tag").alias("dst")).distinct()
    batch.put("edges", numbered(holds.unionByName(names)))


def ingest(documents: DataFrame, root: str, key: str = "doc_id") -> StreamingQuery:
    """New documents become chunks, postings, vectors, entities and edges, five tables under one batch number and one commit.

    A document that comes again replaces all that it had, and one whose newest text has no words has nothing. A batch that is replayed
    counts once. Different texts of one document in a batch are all kept, told apart by ``version``.
    """
    tables = KeyedTables(documents.sparkSession, root, key)

    def batch(rows: DataFrame, number: int) -> None:
        if tables.manifest()["done"].get("ingest", -1) >= number:
            return
        at, order = tables.batch(), W.partitionBy(key).orderBy("text")  # equal texts are neighbours, so that texts are shuffled once
        own = rows.select(key, "text", (F.dense_rank().over(order) - 1).alias("version"), F.row_number().over(order).alias("_k"), F.lag("text").over(order).alias("_last"))
        own = at.put("texts", own.where((F.col("_k") == 1) | ~F.col("text").eqNullSafe(F.col("_last"))).drop("_k", "_last"))
        described(at, own, [key, "version"], number)
        tables.commit(at, own, "ingest", number)

    return replayable(documents, "ingest", root, batch)


def current(spark: SparkSession, root: str, table: str = "chunks", key: str = "doc_id", lists: bool = False) -> DataFrame:
    """Of each document the rows of its newest batch; a document whose newest text has no words has none.

    Postings and vectors come a row each, or with ``lists`` as they are stored, a row a chunk.
    """
    rows = KeyedTables(spark, root, key).read(table)
    return rows if lists else {"postings": posted, "vectors": pointed}.get(table, lambda own: own)(rows)


def keyed(frame: DataFrame, name: str, root: str) -> StreamingQuery:
    """An aggregate over a stream: each batch writes the rows that it changed, the state of closed windows is dropped, and late rows with it."""
    return replayable(frame, name, root, lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}"), "update")


def newest_rows(spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    """What a ``keyed`` run holds now: of each key the row of the newest batch."""
    rows = spark.read.parquet(f"{root}/{name}")
    own = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("_r")).select(*keys, "_r.*")


def newest_status(jobs: DataFrame, root: str) -> StreamingQuery:
    """The newest status of each document with its progress and failure message: max_by keeps one row of state a document."""
    last = F.max_by(F.struct("status", *(c for c in ("message",) if c in jobs.columns)), F.struct("created_at", "job_id")).alias("_s")
    state = jobs.groupBy("document_id").agg(last, F.max("created_at").alias("since"))
    state = state.select("document_id", "_s.*", "since").withColumn("progress", progress(F.col("status")))
    return keyed(state, "newest_status", root)


def warnings(incidents: DataFrame, lessons: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], root: str) -> StreamingQuery:
    """Incidents against the standing lessons with ``match``, batch by batch."""
    return replayable(incidents, "warnings", root, lambda rows, n: match(rows, lessons).write.mode("overwrite").parquet(f"{root}/warnings/batch={n}"))
