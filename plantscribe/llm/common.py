"""What the corpus operators share: table access, shared scratch space, splits and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of UTF-8 split here are exactly the words ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: SQL of the driver's oracle: the table of CRC-32, and the checksum of a text's UTF-8 bytes by a column ``crc_table`` that holds it.
CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT))"


def crc32_sql(text: str) -> str:
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: ('0x' || substr(hex(encode({text})), k::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8. ``bytes.split()`` cuts at space and \\t..\\r only, as WORD_PATTERN does."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def held_out(doc_id: str = "doc_id"):
    """The third of the documents whose labels no model may see."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset, as in tests, a folder under the warehouse is taken, and only if all runs on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation, and cut the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, by a written table. For loops: a checkpoint hands its plan's constraints on, which grow with the rounds."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 64


def hot_keys(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Of keys and their numbers of rows, the keys that hold more than one in HOT_SHARE rows (HOT_SHARE keys at most), and HOT_ROWS rows."""
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counts.where(F.col(n) > F.lit(max(total / HOT_SHARE, HOT_ROWS))).select(*key)


def spread_join(many: DataFrame, one: DataFrame, key: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has a key once. Rows of the hot keys are dealt over SALTS tasks, each with a copy of the key's row.

    ``hot`` is what ``hot_keys`` gives, so it is small enough to broadcast. ``many`` should read a checkpoint or files, whose rows keep their places.
    """
    small = F.broadcast(hot.select(*key, F.lit(True).alias("_hot")))
    dealt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(small, key, "left").withColumn("_salt", dealt).drop("_hot")
    right = one.join(small, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges between ids -> ``(node, root, rounds)`` of all nodes but the roots: the smallest node that each can reach.

    Every root hooks onto its smallest neighbouring root, trees are flattened by pointer jumping, and edges are drawn between roots
    again. A root that nobody joins has a smaller neighbour in the next round, so two rounds halve the roots at least.
    """
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent, rounds = np.arange(len(ids)), 0
    while len(u):
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        u, v = parent[u], parent[v]
        u, v = u[u != v], v[u != v]
        rounds += 1
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]], rounds


def _contract(block: int):
    """Edges of a task, ``block`` at a time -> edges from each node to the smallest one that its block lets it reach; never more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            a, b, _ = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                held.append([part.column(k).to_numpy() for k in range(2)])
                n += part.num_rows
                if n >= block:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def connected_components(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, the smallest node that each can reach, of every node that has an edge; all inside Spark.

    A round contracts edges within each task first (``block`` at a time, ``smallest_reachable``). Then every node takes its smallest
    neighbour as its parent, parents are replaced by theirs until nothing changes, and edges are drawn between what is left. Two
    rounds halve the roots at least, whatever the order of ids along a path, and parents of a chain take as many steps as the logarithm
    of its length, so there is no limit of rounds. Each table is written to the shared folder. Parents of many nodes are hot keys of the
    joins and are dealt over several tasks.
    """
    keep = lambda df: stored(df, "components")

    def follow(rows: DataFrame, at: str, parents: DataFrame, hot: DataFrame) -> DataFrame:
        met = spread_join(rows, parents.select(F.col("node").alias(at), F.col("parent").alias("_next")), [at], hot, "left")
        return met.withColumn(at, F.coalesce("_next", at)).drop("_next")

    todo, maps = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b"), []
    while True:
        todo = keep(todo.distinct().mapInArrow(_contract(block), "a long, b long").distinct())
        parents = keep(todo.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if parents.isEmpty():
            break
        while True:
            hot = hot_keys(parents.groupBy("parent").agg(F.count("*").alias("n")), ["parent"])
            jumped = keep(follow(parents.withColumn("_old", F.col("parent")), "parent", parents, hot))
            parents = jumped.select("node", "parent")
            if jumped.where("_old <> parent").isEmpty():
                break
        maps.append(parents)
        left = todo.join(parents.withColumnRenamed("node", "a"), "a").where("parent <> b")  # one parent for each a
        hot = hot_keys(left.groupBy("b").agg(F.count("*").alias("n")), ["b"])
        left = follow(left.select(F.col("parent").alias("a"), "b"), "b", parents, hot).where("a <> b")
        todo = keep(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    labels = maps.pop()
    while maps:
        earlier = maps.pop()
        hot = hot_keys(earlier.groupBy("parent").agg(F.count("*").alias("n")), ["parent"])
        labels = keep(follow(earlier, "parent", labels, hot).unionByName(labels))
    roots = labels.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return keep(labels.select("node", F.col("parent").alias("component")).unionByName(roots))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows whose key hashes are among the ``rows`` smallest: a filter, so the sample stays spread over its partitions.

    Bounded where keys are distinct; a caller whose keys may repeat has to limit what it takes.
    """
    lowest = df.select(F.xxhash64(key).alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    return df.where(F.xxhash64(key) <= F.lit(lowest)) if lowest is not None else df.limit(0)


def append_from_text(docs: DataFrame, found, ddl: str) -> DataFrame:
    """``docs`` with one more column, the struct ``_found`` of what ``found(array of texts) -> arrays`` gives, row by row; no shuffle.

    Names within ``ddl`` can't clash with columns of ``docs``.
    """
    at = docs.columns.index("text")
    names = [part.split()[0] for part in ddl.split(",")]

    def run(batches):
        for batch in batches:
            struct = pa.StructArray.from_arrays(found(batch.column(at)), names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, "_found"])

    inner = ", ".join(part.strip().replace(" ", ": ") for part in ddl.split(","))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, _found struct<{inner}>")
