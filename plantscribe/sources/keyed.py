"""Tables on disk that are replaced key by key: batches, a manifest that names them, and compaction.

A batch is a folder with the rows of one or more tables and the keys that it replaces, all written by Spark before anything refers to it. A commit is
one small file, the manifest, that lists the batches in order and comes into being by a rename; readers take the newest manifest. So a write
that is killed leaves the old state, and all tables of a batch change at once. A row counts if no later batch replaces its key; a key
without new rows is deleted. Compaction writes what counts as one batch. Old folders stay until ``clear``.

Rows without a key can't be replaced: each batch adds its own. Keys have one type over all batches; columns may be added.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = "_keys"


class Files:
    """The few calls on folders that Spark has no reader or writer for; any store that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.java = spark.sparkContext._jvm
        self.system = self.java.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.java.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(path))) if self.system.exists(self.at(path)) else []

    def text(self, path: str) -> str:
        stream = self.system.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file is new; it is there in whole or not at all."""
        if self.system.exists(self.at(path)):
            return False
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self.system.create(self.at(draft), False)
        stream.write(text.encode())
        stream.close()
        if not self.system.exists(self.at(path)) and self.system.rename(self.at(draft), self.at(path)):
            return True
        self.system.delete(self.at(draft), False)
        return False

    def drop(self, path: str) -> None:
        self.system.delete(self.at(path), True)


@dataclass
class Batch:
    """Rows on their way: ``put`` writes a table and gives it back to build others on."""

    tables: KeyedTables
    folder: str
    names: list[str] = field(default_factory=list)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.tables.root}/data/{self.folder}/{name}"
        rows.write.parquet(path)
        self.names.append(name)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)


class KeyedTables:
    """``root`` is a folder that driver and executors share; ``key`` the column that all its tables have."""

    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.files = Files(spark, root)

    def manifest(self) -> dict:
        """The newest: ``batches``, each with ``n, folder, tables``, oldest first, and ``done``, the newest number of each stream."""
        found = [x for x in self.files.names(f"{self.root}/manifest") if x.endswith(".json")]
        return json.loads(self.files.text(f"{self.root}/manifest/{found[-1]}")) if found else {"version": 0, "batches": [], "done": {}}

    def batch(self) -> Batch:
        return Batch(self, f"b{uuid.uuid4().hex}")

    def commit(self, batch: Batch, keys: DataFrame, stream: str | None = None, number: int = 0, instead: tuple[str, ...] = ()) -> bool:
        """Make a batch count, for the keys of ``keys``; False, without effect, where the stream's batch of that number counts already.

        ``instead`` names batches that it takes the place of. Another writer who was faster is no conflict: of two
        batches with one key the later commit counts.
        """
        batch.put(KEYS, keys.select(self.key).distinct())
        while True:
            old = self.manifest()
            if stream and old["done"].get(stream, -1) >= number:
                return False
            folders = [b["folder"] for b in old["batches"]]
            if not set(instead) <= set(folders):
                return False  # somebody else compacted them
            own = {"folder": batch.folder, "tables": [x for x in batch.names if x != KEYS]}
            rest = [b for b in old["batches"] if b["folder"] not in instead]
            first = folders.index(instead[-1]) - len(instead) + 1 if instead else len(rest)
            rows = [{**b, "n": n} for n, b in enumerate([*rest[:first], own, *rest[first:]])]
            new = {"version": old["version"] + 1, "batches": rows, "done": old["done"] | ({stream: number} if stream else {})}
            if self.files.create(f"{self.root}/manifest/{new['version']:012d}.json", json.dumps(new)):
                return True

    def replace(self, rows: dict[str, DataFrame], keys: DataFrame | None = None, stream: str | None = None, number: int = 0) -> bool:
        """Delete-then-insert of everything under ``keys``, or else under the keys that the rows have, in all tables at once."""
        if stream and self.manifest()["done"].get(stream, -1) >= number:
            return False
        batch = self.batch()
        written = [batch.put(name, own).select(self.key) for name, own in rows.items()]
        if keys is None:
            keys = written[0]
            for more in written[1:]:
                keys = keys.unionByName(more)
        return self.commit(batch, keys, stream, number)

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table that count. Only keys that a batch beyond the first replaces are joined; they are few."""
        batches = (manifest or self.manifest())["batches"]
        own = [b for b in batches if name in b["tables"]]
        if not own:
            raise ValueError(f"no batch has a table {name}")
        number = F.create_map(*(x for b in batches for x in (F.lit(b["folder"]), F.lit(b["n"]))))
        at = lambda: number[F.regexp_extract("_metadata.file_path", r"/data/(b[0-9a-f]{32})/", 1)]
        paths = lambda some, table: [f"{self.root}/data/{b['folder']}/{table}" for b in some]
        rows = self.spark.read.option("mergeSchema", True).parquet(*paths(own, name)).withColumn("_batch", at())
        later = [b for b in batches if b["n"] > own[0]["n"]]
        if later:
            newest = self.spark.read.parquet(*paths(later, KEYS)).groupBy(self.key).agg(F.max(at()).alias("_newest"))
            counts: Column = F.col("_batch") >= F.coalesce("_newest", F.lit(0))
            rows = rows.join(newest, self.key, "left").where(counts).drop("_newest")
        return rows.drop("_batch")

    def compact(self) -> bool:
        """One batch in place of all; readers see the same rows before and after."""
        old = self.manifest()
        if len(old["batches"]) < 2:
            return False
        batch, keys = self.batch(), None
        for name in dict.fromkeys(t for b in old["batches"] for t in b["tables"]):
            own = batch.put(name, self.read(name, old)).select(self.key)
            keys = own if keys is None else keys.unionByName(own)
        return self.commit(batch, keys, instead=tuple(b["folder"] for b in old["batches"]))

    def clear(self) -> None:
        """Delete what the newest manifest doesn't name, killed writes too. No writer and no reader of an older state may be at work."""
        live = {b["folder"] for b in self.manifest()["batches"]}
        for folder in set(self.files.names(f"{self.root}/data")) - live:
            self.files.drop(f"{self.root}/data/{folder}")
        for name in self.files.names(f"{self.root}/manifest")[:-1]:
            self.files.drop(f"{self.root}/manifest/{name}")
