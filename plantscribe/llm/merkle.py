"""A Merkle manifest of a table: leaf per row, tree per source, tree of the sources' roots, proofs and checks of tampered rows.

H is the lower-case hex SHA-256 of its inputs, concatenated; digests go in as hex text. ARITY consecutive nodes have a parent, the last
run of a level may be shorter. A source's rows are numbered over all tasks (``ranking.positions``), so a source of any size is dealt in
aligned blocks of ARITY ** HEIGHT leaves, each a task's own subtree; the blocks' roots are the leaves of the next table, and so on until
a source has one node. Sources, in order, are leaves of the top tree, built by the same steps.

A tree within a block is persistent: nodes are never changed. A tampered leaf makes a version that copies the leaf's ancestors and shares
every other node; the version goes on above its block by copying the ancestors there, whose other children are the same for all rows of the
block and come down once a block. A row that isn't tampered has the first version. The proof of a row are the siblings that its path meets.

Null values are ``-`` in a leaf. Rows without a source are a source of their own, before all others. Leaves ascend by doc_id, null first;
rows that repeat one ascend by leaf as well, equal rows come in any order. Null texts can't be tampered with, nor rows without a
doc_id. Empty and very long texts are hashed whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import positions
from .common import CRC_TABLE_SQL, crc32_sql, hot_keys, spread_join, stored

ARITY, HEIGHT, TAMPER_MODULUS = 3, 7, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left:string,right:string>>"
Node = tuple[str, tuple]  # digest and children


_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("{0}" if f == "text" else f"{f}::VARCHAR" for f in FIELDS)) + ")"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(children: tuple[Node, ...]) -> Node:
    return digest("".join(c[0] for c in children)), children


def grow(leaves: list[str], levels: int) -> Node:
    """The root of a tree of exactly so many levels above its leaves."""
    nodes: list[Node] = [(leaf, ()) for leaf in leaves]
    for _ in range(levels):
        nodes = [parent(tuple(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
    return nodes[0]


def version(node: Node, place: int, span: int, leaf: str) -> Node:
    """The tree with another leaf at ``place``: ancestors are copied, all else is shared. ``span`` is how many leaves a node can have."""
    if not node[1]:
        return leaf, ()
    span //= ARITY
    k, rest = divmod(place, span)
    return parent((*node[1][:k], version(node[1][k], rest, span, leaf), *node[1][k + 1 :]))


def siblings(node: Node, place: int, span: int) -> list[tuple[str, str]]:
    """What is left and right of a leaf's path on each level, from the leaf up."""
    found = []
    while node[1]:
        span //= ARITY
        k, place = divmod(place, span)
        found.append(("".join(c[0] for c in node[1][:k]), "".join(c[0] for c in node[1][k + 1 :])))
        node = node[1][k]
    return found[::-1]


def levels_of(n: int, height: int = HEIGHT) -> int:
    """Levels above the leaves that a block builds in a source of ``n`` nodes: all of them, ``height`` where more blocks follow."""
    levels = 0
    while n > 1 and levels < height:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by ``grp, block`` -> the rows of each block."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["grp"], row["block"]) != (held[0]["grp"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _by_block(rows: DataFrame, run: Callable[[list[dict]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """One call of ``run`` for each block, its rows in order of ``place``."""
    placed = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    return placed.mapInArrow(lambda batches: _in_batches((out for own in _blocks(batches) for out in run(own)), schema), ddl)


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY**height).cast("long"))


NODES = pa.schema([("grp", pa.int64()), ("place", pa.int64()), ("node", pa.string()), ("n", pa.int64())])


def _roots(height: int):
    def run(own: list[dict]) -> Iterator[dict]:
        n = own[0]["n"]
        yield {"grp": own[0]["grp"], "place": own[0]["block"], "node": grow([r["node"] for r in own], levels_of(n, height))[0], "n": -(-n // ARITY**height)}

    return run


def towers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Nodes ``grp, place, node, n`` (n: nodes of the group) -> the tables of block roots above, up to one node a group."""
    tables = [leaves]
    while (tables[-1].agg(F.max("n").alias("n")).first()["n"] or 1) > 1:
        tables.append(stored(_by_block(_blocked(tables[-1].select("grp", "place", "node", "n"), height), _roots(height), NODES, "grp long, place long, node string, n long"), "merkle-nodes"))
    return tables


PATHS = pa.schema([("grp", pa.int64()), ("place", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])


def _paths(height: int):
    def run(own: list[dict]) -> Iterator[dict]:
        above, rows = own[0]["path"], own[1:]  # the first row of a block brings the path above it
        levels = levels_of(rows[0]["n"], height)
        tree = grow([r["node"] for r in rows], levels)
        for k, row in enumerate(rows):
            yield {"grp": row["grp"], "place": row["place"], "path": [{"left": a, "right": b} for a, b in siblings(tree, k, ARITY**levels)] + above}

    return run


def _with_above(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Nodes and, before those of each block, the path above the block."""
    heads = above.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path")
    return _blocked(nodes, height).unionByName(heads, allowMissingColumns=True)


def _paths_below(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    return _by_block(_with_above(nodes, above, height), _paths(height), PATHS, f"grp long, place long, path {SIBLINGS}")


def paths(tables: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Paths ``grp, place, path`` of the nodes of ``tables[1]``, from the path of each group's last node down; as ``top`` where there is none."""
    for nodes in reversed(tables[1:-1]):
        top = stored(_paths_below(nodes, top, height), "merkle-paths")
    return top


PROOFS = pa.schema([("grp", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _proofs(height: int):
    def run(own: list[dict]) -> Iterator[dict]:
        above, rows = [(p["left"], p["right"]) for p in own[0]["path"]], own[1:]
        levels = levels_of(rows[0]["n"], height)
        tree, span = grow([r["node"] for r in rows], levels), ARITY**levels
        upper = "".join(a + b for a, b in above)

        def to_the_top(node: str) -> str:
            for left, right in above:  # the ancestor's copy, whose other children are shared
                node = digest(left + node + right)
            return node

        first = to_the_top(tree[0])
        for k, row in enumerate(rows):
            proof = "".join(a + b for a, b in siblings(tree, k, span)) + upper
            changed = row["tampered"]
            folded = to_the_top(version(tree, k, span, changed)[0]) if changed else first
            yield {"grp": row["grp"], "doc_id": row["doc_id"], "leaf": row["node"], "proof_sha256": digest(proof), "folded_root": folded}

    return run


def leaf(text: Column | None = None) -> Column:
    """H of a row's FIELDS, each ``-`` or its UTF-8 byte count, a colon and its value; with another text, if there is one."""
    values = [(text if name == "text" and text is not None else F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def leaves(docs: DataFrame, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """``doc_id, source, node, tampered``: the leaf, and the leaf without line breaks where that differs in a row that is tampered with."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0) & F.col("text").contains("\n")
    return own.select("doc_id", "source", leaf().alias("node"), F.when(hit, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def manifest(docs: DataFrame, modulus: int = TAMPER_MODULUS, height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row."""
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("name")  # null before all others
    order = [F.asc("name"), F.asc_nulls_first("doc_id"), F.asc("node"), F.xxhash64(F.monotonically_increasing_id())]
    placed = stored(positions(leaves(docs, modulus).withColumn("name", name), order, "at"), "merkle-leaves")
    counted = placed.groupBy("name").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    sources = stored(positions(counted, [F.asc("start")], "grp"), "merkle-sources")
    numbered = spread_join(placed, sources, ["name"], hot_keys(sources, ["name"]))
    nodes = stored(numbered.select("grp", (F.col("at") - F.col("start")).alias("place"), "node", "n", "doc_id", "tampered"), "merkle-numbered")

    own = towers(nodes, height)
    top = towers(own[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), "node", F.lit(sources.count()).cast("long").alias("n")), height)
    root = F.lit(getattr(top[-1].first(), "node", None))  # one digest
    none = F.array().cast(SIBLINGS).alias("path")
    of_top = paths(top, top[-1].select("grp", "place", none), height)  # paths of the top tree's blocks
    if len(top) > 1:
        of_top = _paths_below(top[0], of_top, height)
    of_sources = stored(of_top.select(F.col("place").alias("grp"), F.lit(0).cast("long").alias("place"), "path"), "merkle-paths")
    above = paths(own, of_sources, height)
    proofs = _by_block(_with_above(nodes, above, height), _proofs(height), PROOFS, "grp long, doc_id long, leaf string, proof_sha256 string, folded_root string")
    subroots = own[-1].select("grp", F.col("node").alias("subroot"))
    met = spread_join(stored(proofs, "merkle-proofs"), subroots, ["grp"], hot_keys(sources, ["grp"]))
    return met.select("doc_id", "leaf", "subroot", root.cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


#: Level by level over the whole table: no blocks and no versions, every row's path is folded on its own.
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT *, {CRC_TABLE_SQL} AS crc_table, doc_id::VARCHAR AS id FROM documents),
l AS (SELECT doc_id, source, {_LEAF_SQL.format('text')} AS leaf, CASE WHEN {crc32_sql('id')} % {TAMPER_MODULUS} = 0 THEN {_LEAF_SQL.format("replace(text, chr(10), '')")} END AS tampered,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
up(source, lev, i, h, n) AS (SELECT source, 0, i, leaf, n FROM l UNION ALL SELECT source, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lev, i // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lev, i, h, n) AS (SELECT 0, i, subroot, n FROM s UNION ALL SELECT lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lev, i // 3, n),
runs AS (SELECT source, lev, i // 3 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY source, lev, i // 3), top_runs AS (SELECT lev, i // 3 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY lev, i // 3),
steps AS (SELECT l.doc_id, r.lev, r.hs, (l.i // pow(3, r.lev)::BIGINT) % 3 AS k FROM l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND r.run = l.i // pow(3, r.lev + 1)::BIGINT
 UNION ALL SELECT l.doc_id, 1000 + t.lev, t.hs, (s.i // pow(3, t.lev)::BIGINT) % 3 FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN top_runs t ON t.run = s.i // pow(3, t.lev + 1)::BIGINT),
sides AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lev) AS step, array_to_string(hs[1:k], '') AS lefts, array_to_string(hs[k + 2:], '') AS rights FROM steps),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(lefts || rights, '' ORDER BY step), '')) AS proof_sha256 FROM l LEFT JOIN sides USING (doc_id) GROUP BY doc_id),
fold(doc_id, step, h) AS (SELECT doc_id, 0, coalesce(tampered, leaf) FROM l UNION ALL SELECT f.doc_id, f.step + 1, sha256(lefts || h || rights) FROM fold f JOIN sides p ON f.doc_id = p.doc_id AND p.step = f.step + 1)
SELECT l.doc_id, leaf, subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN proofs USING (doc_id), (SELECT h AS root FROM top WHERE n = 1),
 (SELECT doc_id, arg_max(h, step) AS h FROM fold GROUP BY doc_id) f WHERE f.doc_id = l.doc_id"""
