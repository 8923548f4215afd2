import hashlib
import zlib

import pytest
from pyspark.sql import Row

from plantscribe.llm import merkle

from .conftest import TEXTS


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """Levels of a tree, from its leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, k):
    for level in levels[:-1]:
        run = level[k - k % 3 : k - k % 3 + 3]
        yield "".join(run[: k % 3]), "".join(run[k % 3 + 1 :])
        k //= 3


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(sources[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in names}
    trees = {s: climb([leaf(r, r.text) for r in own[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, r in enumerate(own[s]):
            steps = [*path(trees[s], k), *path(top, j)]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            node = leaf(r, r.text.replace("\n", "") if tampered else r.text)
            for a, b in steps:
                node = h(a, node, b)
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def table(spark, sizes):
    rows = []
    for s, n in enumerate(sizes):
        for k in range(n):
            source = None if s == 0 else f"sörce{s % 7}" * (s % 3)
            rows.append(Row(doc_id=len(rows) * 7 % 5003, source=source, lang=None if k % 11 == 0 else "en", n_chars=k, text=TEXTS[k % len(TEXTS)] if k % 3 else f"line {k}\nmore\n"))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


@pytest.mark.parametrize("sizes", [[1], [4], [2, 1, 3], [30, 9, 1, 10, 28, 81, 82, 5, 1, 1]])
def test_against_brute_force(spark, sizes):
    rows, df = table(spark, sizes)
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == brute(rows)


def test_many_blocks(spark):
    """Blocks of nine leaves: several tables of block roots above each other, also over the sources."""
    rows, df = table(spark, [200, 91, 1, 9, 10, 82])
    rows += [Row(doc_id=9000 + k, source=f"one{k}", lang="x", n_chars=1, text="a\nb") for k in range(30)]
    got = merkle.manifest(spark.createDataFrame(rows, df.schema).repartition(7), height=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    twice = odd_docs.unionByName(odd_docs).selectExpr("if(doc_id = 4, null, doc_id) AS doc_id", "source", "lang", "n_chars", "text", "1 AS node", "2 AS place", "3 AS grp", "4 AS name", "5 AS n", "6 AS at")
    got = merkle.manifest(twice)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(twice.collect())
    assert merkle.manifest(no_docs).count() == 0


def test_versions_share_all_else():
    leaves = [h(str(k)) for k in range(27)]
    tree = merkle.grow(leaves, 3)
    other = merkle.version(tree, 14, 27, "x")
    assert other[0] == merkle.grow([*leaves[:14], "x", *leaves[15:]], 3)[0]
    shared = [a is b for a, b in zip(tree[1], other[1], strict=True)]
    assert shared == [True, False, True]
    assert [a is b for a, b in zip(tree[1][1][1], other[1][1][1], strict=True)] == [True, False, True]
    assert tree[0] == merkle.grow(leaves, 3)[0]


def test_megabyte_text(spark):
    rows = [Row(doc_id=k, source="s", lang=None, n_chars=None, text="é\n" * 500_000) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == brute(rows)
