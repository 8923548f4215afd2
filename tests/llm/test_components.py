import math

import numpy as np
import pytest

from plantscribe.llm import shingle_dedup, simhash
from plantscribe.llm.common import connected_components, smallest_reachable

N = 10_000


def shapes():
    rng = np.random.default_rng(5)
    path = np.arange(N)
    zigzag = np.empty(N, np.int64)
    zigzag[::2], zigzag[1::2] = np.arange(N // 2), np.arange(N // 2, N)
    orders = {"sorted": path, "random": rng.permutation(N), "zigzag": zigzag, "backwards": path[::-1]}
    found = {k: (o[:-1], o[1:]) for k, o in orders.items()}
    name = rng.permutation(N)
    grid = name.reshape(100, 100)
    found["grid"] = np.concatenate((grid[:-1].ravel(), grid[:, :-1].ravel())), np.concatenate((grid[1:].ravel(), grid[:, 1:].ravel()))
    found["star"] = np.full(N - 1, name[0]), name[1:]
    found["many"] = rng.integers(0, N, 6000), rng.integers(0, N, 6000)
    return found


def by_union_find(a, b):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("shape", sorted(shapes()))
def test_rounds_grow_with_the_logarithm(shape):
    a, b = shapes()[shape]
    nodes, roots, rounds = smallest_reachable(a, b)
    want = {k: v for k, v in by_union_find(a, b).items() if k != v}
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want
    assert rounds <= 2 * math.log2(N)


@pytest.mark.parametrize(("shape", "block"), [("random", 128), ("sorted", 1), ("many", 1 << 20), ("star", 64)])
def test_components_of_large_shapes(spark, shape, block):
    a, b = (x[:2000] if shape in ("sorted", "random") else x for x in shapes()[shape])
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").repartition(5)
    want = by_union_find(a, b)
    if shape == "many":  # an edge from a node to itself is no edge
        want = {k: v for k, v in want.items() if v != k or ((a == k) ^ (b == k)).any()}
    assert {r.node: r.component for r in connected_components(edges, block).collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long").limit(0)).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def chain(n):
    """Fingerprints that differ from the one before in four bits."""
    rng = np.random.default_rng(2)
    fps = [int(rng.integers(0, 1 << 62))]
    for _ in range(n - 1):
        fps.append(fps[-1] ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))
    return fps


def test_long_chain_of_fingerprints(spark):
    rng = np.random.default_rng(8)
    fps = list(dict.fromkeys(chain(1000)))
    ids = rng.permutation(len(fps)).tolist()
    nodes = spark.createDataFrame(list(zip(fps, ids, strict=True)), "fp long, node long")
    got = {r.node: r.component for r in connected_components(simhash.edges(nodes)).collect()}
    assert got == dict.fromkeys(range(len(fps)), 0)


def test_long_chain_of_near_copies(spark):
    """Versions of a page, each with three new words of a hundred at the end: far ends share nothing, neighbours over 0.8."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 100 + 3 * 999)]
    texts = [" ".join(words[3 * k : 3 * k + 100]) for k in range(1000)]
    ids = rng.permutation(1000).tolist()
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(docs).collect()}
    assert got == dict.fromkeys(range(1000), 0)
