import hashlib
import random

import numpy as np
import pytest
import xxhash

from plantscribe.llm import simhash, substring_dedup

from .conftest import TEXTS


def brute_substrings(docs):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = {k + i for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for i in range(50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(90)]
    bases = [[word() for _ in range(rng.randint(30, 400))] for _ in range(6)]
    docs = []
    for d in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w[at:at] = passage
        docs.append((d * 3 + 1, rng.choice([" ", "\n", "  "]).join(w)))
    return docs


@pytest.mark.parametrize("part", [substring_dedup.PART_WINDOWS, 40])
def test_substrings_against_brute_force(spark, part):
    docs = near_copies(5) + list(enumerate(TEXTS, 1000))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = substring_dedup.deduplicate(df, part_windows=part).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_substrings(docs)
    assert sum(r.n_removed for r in got) > 1000


def test_bucket_of_many_strings_is_dealt_in_parts(spark):
    """One passage in 3,000 documents with different words around it; no part holds more than its share."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(d, " ".join([*(f"w{rng.randrange(10**9)}" for _ in range(30)), passage, *(f"w{rng.randrange(10**9)}" for _ in range(30))])) for d in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(df, part_windows=5000).collect()}
    assert got == {d: 60 * (d > 0) for d, _ in docs}


def test_periodic_megabytes(spark):
    """One super-k-mer as long as the text: its windows are dealt in parts too."""
    text = " ".join(["ab cd ef"] * 250_000)
    docs = [(1, text), (2, "x y z " + text), (3, "q " * 70)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(df).collect()}
    assert got == {1: (750_000, 0), 2: (750_003, 750_000), 3: (70, 0)}


def test_one_row_twenty_thousand_times(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = spark.range(20_000).selectExpr("cast(7 as long) doc_id", f"'{text}' text").union(spark.createDataFrame([(9, text)], "doc_id long, text string"))
    got = substring_dedup.deduplicate(rows).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, 0, 20_000), (9, 80, 1)]


def test_substrings_odd_rows(spark, odd_docs, no_docs):
    assert substring_dedup.deduplicate(no_docs).count() == 0
    twice = odd_docs.union(odd_docs).unionByName(odd_docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "length", "piece", "component", "rep"))
    got = substring_dedup.deduplicate(twice).collect()
    assert len(got) == 3 * len(TEXTS)
    for r in got:
        assert r.n_removed == (0 if r.doc_id != 9 else r.n_words)
        assert r.doc_id is None or r.doc_id == 9 or r.kept_text == TEXTS[r.doc_id]


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    comp = {d: d for d, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= 4 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_simhash_against_brute_force(spark, odd_docs, no_docs):
    docs = near_copies(9, 80) + list(enumerate(TEXTS, 1000))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {d: (f"{x:016x}", comp[d]) for d, x in fps}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(odd_docs.union(odd_docs)).count() == 2 * len(TEXTS)


@pytest.mark.parametrize("chunk", [2048, 7])
def test_links_of_chains_and_hot_buckets(spark, chunk):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for x in fps[:5]:
        y = x
        for _ in range(30):  # chains
            for b in rng.integers(0, 64, 4):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    from plantscribe.llm.common import connected_components

    labels = {r.node: r.component for r in connected_components(simhash.edges(nodes, chunk)).collect()}
    comp = brute_components([(k, x & (1 << 64) - 1) for k, x in enumerate(fps)])
    assert {k: labels.get(k, k) for k in comp} == comp


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_vertical_counters(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 63, n).astype(np.uint64)
    fps[n // 2 :] = fps[: n - n // 2] ^ np.uint64(0b1011)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(zip(*map(list, simhash.links_of(fps, 0, n)), strict=True)) == want
