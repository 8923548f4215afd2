"""Keyword scores by cells of queries and chunks, against the formula read literally."""

import math
from collections import Counter, defaultdict

from plantscribe.operators import retrieval as R


def brute(rows, terms, k):
    texts = [(d, c, t.split()) for d, c, t in rows if t]
    df = {t: len({d for d, _, w in texts if t in w}) for t in {t for _, t in terms}}
    n, scores = len({d for d, _, _ in texts}), defaultdict(float)
    for q, t in terms:
        for d, c, w in texts:
            if t in w:
                tf = Counter(w)[t] / len(w)
                scores[q, d, c] += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + 1.5)
    out = {}
    for q in {q for q, _ in terms}:
        own = sorted(((-round(s, 9), d, c) for (p, d, c), s in scores.items() if p == q))[:k]
        out |= {(q, d, c): (rank, round(s / own[0][0], 6)) for rank, (s, d, c) in enumerate(own, 1)}
    return out


def test_cells_of_all_sizes_give_the_same_ranks(spark, monkeypatch):
    words = [f"w{i}" for i in range(12)]
    rows = [(f"d{i // 2 % 70}", i % 2, " ".join(words[(i * j) % 12] for j in range(1, 2 + i % 5))) for i in range(140)]
    rows += [("d3", 1, "w0 w5 w7"), ("empty", 0, ""), ("same", 0, "w1 w2"), ("same", 1, "w1 w2")]  # repeated keys, no term, ties
    terms = [(q, words[(q * j) % 12]) for q in range(1, 30) for j in (1, 5)]
    terms = list(dict.fromkeys(terms)) + [(99, "nowhere")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, text string")
    asked = spark.createDataFrame(terms, "query_id long, term string")
    for postings, queries in ((1 << 20, 2048), (20, 7), (1, 1)):
        monkeypatch.setattr(R, "CELL_POSTINGS", postings)
        monkeypatch.setattr(R, "CELL_QUERIES", queries)
        got = R.bm25(df, asked.where("query_id < 4 OR query_id > 25") if postings == 1 else asked, ["doc_id", "chunk_index"], k=4)
        want = brute(rows, [t for t in terms if postings > 1 or not 4 <= t[0] <= 25], 4)
        assert {(r.query_id, r.doc_id, r.chunk_index): (r["rank"], r.score) for r in got.collect()} == want


def test_greedy_resolution_folds_small_groups_and_passes_large_ones(spark):
    import random

    from plantscribe.operators import graph as G

    rng = random.Random(3)
    rows = [(c, k, rng.choice(("P", "PT")) + "-" + "".join(rng.choice("123") for _ in range(rng.randint(1, 5))) if rng.random() > 0.1 else None, rng.choice(("Sensor", None))) for c in (None, 1, 2, 3) for k in range({None: 9, 1: 60, 2: 8, 3: 30}[c])]
    df = spark.createDataFrame(rows, "c int, pos int, tag string, entity_type string")
    told = lambda fold: sorted(map(str, G.resolve_greedy(df, "c", fold=fold).collect()))
    assert told(1000) == told(10) == told(0)


def test_summary_counts_tags_with_several_types_once(spark):
    from plantscribe.operators import graph as G

    sub = spark.createDataFrame([("s", "s", "R", "a"), ("s", "a", "R", "b")], "seed string, src string, relation string, dst string")
    types = spark.createDataFrame([("a", "Asset"), ("a", None), ("b", "Equipment"), ("b", "Asset"), ("b", "Asset")], "tag string, node_type string")
    seeds = spark.createDataFrame([("s",), ("t",)], "seed string")
    got = G.summarise(seeds, sub, types)
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString()  # every row would be expanded
    assert {(r.seed, r.n_nodes, r.n_edges, tuple(r.node_types)) for r in got.collect()} == {("s", 3, 2, ("Asset", "Equipment", "Unknown")), ("t", 1, 0, ("Unknown",))}


def test_pairs_and_edges_take_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from plantscribe.operators import graph as G

    monkeypatch.setattr(G, "TASK_VARIANTS", 100)
    monkeypatch.setattr(G, "TASK_EDGES", 3)
    tags = spark.range(40).selectExpr("'Equipment' AS entity_type", "concat('P-', 100 + id * 7) AS tag")
    names = sorted(r.tag for r in tags.collect())

    def edits(a, b):
        if not a or not b:
            return len(a) + len(b)
        return edits(a[1:], b[1:]) if a[0] == b[0] else 1 + min(edits(a[1:], b), edits(a, b[1:]), edits(a[1:], b[1:]))

    want = sorted((a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= 2)
    assert sorted((r.a, r.b, r.distance) for r in G.similar_tags(tags).collect()) == want
    edges = spark.createDataFrame([(f"n{i % 7}", "R", f"n{i % 5}", "A", k) for i in range(30) for k in ("A", "B", None)], "src string, relation string, dst string, source_type string, target_type string")
    nodes = spark.createDataFrame([(f"n{i}", "B" if i == 3 else "A") for i in range(6)] + [("n3", "B"), ("n4", "B")], "tag string, node_type string")
    got = [(r.src, r.dst) for r in G.merge_edges(edges, nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"n{i % 7}", f"n{i % 5}") for i in range(30) if i % 7 not in (3, 6)}
