"""Subgraphs counted without their rows, against the rows and brute force."""

import random

import pytest

from plantscribe.operators import graph as G

from .test_scale import brute_expand


@pytest.mark.parametrize(("depth", "most"), [(1, 4), (2, 4), (3, 4), (2, 0), (3, 1000)])
def test_counts_are_those_of_the_rows(spark, monkeypatch, depth, most):
    """Loops, several relations, repeated edges, hubs of either direction; by ``most`` all, some or none of the nodes are wide."""
    monkeypatch.setattr(G, "HUB_STEPS", most)
    monkeypatch.setattr(G, "PARTS", 3)
    rng = random.Random(depth)
    edges = [(f"n{rng.randint(0, 90):02}", rng.choice("RQ"), f"n{int(90 * rng.random() ** 2):02}") for _ in range(110)]
    edges += [("hub", "R", f"n{k:02}") for k in range(0, 60, 3)] + [(f"n{k:02}", "R", "sink") for k in range(0, 90, 4)] + [("n03", "R", "n03"), ("n03", "Q", "n03"), ("hub", "R", "hub"), ("own", "R", "own")]
    seeds = [f"n{k:02}" for k in range(0, 91, 6)] + ["n03", "hub", "sink", "own", "nowhere"]
    types = [(f"n{k:02}", rng.choice(("A", "B", "C"))) for k in range(0, 60)] + [("n03", "Z"), ("n04", None), ("hub", "H")]
    df = spark.createDataFrame([*edges, *edges[:20], ("x", "R", None), (None, "R", "n03")], "src string, relation string, dst string")
    asked = spark.createDataFrame([(s,) for s in (*seeds, seeds[0], None)], "seed string")
    told = spark.createDataFrame(types, "tag string, node_type string")
    got = {r.seed: (r.n_nodes, r.n_edges, r.node_types) for r in G.subgraph_summary(asked, df, told, depth).collect()}
    kinds = {}
    for tag, kind in types:
        kinds.setdefault(tag, set()).add(kind or "Unknown")
    want = {None: (0, 0, ["Unknown"])}
    for seed in set(seeds):
        rows = brute_expand([seed], edges, depth)
        own = {seed} | {r[1] for r in rows} | {r[3] for r in rows}
        want[seed] = (len(own), len(rows), sorted(set().union(*(kinds.get(t, {"Unknown"}) for t in own))))
    assert got == want


def test_no_seed_has_rows_of_what_a_hub_leads_to(spark, monkeypatch):
    """1,000 seeds at one node of 5,000 edges: five million rows of subgraphs, a few of each seed and edge here."""
    rows, kept = [], G.stored

    def counted(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "stored", counted)
    edges = spark.range(5000).selectExpr("concat('n', id) AS src", "'R' AS relation", "'hub' AS dst")
    seeds = spark.range(1000).selectExpr("concat('n', id) AS seed")
    types = spark.createDataFrame([("hub", "Asset")], "tag string, node_type string")
    got = G.subgraph_summary(seeds, edges, types).groupBy("n_nodes", "n_edges", "node_types").count().collect()
    assert [tuple(r) for r in got] == [(5001, 5000, ["Asset", "Unknown"], 1000)]
    assert sum(rows) < 50_000
