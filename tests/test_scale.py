"""Hot keys, large query tables and long groups on fixtures, against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscribe.operators import evaluation as E, graph as G, ranking as K, retrieval as R


def brute_expand(seeds, edges, depth, limit=None):
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for s in seeds:
        seen, level = {s}, {s}
        for _ in range(depth):
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
        own = sorted((a, r, b) for a, r, b in set(edges) if a in seen and b in seen)
        out += [(s, *e) for e in own[:limit]]
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_expansion_against_brute_force(spark, depth):
    rng = random.Random(depth)
    edges = [(f"n{rng.randint(0, 60):02}", rng.choice("RQ"), f"n{int(60 * rng.random() ** 3):02}") for _ in range(150)] + [("hub", "R", f"n{k:02}") for k in range(0, 60, 2)]
    seeds = ["n03", "n40", "hub", "nowhere", "n59"]
    df = spark.createDataFrame([*edges, ("x", "R", None)], "src string, relation string, dst string")
    asked = spark.createDataFrame([(s,) for s in seeds], "seed string")
    for limit in (None, 1, 7, 50):
        got = sorted((r.seed, r.src, r.relation, r.dst) for r in G.expand(asked, df, depth, limit).collect())
        assert got == brute_expand(seeds, edges, depth, limit), limit


def test_star_is_dealt_and_limited(spark):
    edges = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "hub").otherwise(F.format_string("n%06d", "id")).alias("src"), F.lit("R").alias("relation"), F.when(F.col("id") % 2 == 0, F.format_string("n%06d", "id")).otherwise("hub").alias("dst"))
    steps = G.Steps(edges)
    sizes = [r["count"] for r in steps.dealt.groupBy("node", "_part").count().collect()]
    assert max(sizes) < 3000  # of 100,000 steps of the hub
    seeds = spark.createDataFrame([("n000001",), ("hub",)], "seed string")
    assert steps.of(seeds.select("seed", F.col("seed").alias("node"))).count() == 100_001
    got = sorted((r.seed, r.src, r.relation, r.dst) for r in G.expand(seeds, edges, 2, 50).collect())
    assert got == sorted((s, "hub", "R", f"n{k:06}") for s in ("hub", "n000001") for k in range(0, 100, 2))
    assert G.expand(seeds.where("seed = 'hub'"), edges, 1).count() == 100_000


def brute_nearest(queries, rows, k, exclude_self=False):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    score = np.round(unit(queries) @ unit(rows).T, 9)
    if exclude_self:
        np.fill_diagonal(score, -np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(rows)), score.shape), -score), axis=1)[:, :k]
    return order, np.take_along_axis(score, order, axis=1)


def frame(spark, name, vectors):
    return spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], f"{name} long, embedding array<double>").repartition(6)


def test_neighbours_of_many_queries(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 1, (12, 8))
    rows = np.repeat(middles, 150, axis=0) + rng.normal(0, 0.05, (1800, 8))
    queries = middles[rng.integers(0, 12, 100_000)] + rng.normal(0, 0.05, (100_000, 8))
    asked = spark.createDataFrame(__import__("pandas").DataFrame({"query_id": np.arange(len(queries)), "embedding": list(queries)})).repartition(6)
    got = R.nearest(asked, frame(spark, "vec_id", rows), 3).toPandas().sort_values(["query_id", "rank"])
    order, score = brute_nearest(queries, rows, 3)
    assert np.array_equal(got.vec_id.to_numpy().reshape(-1, 3), order)
    assert np.allclose(got.score.to_numpy().reshape(-1, 3), score, atol=2e-6)


@pytest.mark.parametrize("block", [7, 1024])
def test_neighbours_with_ties_zeros_and_few_rows(spark, block):
    rng = np.random.default_rng(2)
    rows = rng.integers(-1, 2, (90, 3)).astype(float)  # many equal vectors and zero ones
    df = frame(spark, "vec_id", rows)
    asked = df.withColumnRenamed("vec_id", "query_id")
    for own in (False, True):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in R.nearest(asked, df, 5, exclude_self=own, block=block).collect())
        order, _ = brute_nearest(rows, rows, 5, own)
        assert got == [(q, k + 1, int(order[q, k])) for q in range(90) for k in range(5)]
    assert R.nearest(asked, df.where("vec_id < 2"), 5).count() == 180
    assert R.nearest(asked.limit(0), df, 5).count() == 0 and R.nearest(asked, df.limit(0), 5).count() == 0


def test_ranks_of_hot_groups(spark):
    rng = random.Random(3)
    values = {"hot": [rng.choice((1.5, 2.5, rng.random())) for _ in range(9000)], "one": [4.0], None: [float(k) for k in range(101)], "two": [1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in (*own, None)], "k string, v double").repartition(5)
    stats = {r.k: r for r in E.group_statistics(rows, ["k"], "v").collect()}
    told = {r.k: r for r in E.latency_summary(rows, ["k"], "v").collect()}
    assert set(stats) == set(told) == set(values)
    for k, own in values.items():
        assert (stats[k].median, stats[k].min, stats[k].max) == (statistics.median(own), min(own), max(own))
        cuts = statistics.quantiles(own, n=100) if len(own) > 1 else own * 99
        assert told[k].n == len(own) and (told[k].p95, told[k].p99) == pytest.approx((cuts[94], cuts[98]), abs=0.0501)


def test_positions_and_running_totals(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 9), rng.randint(0, 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, w int").repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = K.running_total(K.positions(df, [F.desc("a"), F.asc("id")]), [F.desc("a"), F.asc("id")], "w", "before").orderBy("position").collect()
    assert [(r.id, r.position) for r in got] == [(r[0], k) for k, r in enumerate(order)]
    total = 0
    for r in got:
        assert r.before == total
        total += r.w
