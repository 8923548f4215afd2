"""Known inputs with expectations worked out by hand, and edge rows."""

import pytest
from pyspark.sql import functions as F

from plantscribe.functions import mime as M, text as X
from plantscribe.operators import answers as A, chunking as C, evaluation as E, graph as G, relational as O, retrieval as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "want"), [(1000, [(0, 768), (1, 296)]), (768, [(0, 768)]), (769, [(0, 768), (1, 65)]), (0, [])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k int, text string")
    rows = C.token_windows(df, ["k"]).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.token_count) for r in rows] == want
    if n == 1000:
        assert rows[1].text.split()[0] == "w704"


def test_whole_rows_stay_whole(spark):
    df = spark.createDataFrame([("table", "x " * 1000), ("paragraph", "x " * 1000), ("paragraph", None)], "kind string, text string")
    rows = C.token_windows(df, ["kind"], whole=F.col("kind") == "table").collect()
    assert sorted((r.kind, r.token_count) for r in rows) == [("paragraph", 296), ("paragraph", 768), ("table", 1000)]


def test_score_of_one_term(spark):
    texts = ((1, "pump pump seal ring oil"), (2, "pump seal ring oil belt gear hose tube pipe cap"), (3, "valve"))
    rows = spark.createDataFrame([(d, 0, t) for d, t in texts], "doc_id long, chunk_index int, text string")
    terms = spark.createDataFrame([(9, "pump")], "query_id long, term string")
    top = R.bm25(rows, terms, ["doc_id", "chunk_index"]).collect()
    assert [(r.doc_id, r.rank) for r in top] == [(1, 1), (2, 2)] and top[0].score == 1.0
    assert top[1].score == pytest.approx((0.1 / 1.6) / (0.4 / 1.9), abs=1e-6)


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, r, "x" * 4 * n) for r, n in ((1, 6), (2, 5), (3, 1))], "query_id int, rank int, text string")
    assert [r["rank"] for r in R.token_budget(df, 10).collect()] == [1]


def test_merge_prefers_lexical_on_ties(spark):
    a = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.2)], "query_id int, c int, score double")
    b = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.3), (1, 9, 0.1)], "query_id int, c int, score double")
    assert sorted((r.c, r.source, r.score) for r in R.merge_candidates(a, b, ["c"]).collect()) == [(7, "lexical", 0.5), (8, "vector", 0.3), (9, "vector", 0.1)]


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [source_1] b [source_9] [source_1] [SOURCE_9]", 2), (2, "none", 2), (3, "[source_99999999999]", 2)], "k int, answer string, n_sources int")
    rows = {r.k: (r.n_valid, r.n_hallucinated, r.flag) for r in A.citation_report(df, ["k"]).collect()}
    assert rows == {1: (1, 2, "CITATION_WARNING"), 2: (0, 0, "OK"), 3: (0, 1, "CITATION_WARNING")}
    assert [r.x for r in df.orderBy("k").select(A.drop_invalid_markers(F.col("answer"), F.col("n_sources")).alias("x")).collect()] == ["a [source_1] b  [source_1] ", "none", ""]


def test_rank_metrics(spark):
    r = spark.createDataFrame([(1,), (None,), (4,)], "r int").agg(E.mrr(F.col("r")).alias("m"), E.ndcg(F.col("r")).alias("n")).first()
    assert (r.m, r.n) == (0.4167, 0.4769)
    empty = spark.createDataFrame([], "r int").agg(E.mrr(F.col("r")).alias("m"), E.share(F.col("r") > 0).alias("s")).first()
    assert (empty.m, empty.s) == (0.0, 0.0)


def test_golden_pages(spark):
    golden = spark.createDataFrame([(1, "Doc-A", 3, ["alt"]), (2, "x", None, [])], "query_id int, source string, page int, alternates array<string>")
    ranked = spark.createDataFrame([(1, 1, "doc-a", "t", 5), (1, 2, "doc-a", "t", 4), (1, 3, "z", "ALT", 9), (2, 1, "y", "X", 7)], "query_id int, rank int, document string, title_stem string, page int")
    got = {r.query_id: r.first_rank for r in E.first_hit_ranks(golden, E.golden_hits(golden, ranked)).collect()}
    assert got == {1: 2, 2: 1}


def test_exclusive_percentile(spark):
    import statistics

    for values in ([3.0], [1.0, 2.0], [1.0, 5.0, 9.0, 10.0], [float(x) for x in range(250)]):
        want = statistics.quantiles(values, n=100) if len(values) > 1 else values * 99
        got = one(spark, E.exclusive_percentile(F.array(*map(F.lit, values)), 95))
        assert got == pytest.approx(want[94])
        row = E.latency_summary(spark.createDataFrame([(1, v) for v in values], "k int, v double"), ["k"], "v").first()
        assert (row.p95, row.p99) == pytest.approx((want[94], want[98]), abs=0.0501)  # one place, half up


def test_greedy_resolution(spark):
    df = spark.createDataFrame([(1, k, t, "Sensor") for k, t in enumerate(("FT-1012", "FT-101", "PT-900"))] + [(2, 0, "FT-101", "Equipment"), (2, 1, "FT-102", "Sensor")], "c int, pos int, tag string, entity_type string")
    got = {(r.c, r.tag): r.canonical for r in G.resolve_greedy(df, "c").collect()}
    assert got == {(1, "FT-1012"): "FT-101", (1, "FT-101"): "FT-101", (1, "PT-900"): "PT-900", (2, "FT-101"): "FT-101", (2, "FT-102"): "FT-102"}
    pairs = lambda strict: {(r.a, r.b) for r in G.similar_tags(df.where("entity_type = 'Sensor'"), strict).collect()}
    assert pairs(False) >= {("FT-101", "FT-1012"), ("FT-101", "FT-102")} and pairs(True) == set()


@pytest.mark.parametrize(("tag", "want"), [("PIC-12", ("Sensor", "pressure", None)), ("PMP-7", ("Equipment", None, "pump")), ("ZZ-9", ("Equipment", None, "general")), ("TE001", ("Sensor", "temperature", None))])
def test_tag_classes(spark, tag, want):
    assert tuple(one(spark, G.classify_tags(F.lit(tag)))) == want


def test_types(spark):
    assert one(spark, M.resolve(F.lit("application/octet-stream"), F.lit("report.CSV"), F.lit(b""))) == "text/csv"
    assert one(spark, M.resolve(F.lit("text/x; q=1"), F.lit("noext"), F.lit(b""))) == "text/x"
    assert one(spark, M.resolve(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(b"%PDF-1"))) == "application/pdf"
    assert one(spark, X.decode_bytes(F.lit("é".encode("latin-1")))) == "é" and one(spark, X.decode_bytes(F.lit("﻿é".encode()))) == "é"


@pytest.mark.parametrize(("confidence", "want"), [(1.7, (1.0, False)), (-1, (0.0, True)), (0.59, (0.59, True)), (None, (1.0, False))])
def test_relation_confidence(spark, confidence, want):
    import json

    item = {"source_tag": "A-1", "source_type": "t", "relation_type": "r", "target_tag": "B-2", "target_type": "t"} | ({} if confidence is None else {"confidence": confidence})
    for answer in (json.dumps([item]), f"Sure: {json.dumps([item])} ok", f"```json\n{json.dumps([item])}\n```"):
        (r,) = A.relation_items(spark.createDataFrame([(1, answer)], "k int, answer string"), ["k"]).collect()
        assert (r.confidence, r.tentative) == want
    assert A.relation_items(spark.createDataFrame([(1, "[]"), (2, "nothing"), (3, None), (4, '[{"source_tag": "A"}]')], "k int, answer string"), ["k"]).count() == 0


def test_upserts_are_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = O.upsert(base, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, O.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, O.insert_absent(base, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_expansion_keeps_lonely_seeds_apart(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("x", "r", None)], "src string, relation string, dst string")
    seeds = spark.createDataFrame([("a",), ("lonely",)], "seed string")
    assert {(r.src, r.dst) for r in G.expand(seeds, edges, 2).collect()} == {("a", "b"), ("b", "c")}
    types = spark.createDataFrame([("a", "Asset")], "tag string, node_type string")
    got = {r.seed: (r.n_nodes, r.n_edges, r.node_types) for r in G.summarise(seeds, G.expand(seeds, edges, 2), types).collect()}
    assert got == {"a": (3, 2, ["Asset", "Unknown"]), "lonely": (1, 0, ["Unknown"])}


def test_repeats_in_a_stream(spark, tmp_path):
    from plantscribe.streaming import telemetry as S

    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:02:00"), ("j", "2024-01-01 00:02:00")], "key string, ts string").select("key", F.to_timestamp("ts").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = S.without_repeats(stream, ["key"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["j", "k"]


def test_warnings_of_a_stream_and_replay(spark, tmp_path):
    from plantscribe.streaming import jobs as J

    spark.createDataFrame([(1, "pump"), (2, "valve")], "id int, kind string").coalesce(1).write.parquet(str(tmp_path / "incidents"))
    lessons = spark.createDataFrame([("pump", "check the seal")], "kind string, warning string")
    for _ in range(2):  # the second run finds nothing new
        J.warnings(J.table_stream(spark, str(tmp_path / "incidents")), lessons, lambda a, b: a.join(b, "kind"), str(tmp_path / "out")).awaitTermination()
    assert [(r.id, r.warning) for r in spark.read.parquet(str(tmp_path / "out" / "warnings")).collect()] == [(1, "check the seal")]


def test_late_rows_are_dropped_and_documents_replaced(spark, tmp_path):
    from plantscribe.streaming import jobs as J, telemetry as S

    def events(day, hour, n):
        spark.range(n).selectExpr(f"timestamp'2024-01-{day:02} {hour:02}:00:00' ts", "'a' kind").write.mode("append").parquet(str(tmp_path / "events"))

    root = str(tmp_path / "out")
    for step in ((9, 10, 3), (9, 12, 2), (5, 10, 7), (9, 12, 1)):  # the third comes four days late
        events(*step)
        J.keyed(S.rates(J.table_stream(spark, str(tmp_path / "events")), ["kind"]), "rates", root).awaitTermination()
    got = {r.window_start.hour if r.window_start.day == 9 else -1: r.n for r in J.newest_rows(spark, root, "rates", ["window_start", "kind"]).collect()}
    assert got == {10: 3, 12: 3}

    for rows in ([(1, "old text"), (2, "two"), (2, "zwei")], [(1, "new words here"), (3, " ")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        J.ingest(J.table_stream(spark, str(tmp_path / "docs")), root).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in J.current(spark, root).collect()) == [(1, "new words here"), (2, "two"), (2, "zwei")]
    assert {r.term for r in J.current(spark, root, "postings").where("doc_id = 1").collect()} >= {"new", "words"}


def test_parsers_on_odd_texts(spark):
    from plantscribe.functions import text as X
    from plantscribe.operators import chunking as C

    def rows(f, text, *cols):
        return [tuple(r[c] for c in cols) for r in f(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).collect()]

    assert rows(C.delimited_cells, 'a,"x, y",2\n\n"he said ""hi""\nthere",b"c,\n"open', "row", "col", "value") == [(0, 0, "a"), (0, 1, "x, y"), (0, 2, "2"), (1, 0, 'he said "hi"\nthere'), (1, 1, 'b"c'), (2, 0, '"open')]
    assert rows(C.xml_leaves, "<r><!-- <a>no</a> --><a>1 &lt; 2 &amp;amp;</a><b><![CDATA[plain]]></b></r>", "line") == [("a: 1 < 2 &amp;",), ("b: plain",)]
    assert rows(C.xml_leaves, "<r><a>1</b>\n\nsecond", "line") == [("<r><a>1</b>",), ("second",)]
    assert rows(C.mail_chunks, "\n\n", "text") == [("[Email: ]",)]
    html = "&lt;b&gt; &#233;&#x20AC; &eacute; &amp;lt; &nope; &#36;"
    assert spark.range(1).select(X.unescape(F.lit(html)).alias("t")).first().t == "<b> é€ é &lt; &nope; $"


def test_keyword_search_takes_a_word_of_any_length(spark):
    from plantscribe.operators import relational as O

    history = spark.createDataFrame([(1, "x" * 100_000 + "pump", None), (2, "a pumping station", None)], "wo_id long, description string, completed_date date")
    found = O.keyword_search(spark.createDataFrame([(7, "pump failure")], "incident_id long, text string"), history).collect()
    assert {r.wo_id for r in found} == {1, 2}


def test_ontology_files(spark, tmp_path):
    import json

    from plantscribe.operators.graph import Ontology

    def load(raw):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(raw))
        return Ontology.load(spark, str(path))

    good = {"version": "1", "node_types": {"A": {"required_properties": ["x"]}, "B": {"required_properties": [], "optional_properties": ["y"]}}, "allowed_relations": [{"source": "A", "relation": "R", "target": "B"}]}
    own = load(good)
    assert own.required == {"A": ("x",), "B": ()} and own.triples == (("A", "R", "B"),) and own.nodes(spark).count() == 2
    for bad in ({}, good | {"node_types": {}}, good | {"node_types": {"A": {}}}, good | {"allowed_relations": [{"source": "A"}]}, good | {"allowed_relations": [{"source": "A", "relation": "R", "target": "C"}]}):
        with pytest.raises(ValueError):
            load(bad)


def test_first_balanced_block(spark):
    texts = {'see [[1], [2]] and [3]': "[[1], [2]]", "none": None, "open [ [1]": None, "] [x] ]": "[x]", "[]": "[]", "": None}
    for text, want in texts.items():
        assert one(spark, X.balanced_block(F.lit(text))) == want, text
    assert one(spark, X.noisy_json(F.lit('Sure: [{"a": [1]}] as in [4].'))) == '[{"a": [1]}]'
    assert one(spark, X.noisy_json(F.lit("[note] then [1]"))) is None


def test_greedy_resolution_against_brute_force(spark):
    """Random groups of near tags: the rule read literally, with the edit distance by its recurrence."""
    import functools
    import random

    @functools.cache
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(7)
    rows = [(c, k, rng.choice(("P", "PT", "FT")) + "-" + "".join(rng.choice("12") for _ in range(rng.randint(1, 5))), rng.choice(("Sensor", "Equipment"))) for c in range(30) for k in range(rng.randint(1, 14))]
    want = {}
    for c in range(30):
        groups = []
        for _, k, tag, kind in (r for r in rows if r[0] == c):
            own = next((g for g in groups if g["kind"] == kind and distance(g["canonical"], tag) <= 2), None)
            if own is None:
                own = {"kind": kind, "canonical": tag, "members": []}
                groups.append(own)
            own["canonical"] = tag if len(tag) < len(own["canonical"]) else own["canonical"]
            own["members"].append(k)
        want |= {(c, k): g["canonical"] for g in groups for k in g["members"]}
    df = spark.createDataFrame(rows, "c int, pos int, tag string, entity_type string").repartition(4)
    assert {(r.c, r.pos): r.canonical for r in G.resolve_greedy(df, "c").collect()} == want


def test_greedy_resolution_of_one_hot_group(spark):
    """A group that holds all rows, over several batches: repeats name the same sets again, and other groups stay apart."""
    n = 30_000
    tags = F.concat(F.lit("P-1"), F.lpad(F.pmod("pos", F.lit(40)), 2, "0"), F.when(F.col("pos") % 7 == 0, "000").otherwise(""))
    hot = spark.range(n, numPartitions=8).select(F.lit("x").alias("c"), F.col("id").alias("pos")).withColumn("tag", tags).withColumn("entity_type", F.lit("Equipment"))
    got = G.resolve_greedy(hot, "c")
    assert got.count() == n and got.where("canonical IS NULL").count() == 0
    canonical, place = [], []  # the rule, row by row
    rows = [r.tag for r in hot.orderBy("pos").collect()]
    near = {}
    for tag in rows:
        for k, c in enumerate(canonical):
            if (c, tag) not in near:
                near[c, tag] = edits(c, tag) <= 2
            if near[c, tag]:
                canonical[k] = tag if len(tag) < len(c) else c
                break
        else:
            k = len(canonical)
            canonical.append(tag)
        place.append(k)
    assert [r.canonical for r in got.orderBy("pos").collect()] == [canonical[k] for k in place]


def test_greedy_resolution_of_odd_rows(spark):
    rows = [(None, 0, "FT-1", "Sensor"), (None, 1, "FT-12", "Sensor"), (1, 0, None, "Sensor"), (1, 1, "FT-1", None), (1, 2, "FT-1", None), (1, 2, "FT-1", None), (2, None, "FT-1", "Sensor")]
    df = spark.createDataFrame(rows, "c int, pos int, tag string, entity_type string")
    got = sorted(((r.c, r.pos, r.tag, r.entity_type, r.canonical) for r in G.resolve_greedy(df, "c").collect()), key=str)
    assert got == sorted(((*r, "FT-1" if r[2] else None) for r in rows), key=str)
    assert G.resolve_greedy(df.limit(0), "c").collect() == []


def edits(a, b):
    """Edit distance by whole rows of its table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
