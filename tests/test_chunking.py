from plantscribe.operators import chunking


def test_json_leaves_of_deep_and_invalid_json(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": [1, {"g": "low"}]}}}}}, "z": "top"}'
    df = spark.createDataFrame([(1, deep), (2, "{broken\n\n second part"), (3, None)], "id int, js string")
    got = {(r.id, r.path, r.value) for r in chunking.json_leaves(df, ["id"], "js").collect()}
    assert got == {(1, "a.b.c.d.e.f.0", "1"), (1, "a.b.c.d.e.f.1.g", "low"), (1, "z", "top"), (2, None, "{broken"), (2, None, "second part")}


def test_json_leaves_keep_order_depth_and_spelling(spark):
    deep = '{"k": [' * 500 + "1.50" + "]}" * 500
    df = spark.createDataFrame([(1, deep), (2, '{"b": 1e400, "a": [true, null, {"b": "x"}], "b": -0, "e": {}}'), (3, "NaN"), (4, '"only"'), (5, '{"a": 1} x')], "id int, js string")
    rows = chunking.json_leaves(df, ["id"], "js").orderBy("id", "pos").collect()
    assert [(r.path, r.value) for r in rows if r.id == 1] == [(".".join(["k.0"] * 500), "1.50")]
    assert [(r.path, r.value) for r in rows if r.id == 2] == [("b", "1e400"), ("a.0", "true"), ("a.1", None), ("a.2.b", "x"), ("b", "-0")]
    assert [(r.path, r.value) for r in rows if r.id > 2] == [(None, "NaN"), ("", "only"), (None, '{"a": 1} x')]
    assert chunking.json_leaves(df.where("id = 2"), ["id"], "js", 2).count() == 4


def test_json_leaves_take_one_job(spark):
    df = spark.range(1000).selectExpr("id", """concat('{"a":', repeat('[', 40), id, repeat(']', 40), '}') AS js""")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    spark.sparkContext.setJobGroup("leaves", "one pass")
    assert chunking.json_leaves(df, ["id"], "js").write.format("noop").mode("overwrite").save() is None
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("leaves"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and before >= 0


def test_xml_leaves_of_mixed_content(spark):
    texts = {
        1: "<a><b>t1<c>in</c>t2</b></a>", 2: "<a x='1>2'><![CDATA[<q>no tag</q>]]> &amp; <!-- c --> more</a>", 3: '<?xml version="1.0" encoding="latin-1"?><é:a xmlns:é="u">ß&#8364;</é:a>',
        4: "<a><b></b><c/> </a>", 5: "<a>&undefined;</a>", 6: None, 7: "<n>" * 3000 + "deep" + "</n>" * 3000, 8: "<x:a>unbound</x:a>",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {}
    for r in chunking.xml_leaves(df, ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got == {1: ["b: t1", "c: in"], 2: ["a: <q>no tag</q> &  more"], 3: ["a: ß€"], 4: ["<a><b></b><c/> </a>"], 5: ["<a>&undefined;</a>"], 7: ["n: deep"], 8: ["<x:a>unbound</x:a>"]}
