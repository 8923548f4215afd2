from pyspark.sql import functions as F

from plantscribe.operators import graph as G
from plantscribe.sources import tables as T
from plantscribe.sources.keyed import KeyedTables


def state(tables, name="chunks"):
    return sorted(tuple(r) for r in tables.read(name).collect())


def test_keyed_replacement_on_disk(spark, tmp_path):
    """One key of a thousand is replaced, one deleted; the others stay, in all tables, also after compaction."""
    tables = KeyedTables(spark, str(tmp_path / "store"), "doc_id")
    base = spark.createDataFrame([(d, k, "old") for d in range(1000) for k in range(2)], "doc_id long, chunk_index int, text string")
    assert tables.replace({"chunks": base, "postings": base.select("doc_id", F.lit("t").alias("term"))})
    new = spark.createDataFrame([(7, 0, "new")], "doc_id long, chunk_index int, text string")
    gone = spark.createDataFrame([(7,), (9,)], "doc_id long")
    tables.replace({"chunks": new, "postings": new.select("doc_id", F.lit("u").alias("term"))}, keys=gone)
    want = sorted([(d, k, "old") for d in range(1000) if d not in (7, 9) for k in range(2)] + [(7, 0, "new")])
    terms = sorted([(d, "t") for d in range(1000) if d not in (7, 9) for _ in range(2)] + [(7, "u")])
    assert state(tables) == want and state(tables, "postings") == terms
    tables.replace({"chunks": new})  # again: postings of the key go, since they aren't told anew
    assert state(tables) == want and state(tables, "postings") == [x for x in terms if x[0] != 7]
    assert tables.compact() and not tables.compact()
    assert state(tables) == want and state(tables, "postings") == [x for x in terms if x[0] != 7]
    tables.clear()
    assert state(tables) == want and len(list((tmp_path / "store" / "data").iterdir())) == 1
    more = spark.createDataFrame([(7, 1, "newest", 5)], "doc_id long, chunk_index int, text string, page int")
    tables.replace({"chunks": more})
    assert {tuple(r) for r in tables.read("chunks").where("doc_id < 9 AND doc_id > 5").collect()} == {(6, 0, "old", None), (6, 1, "old", None), (7, 1, "newest", 5), (8, 0, "old", None), (8, 1, "old", None)}


def test_killed_and_repeated_writes(spark, tmp_path):
    tables = KeyedTables(spark, str(tmp_path / "store"), "k")
    rows = lambda *v: spark.createDataFrame(list(v), "k int, v string")
    tables.replace({"t": rows((1, "a"), (2, "b"))}, stream="s", number=0)
    killed = tables.batch()
    killed.put("t", rows((1, "lost")))  # no commit follows
    assert state(tables, "t") == [(1, "a"), (2, "b")]
    assert tables.replace({"t": rows((2, "c"))}, stream="s", number=1)
    assert not tables.replace({"t": rows((2, "twice"))}, stream="s", number=1)
    assert state(tables, "t") == [(1, "a"), (2, "c")]
    slow = tables.batch()  # a write that began before a compaction and ends after it
    slow.put("t", rows((1, "late")))
    tables.compact()
    assert tables.commit(slow, rows((1, "late")))
    assert state(tables, "t") == [(1, "late"), (2, "c")]
    folders = tuple(b["folder"] for b in tables.manifest()["batches"])
    two = [tables.batch(), tables.batch()]
    for own in two:
        own.put("t", tables.read("t"))
    assert tables.commit(two[0], rows((1, ""), (2, "")), instead=folders)
    assert not tables.commit(two[1], rows((1, ""), (2, "")), instead=folders)
    assert state(tables, "t") == [(1, "late"), (2, "c")] and tables.manifest()["done"] == {"s": 1}


def test_files_csv_and_appends(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "orders.csv").write_text("wo_id,asset_tag,description,status,priority,scheduled_date,completed_date\nWO-1,P-1,x,OPEN,HIGH,2024-01-02,\nWO-2,P-1,y,COMPLETED,LOW,,bad\n")
    rows = T.work_order_csv(spark, str(tmp_path / "w")).orderBy("wo_id").collect()
    assert str(rows[0].scheduled_date) == "2024-01-02" and rows[0].completed_date is None and rows[1].scheduled_date is None and rows[1].completed_date is None
    (f,) = T.raw_files(spark, str(tmp_path / "w")).collect()
    assert f.name == "orders.csv" and f["size"] == len(f.content) and len(f.sha256) == 64
    (tmp_path / "g.json").write_text('[{"question": "q", "expected_answer": "a", "source_document_id": "d"}]')
    (g,) = T.golden_json(spark, str(tmp_path / "g.json")).collect()
    assert g.category == "general" and g.alternate_sources == [] and g.source_page is None
    for run in range(3):
        T.append(spark.createDataFrame([(run,)], "run int"), str(tmp_path / "runs"))
    assert [r.run for r in T.newest(spark, str(tmp_path / "runs"), "run", 2).collect()] == [2, 1]


def test_ontology_tables_and_empty_inputs(spark):
    assert G.INDUSTRIAL.nodes(spark).count() == 12 and G.INDUSTRIAL.relations(spark).count() == 19
    try:
        G.Ontology({"A": ()}, (("A", "R", "B"),))
        raise AssertionError("unknown types must be refused")
    except ValueError:
        pass
    nodes = spark.createDataFrame([("Martian", {"x": "1"}), ("Asset", {"tag_number": "A-1", "name": ""})], "node_type string, props map<string,string>")
    assert {(r.node_type, r.valid) for r in G.check_nodes(nodes).collect()} == {("Martian", False), ("Asset", False)}
    none = spark.createDataFrame([], "entity_type string, tag string, seq int, manufacturer string, model string")
    assert G.resolve_models(none).count() == 0 and G.similar_tags(none).count() == 0
