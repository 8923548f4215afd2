"""Tags, resolution, ontology and graph operators over ``region nation supplier part lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G, relational as O, retrieval as R
from .base import Registry, read, sql_list

registry = Registry()

TEXT_SQL = "txt AS (SELECT l_orderkey AS order_id, l_linenumber AS line, 'Supplier CMP-' || l_suppkey || ' serves P-' || l_partkey || ' with FT' || (100 + l_linenumber) || ', te-5 and ZZ-9A' AS text FROM lineitem)"
TAG_RE = r"\b(?:[A-Z]{1,4}-\d+[A-Z]?|[A-Z]{1,4}\d{3,}[A-Z]?)\b"


def tag_texts(spark, sf_dir):
    text = F.concat(F.lit("Supplier CMP-"), "l_suppkey", F.lit(" serves P-"), "l_partkey", F.lit(" with FT"), F.col("l_linenumber") + 100, F.lit(", te-5 and ZZ-9A"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), text.alias("text"))


@registry.add(f"""WITH {TEXT_SQL}, t AS (SELECT order_id, line, unnest(regexp_extract_all(text, '{TAG_RE}')) AS tag FROM txt)
SELECT order_id, line, tag, CASE WHEN tag LIKE 'FT%' THEN 'Sensor' ELSE 'Equipment' END AS entity_type, CASE WHEN tag LIKE 'FT%' THEN 'flow' END AS measurement,
 CASE WHEN tag LIKE 'CMP%' THEN 'compressor' WHEN tag LIKE 'P-%' THEN 'pump' WHEN tag LIKE 'ZZ%' THEN 'general' END AS class FROM t""")
def extract_entities(spark, sf_dir):
    return G.extract_entities(tag_texts(spark, sf_dir), ["order_id", "line"]).drop("pos")


@registry.add("""SELECT prefix || '-12' AS tag, kind AS entity_type FROM (SELECT unnest(%s) AS prefix, unnest(%s) AS kind) UNION ALL SELECT 'P-' || p_partkey, 'Equipment' FROM part""" % (sql_list(G.TAG_PREFIXES), sql_list(v[0] for v in G.TAG_PREFIXES.values())))  # noqa: UP031
def classify_tags(spark, sf_dir):
    known = spark.createDataFrame([(f"{p}-12",) for p in G.TAG_PREFIXES], "tag string")
    tags = known.unionByName(read(spark, sf_dir, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("tag")))
    return tags.select("tag", G.classify_tags(F.col("tag"))["entity_type"].alias("entity_type"))


INTENT_TEXT_SQL = "q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'status of P-' || user_id || '?' WHEN 2 THEN 'How To restart unit ' || user_id WHEN 3 THEN 'see wo-' || user_id || ' and WO-1' ELSE 'pressure loss ' || event_type END AS question FROM events)"


@registry.add(f"""WITH {INTENT_TEXT_SQL} SELECT event_id, CASE WHEN trim(question) = '' THEN 'unknown' WHEN regexp_matches(question, '{TAG_RE}') THEN 'entity_lookup' WHEN regexp_matches(question, '(?i)\\b(how to|how do i|steps to|procedure|instructions|walk me through)\\b') THEN 'procedural' ELSE 'document_search' END AS intent,
 nullif(regexp_extract(question, '{TAG_RE}'), '') AS first_tag, upper(nullif(regexp_extract(question, '(?i)\\bWO-\\d+\\b'), '')) AS work_order FROM q""")
def question_intents(spark, sf_dir):
    k = F.col("event_id") % 5
    question = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("status of P-"), "user_id", F.lit("?"))).when(k == 2, F.concat(F.lit("How To restart unit "), "user_id")).when(k == 3, F.concat(F.lit("see wo-"), "user_id", F.lit(" and WO-1"))).otherwise(F.concat(F.lit("pressure loss "), "event_type"))
    q = read(spark, sf_dir, "events").select("event_id", question.alias("q"))
    return q.select("event_id", X.intent(F.col("q")).alias("intent"), X.first_tag(F.col("q")).alias("first_tag"), X.first_work_order(F.col("q")).alias("work_order"))


SIMILAR = """WITH t AS (SELECT DISTINCT 'Equipment' AS entity_type, 'CMP-' || s_suppkey || substr(s_name, -2) AS tag FROM supplier)
SELECT a.entity_type, a.tag AS a, b.tag AS b, levenshtein(a.tag, b.tag)::INT AS distance FROM t a JOIN t b ON a.tag < b.tag AND levenshtein(a.tag, b.tag) <= 2"""


def supplier_tags(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.lit("Equipment").alias("entity_type"), F.concat(F.lit("CMP-"), "s_suppkey", F.substring("s_name", -2, 2)).alias("tag"))


@registry.add(SIMILAR)
def similar_tags(spark, sf_dir):
    return G.similar_tags(supplier_tags(spark, sf_dir))


@registry.add(SIMILAR + " AND regexp_replace(a.tag, '\\D', '', 'g') = regexp_replace(b.tag, '\\D', '', 'g')")
def similar_tags_strict(spark, sf_dir):
    return G.similar_tags(supplier_tags(spark, sf_dir), strict=True)


@registry.add()
def resolve_greedy(spark, sf_dir):
    """Order-dependent, so rows only; the tests hold it against hand-made cases."""
    found = G.extract_entities(tag_texts(spark, sf_dir), ["order_id", "line"]).withColumn("pos", F.col("line") * 100 + F.col("pos"))
    return G.resolve_greedy(found.select("order_id", "pos", "tag", "entity_type"), "order_id")


ENT_SQL = "ent AS (SELECT p_partkey AS seq, 'P-' || p_partkey AS tag, CASE WHEN p_partkey % 9 = 0 THEN 'Sensor' ELSE 'Equipment' END AS entity_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE ' ' || lower(p_brand) END AS manufacturer, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size::VARCHAR END AS model, CASE WHEN p_partkey % 10 = 0 THEN lower(p_brand) || ' ' END AS bag_maker, CASE WHEN p_partkey % 14 = 0 THEN p_size::VARCHAR END AS bag_model, 'c' || (p_partkey % 3) AS color FROM part)"
RES_SQL = f"""{ENT_SQL}, st AS (SELECT *, upper(trim(coalesce(manufacturer, bag_maker))) AS m, upper(trim(coalesce(model, bag_model))) AS k FROM ent),
c AS (SELECT m, k, min_by(tag, seq) AS canonical FROM st WHERE entity_type = 'Equipment' AND m IS NOT NULL AND k IS NOT NULL GROUP BY ALL),
res AS (SELECT e.*, coalesce(c.canonical, e.tag) AS canonical FROM st e LEFT JOIN c ON e.entity_type = 'Equipment' AND c.m = e.m AND c.k = e.k)"""


def equipment(spark, sf_dir):
    """Some makers and models stand in the property bag only."""
    k = F.col("p_partkey")
    bag = {"manufacturer": F.when(k % 10 == 0, F.concat(F.lower("p_brand"), F.lit(" "))), "model_number": F.when(k % 14 == 0, F.col("p_size").cast("string")), "color": F.concat(F.lit("c"), k % 3)}
    props = F.map_filter(F.create_map(*(x for n, v in bag.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
    return read(spark, sf_dir, "part").select(k.alias("seq"), props.alias("props"), F.concat(F.lit("P-"), k).alias("tag"), F.when(k % 9 == 0, "Sensor").otherwise("Equipment").alias("entity_type"), F.when(k % 5 != 0, F.concat(F.lit(" "), F.lower("p_brand"))).alias("manufacturer"), F.when(k % 7 != 0, F.col("p_size").cast("string")).alias("model"))


@registry.add(f"WITH {RES_SQL} SELECT tag, entity_type, canonical FROM res")
def resolve_models(spark, sf_dir):
    return G.resolve_models(equipment(spark, sf_dir)).select("tag", "entity_type", "canonical")


@registry.add(f"""WITH {RES_SQL} SELECT entity_type, canonical, min_by(tag, length(tag) * 1000000000 + seq) AS tag, min_by(manufacturer, seq) FILTER (manufacturer IS NOT NULL) AS manufacturer, min_by(model, seq) FILTER (model IS NOT NULL) AS model, count(*) AS members,
 concat_ws(',', 'color=' || min_by(color, seq), 'manufacturer=' || min_by(bag_maker, seq) FILTER (bag_maker IS NOT NULL), 'model_number=' || min_by(bag_model, seq) FILTER (bag_model IS NOT NULL)) AS props FROM res GROUP BY entity_type, canonical""")
def merge_entities(spark, sf_dir):
    found = G.merge_entities(G.resolve_models(equipment(spark, sf_dir)))
    return found.withColumn("props", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","))


NODES_SQL = """nodes AS (SELECT 'R-' || r_regionkey AS tag, 'Asset' AS node_type, r_name AS name FROM region UNION ALL SELECT 'N-' || n_nationkey, 'Asset', n_name FROM nation
 UNION ALL SELECT 'CMP-' || s_suppkey, 'Equipment', s_name FROM supplier UNION ALL SELECT 'P-' || p_partkey, 'Equipment', p_name FROM part),
edges AS (SELECT 'N-' || n_nationkey AS src, 'IS_PART_OF' AS relation, 'R-' || n_regionkey AS dst FROM nation UNION ALL SELECT 'CMP-' || s_suppkey, 'IS_PART_OF', 'N-' || s_nationkey FROM supplier
 UNION ALL SELECT DISTINCT 'P-' || l_partkey, 'IS_PART_OF', 'CMP-' || l_suppkey FROM lineitem)"""


def nodes(spark, sf_dir):
    def tagged(name, prefix, key, kind, label):
        return read(spark, sf_dir, name).select(F.concat(F.lit(prefix), key).alias("tag"), F.lit(kind).alias("node_type"), F.col(label).alias("name"))

    return tagged("region", "R-", "r_regionkey", "Asset", "r_name").unionByName(tagged("nation", "N-", "n_nationkey", "Asset", "n_name")).unionByName(tagged("supplier", "CMP-", "s_suppkey", "Equipment", "s_name")).unionByName(tagged("part", "P-", "p_partkey", "Equipment", "p_name"))


def edges(spark, sf_dir, once=True):
    """Each edge once, or as often as it is stated for readers that see to that themselves."""

    def linked(df, a, b):
        return df.select(F.concat(*a).alias("src"), F.lit("IS_PART_OF").alias("relation"), F.concat(*b).alias("dst"))

    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    line = line.distinct() if once else line
    return linked(read(spark, sf_dir, "nation"), (F.lit("N-"), "n_nationkey"), (F.lit("R-"), "n_regionkey")).unionByName(linked(read(spark, sf_dir, "supplier"), (F.lit("CMP-"), "s_suppkey"), (F.lit("N-"), "s_nationkey"))).unionByName(linked(line, (F.lit("P-"), "l_partkey"), (F.lit("CMP-"), "l_suppkey")))


@registry.add(f"WITH {NODES_SQL} SELECT node_type, tag, CASE node_type WHEN 'Equipment' THEN ['equipment_class'] ELSE [] END AS missing, node_type = 'Asset' AS valid FROM nodes")
def ontology_nodes(spark, sf_dir):
    props = F.create_map(F.lit("tag_number"), "tag", F.lit("name"), "name")
    return G.check_nodes(nodes(spark, sf_dir).withColumn("props", props)).select("node_type", "tag", "missing", "valid")


TYPED_SQL = f"""{NODES_SQL}, typed AS (SELECT e.*, a.node_type AS source_type, b.node_type AS target_type FROM edges e JOIN nodes a ON a.tag = e.src JOIN nodes b ON b.tag = e.dst)"""


def typed_edges(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return edges(spark, sf_dir).join(n.select(F.col("tag").alias("src"), F.col("node_type").alias("source_type")), "src").join(n.select(F.col("tag").alias("dst"), F.col("node_type").alias("target_type")), "dst")


@registry.add(f"WITH {TYPED_SQL} SELECT src, relation, dst, source_type = 'Equipment' AS allowed FROM typed")
def ontology_relations(spark, sf_dir):
    """Equipment is part of equipment or an asset; an asset of an asset is rejected."""
    good, bad = G.check_relations(typed_edges(spark, sf_dir))
    return good.withColumn("allowed", F.lit(True)).unionByName(bad.withColumn("allowed", F.lit(False))).select("src", "relation", "dst", "allowed")


@registry.add(f"WITH {NODES_SQL} SELECT DISTINCT e.src, e.relation, e.dst FROM edges e JOIN nodes a ON a.tag = e.src AND a.node_type = 'Equipment' JOIN nodes b ON b.tag = e.dst AND b.node_type = 'Equipment'")
def merge_edges(spark, sf_dir):
    stated = edges(spark, sf_dir).withColumns({"source_type": F.lit("Equipment"), "target_type": F.lit("Equipment")})
    return G.merge_edges(stated.unionByName(stated), nodes(spark, sf_dir)).select("src", "relation", "dst")


@registry.add(f"WITH {TEXT_SQL}, {NODES_SQL}, m AS (SELECT DISTINCT order_id || '-' || line AS chunk, unnest(regexp_extract_all(text, '{TAG_RE}')) AS tag FROM txt) SELECT chunk, tag FROM m WHERE tag IN (SELECT tag FROM nodes)")
def mention_edges(spark, sf_dir):
    found = G.extract_entities(tag_texts(spark, sf_dir), ["order_id", "line"]).select(F.concat_ws("-", "order_id", "line").alias("chunk"), "tag").distinct()
    return found.join(nodes(spark, sf_dir).select("tag"), "tag", "left_semi").select("chunk", "tag")


@registry.add("SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS props FROM (SELECT user_id, event_type AS k, max(event_id) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def node_overlay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("props"))
    pairs = F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return O.merge_overlay(rows, ["user_id"], "props", "event_id").select("user_id", F.array_join(F.array_sort(pairs), ",").alias("props"))


HOPS_SQL = f"""WITH RECURSIVE {NODES_SQL}, ste AS (SELECT src AS node, dst AS next FROM edges UNION SELECT dst, src FROM edges), seeds AS (SELECT 'CMP-' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'NOWHERE-1'),
w(seed, node, d) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, ste.next, d + 1 FROM w JOIN ste ON ste.node = w.node WHERE d < 2), r AS (SELECT DISTINCT seed, node FROM w),
sub AS (SELECT DISTINCT a.seed, e.src, e.relation, e.dst FROM edges e JOIN r a ON a.node = e.src JOIN r b ON b.node = e.dst AND b.seed = a.seed)"""


def seeds(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("CMP-"), "s_suppkey").alias("seed"))
    return own.unionByName(spark.createDataFrame([("NOWHERE-1",)], "seed string"))


@registry.add(f"{HOPS_SQL} SELECT * FROM sub")
def khop_subgraph(spark, sf_dir):
    return G.expand(seeds(spark, sf_dir), edges(spark, sf_dir), 2)


@registry.add(f"{HOPS_SQL} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY src, relation, dst) AS k FROM sub) WHERE k <= 50")
def khop_limited(spark, sf_dir):
    return G.expand(seeds(spark, sf_dir), edges(spark, sf_dir), 2, 50)


@registry.add(f"""{HOPS_SQL}, en AS (SELECT seed, src AS tag FROM sub UNION SELECT seed, dst FROM sub UNION SELECT seed, seed FROM seeds)
SELECT en.seed, count(DISTINCT en.tag) AS n_nodes, list_sort(list(DISTINCT coalesce(n.node_type, 'Unknown'))) AS node_types, (SELECT count(*) FROM sub WHERE sub.seed = en.seed) AS n_edges FROM en LEFT JOIN nodes n USING (tag) GROUP BY en.seed""")
def subgraph_summary(spark, sf_dir):
    return G.subgraph_summary(seeds(spark, sf_dir), edges(spark, sf_dir, once=False), nodes(spark, sf_dir))


@registry.add(f"WITH {NODES_SQL} SELECT tag, count(*) AS degree FROM (SELECT src AS tag FROM edges WHERE src <> dst UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY tag")
def node_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@registry.add(f"WITH {NODES_SQL} SELECT src AS tag, relation, dst AS other, 'out' AS direction FROM edges WHERE src <> dst UNION ALL SELECT dst, relation, src, 'in' FROM edges WHERE src <> dst")
def node_relations(spark, sf_dir):
    """Each node's relations as rows, not as one array of a hub's."""
    return G.relations_of(edges(spark, sf_dir))


@registry.add(f"WITH {NODES_SQL} SELECT list_sort(list(DISTINCT node_type)) AS node_types FROM nodes")
def node_types(spark, sf_dir):
    return nodes(spark, sf_dir).agg(F.array_sort(F.collect_set("node_type")).alias("node_types"))


@registry.add(f"""WITH {TYPED_SQL} SELECT dst AS seed, md5('| Source | Relation | Target |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || src || ' | ' || relation || ' | ' || dst || ' |', chr(10) ORDER BY src)) AS table_md5 FROM typed GROUP BY dst""")
def path_tables(spark, sf_dir):
    from ..operators.answers import markdown_table

    return typed_edges(spark, sf_dir).groupBy(F.col("dst").alias("seed")).agg(F.md5(markdown_table(["Source", "Relation", "Target"], ["src", "relation", "dst"], ["src"])).alias("table_md5"))


@registry.add(f"""WITH {TYPED_SQL} SELECT dst AS seed, (row_number() OVER (PARTITION BY dst ORDER BY src, relation) + 1)::BIGINT AS line_no, '| ' || src || ' | ' || relation || ' | ' || dst || ' |' AS line FROM typed
UNION ALL SELECT seed, k, line FROM (SELECT DISTINCT dst AS seed FROM typed), (SELECT unnest([0, 1]) AS k, unnest(['| Source | Relation | Target |', '|---|---|---|']) AS line)""")
def path_table_lines(spark, sf_dir):
    """The tables as numbered lines: a hub's table is no single text."""
    from ..operators.answers import markdown_lines

    rows = typed_edges(spark, sf_dir).withColumn("seed", F.col("dst"))
    return markdown_lines(rows, ["seed"], ["Source", "Relation", "Target"], ["src", "relation", "dst"], ["src", "relation"])


@registry.add(f"""WITH {NODES_SQL}, ex AS (SELECT 'CMP-' || l_suppkey AS src, 'FM-' || (l_quantity::INT % 10) AS dst FROM lineitem WHERE l_returnflag = 'R'), fm AS (SELECT 'FM-' || k AS code, 'failure ' || k AS description FROM range(0, 8) t(k))
SELECT n.tag, fm.code, fm.description, count(*) AS occurrences FROM ex JOIN nodes n ON n.tag = ex.src AND n.node_type = 'Equipment' JOIN fm ON fm.code = ex.dst GROUP BY ALL""")
def failure_history(spark, sf_dir):
    exhibits = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("CMP-"), "l_suppkey").alias("tag"), F.concat(F.lit("FM-"), F.round("l_quantity").cast("int") % 10).alias("code"))
    modes = spark.range(8).select(F.concat(F.lit("FM-"), "id").alias("code"), F.concat(F.lit("failure "), "id").alias("description"))
    owners = nodes(spark, sf_dir).where("node_type = 'Equipment'").select("tag")
    return exhibits.join(owners, "tag", "left_semi").join(modes, "code").groupBy("tag", "code", "description").agg(F.count("*").alias("occurrences"))


@registry.add(f"""WITH {NODES_SQL}, ex AS (SELECT 'CMP-' || l_suppkey AS src, 'FM-' || (l_quantity::INT % 10) AS dst FROM lineitem WHERE l_returnflag = 'R'), fm AS (SELECT 'FM-' || k AS code, 'failure ' || k AS description FROM range(0, 8) t(k))
SELECT n.tag, '- ' || n.tag || ': ' || fm.description || ' (' || fm.code || ', ' || count(*) || 'x)' AS line FROM ex JOIN nodes n ON n.tag = ex.src AND n.node_type = 'Equipment' JOIN fm ON fm.code = ex.dst GROUP BY n.tag, fm.code, fm.description""")
def failure_lines(spark, sf_dir):
    return O.failure_lines(failure_history(spark, sf_dir))


LESSONS_SQL = """les AS (SELECT e.vec_id AS lesson_id, e.embedding, CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE upper(d.lang) || ': ' || d.text END AS summary, d.text AS description FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 3 <> 0),
qv AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 20 = 0),
lv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sm AS (SELECT query_id, vec_id AS lesson_id, round(list_dot_product(qv.e, lv.e) / sqrt(list_dot_product(qv.e, qv.e)) / sqrt(list_dot_product(lv.e, lv.e)), 9) AS s FROM qv, lv WHERE query_id <> vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, lesson_id)::INT AS rank FROM sm)"""


def lessons(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("lesson_id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.upper("lang"), F.lit(": "), "text")).alias("summary"), F.col("text").alias("description"))
    return d.join(read(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("lesson_id")), "lesson_id", "left_semi")


def similar(spark, sf_dir, k):
    e = read(spark, sf_dir, "embeddings")
    return R.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, k, exclude_self=True).withColumnRenamed("vec_id", "lesson_id")


@registry.add(f"WITH {LESSONS_SQL} SELECT query_id, lesson_id, round(s, 6) AS score, rank FROM rk WHERE rank <= 3")
def similar_lessons(spark, sf_dir):
    return similar(spark, sf_dir, 3)


@registry.add(f"WITH {LESSONS_SQL} SELECT query_id, r.lesson_id, round(s, 6) AS score, coalesce(nullif(summary, ''), description) AS warning FROM rk r JOIN les USING (lesson_id) WHERE rank = 1 AND round(s, 6) > 0.3")
def proactive_warnings(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return warned(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, lessons(spark, sf_dir))


def warned(incidents, vectors, known, threshold=0.3):
    """The best lesson's record, if it has one; the usual threshold is 0.85, lower here so that some pass."""
    best = R.nearest(incidents, vectors, 1, exclude_self=True).withColumnRenamed("vec_id", "lesson_id").where(F.col("score") > threshold).drop("rank")
    return best.join(known, "lesson_id").select("query_id", "lesson_id", "score", F.coalesce(F.nullif("summary", F.lit("")), "description").alias("warning"))


@registry.add(f"""WITH {NODES_SQL}, l AS (SELECT doc_id AS lesson_id, 'CMP-' || doc_id AS asset_tag, ['FM-' || (doc_id % 10), 'FM-' || (doc_id % 4)] AS codes FROM documents)
SELECT lesson_id, asset_tag IN (SELECT tag FROM nodes WHERE node_type = 'Equipment') AS asset_linked, list_sort(list_distinct(list_filter(codes, lambda c: c IN ('FM-0', 'FM-1', 'FM-2', 'FM-3', 'FM-4', 'FM-5', 'FM-6', 'FM-7')))) AS linked_codes FROM l""")
def lesson_links(spark, sf_dir):
    """A missing asset or code is reported, not created."""
    d = F.col("doc_id")
    base = read(spark, sf_dir, "documents").select(d.alias("lesson_id"), F.concat(F.lit("CMP-"), d).alias("asset_tag"), F.array(F.concat(F.lit("FM-"), d % 10), F.concat(F.lit("FM-"), d % 4)).alias("codes"))
    owners = nodes(spark, sf_dir).where("node_type = 'Equipment'").select(F.col("tag").alias("asset_tag"), F.lit(True).alias("_a"))
    modes = spark.range(8).select(F.concat(F.lit("FM-"), "id").alias("code"))
    linked = base.select("lesson_id", F.explode("codes").alias("code")).join(modes, "code", "left_semi").groupBy("lesson_id").agg(F.array_sort(F.collect_set("code")).alias("linked_codes"))
    out = base.join(owners, "asset_tag", "left").join(linked, "lesson_id", "left")
    return out.select("lesson_id", F.col("_a").isNotNull().alias("asset_linked"), F.coalesce("linked_codes", F.array().cast("array<string>")).alias("linked_codes"))


@registry.add(f"""WITH {TEXT_SQL}, e AS (SELECT order_id, line, list_distinct(regexp_extract_all(text, '{TAG_RE}')) AS tags FROM txt), p AS (SELECT order_id, line, unnest(tags) AS src, tags FROM e), q AS (SELECT order_id, line, src, unnest(tags) AS dst FROM p)
SELECT DISTINCT src, CASE WHEN src LIKE 'FT%' THEN 'MONITORS' ELSE 'IS_PART_OF' END AS relation, dst FROM q WHERE src <> dst AND dst NOT LIKE 'FT%'""")
def co_occurring_relations(spark, sf_dir):
    """The relation extractor that needs no model: tags of one text in pairs that the ontology allows."""
    return typed_pairs(tag_texts(spark, sf_dir), []).distinct()


def typed_pairs(chunks, keys):
    """``keys, src, relation, dst``: allowed pairs of all tags of a chunk, if it has two; a chunk's window bounds its tags."""
    kind = lambda t: F.struct(t.alias("tag"), G.classify_tags(t)["entity_type"].alias("kind"))
    rules = F.broadcast(G.INDUSTRIAL.relations(chunks.sparkSession))  # as many rows as triples
    # A tag is looked for and classified once: a filter on the tags, or the one that explode infers, would do it all again.
    own = chunks.select(*keys, F.transform(F.array_distinct(X.tags(F.col("text"))), kind).alias("tags"))
    sources = own.select(*keys, "tags", F.explode_outer("tags").alias("_s")).select(*keys, "tags", F.col("_s.tag").alias("src"), F.col("_s.kind").alias("source_type"))
    pairs = sources.join(rules, "source_type").select(*keys, "src", "relation", "target_type", F.explode_outer("tags").alias("_d"))
    return pairs.where("_d.kind = target_type AND _d.tag <> src").select(*keys, "src", "relation", F.col("_d.tag").alias("dst"))
