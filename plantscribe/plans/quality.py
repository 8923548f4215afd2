"""Citations, noisy answers and retrieval evaluation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators import answers as A, evaluation as E
from ..session import cut, stored
from .base import Registry, read
from .retrieval import BM25_SQL, RERANK_SQL, lexical, questions, reranked

registry = Registry()
KEYS = ["conv_id", "turn"]
ANSWER_SQL = "ans AS (SELECT conv_id, turn, left(text, 40) || ' [source_' || (turn % 4) || '] and [SOURCE_2] ' || substr(text, 41) || '[source_9] [source_' || turn || '].' AS answer, 3 AS n_sources FROM conversations)"


def answers(spark, sf_dir):
    t = F.col("turn")
    text = F.concat(F.substring("text", 1, 40), F.lit(" [source_"), t % 4, F.lit("] and [SOURCE_2] "), F.expr("substring(text, 41)"), F.lit("[source_9] [source_"), t, F.lit("]."))
    return read(spark, sf_dir, "conversations").select(*KEYS, text.alias("answer"), F.lit(3).alias("n_sources"))


MARKS_SQL = f"""{ANSWER_SQL}, nums AS (SELECT *, list_transform(regexp_extract_all(answer, '(?i)\\[source_(\\d+)\\]', 1), lambda x: x::INT) AS ns FROM ans)"""


@registry.add(f"""WITH {MARKS_SQL} SELECT conv_id, turn, len(list_distinct(list_filter(ns, lambda x: x BETWEEN 1 AND 3)))::INT AS n_valid, len(list_filter(ns, lambda x: x NOT BETWEEN 1 AND 3))::INT AS n_hallucinated,
CASE WHEN len(list_filter(ns, lambda x: x NOT BETWEEN 1 AND 3)) > 0 THEN 'CITATION_WARNING' ELSE 'OK' END AS flag FROM nums""")
def citation_report(spark, sf_dir):
    return A.citation_report(answers(spark, sf_dir), KEYS)


@registry.add(f"WITH {ANSWER_SQL} SELECT conv_id, turn, regexp_replace(answer, '(?i)\\[source_(0+|[4-9]|[1-9]\\d+)\\]', '', 'g') AS answer FROM ans")
def strip_invalid_markers(spark, sf_dir):
    return answers(spark, sf_dir).select(*KEYS, A.drop_invalid_markers(F.col("answer"), F.col("n_sources")).alias("answer"))


@registry.add(f"""WITH {BM25_SQL % 10}, ans AS (SELECT item_id AS query_id, 'x [source_1] y [source_' || (item_id % 13) || ']' AS answer FROM benchmark),
m AS (SELECT query_id, unnest(regexp_extract_all(answer, '(?i)\\[source_(\\d+)\\]', 1))::INT AS n, generate_subscripts(regexp_extract_all(answer, '(?i)\\[source_(\\d+)\\]', 1), 1) - 1 AS pos FROM ans)
SELECT m.query_id, pos::INT AS pos, n, doc_id, chunk_index FROM m LEFT JOIN bm25 b ON b.query_id = m.query_id AND b.rank = m.n""")
def citation_resolution(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.lit("x [source_1] y [source_"), F.col("query_id") % 13, F.lit("]")).alias("answer"))
    return A.resolve_citations(asked, lexical(spark, sf_dir).drop("score"), ["query_id"]).select("query_id", "pos", "n", "doc_id", "chunk_index")


CITED_SQL = f"""{BM25_SQL % 10}, ret AS (SELECT query_id, doc_id || '-' || chunk_index AS chunk_id, rank FROM bm25),
ca AS (SELECT query_id, [min(chunk_id), 'nowhere', max(chunk_id), min(chunk_id)] AS ids FROM ret GROUP BY query_id)"""


def cited(spark, sf_dir):
    got = stored(lexical(spark, sf_dir).select("query_id", F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id")), "retrieved")  # ten rows a question, read several times
    lo, hi = F.min("chunk_id"), F.max("chunk_id")
    mark = lambda c: F.concat(F.lit("[[chunk:"), c, F.lit("]]"))
    answer = F.concat(F.lit("a "), mark(lo), F.lit(" b "), mark(F.lit("nowhere")), F.lit(" c "), mark(hi), F.lit(" d "), mark(lo))
    return got.groupBy("query_id").agg(answer.alias("answer")), got


@registry.add(f"WITH {CITED_SQL} SELECT query_id, unnest(CASE WHEN ids[1] = ids[3] THEN [ids[1]] ELSE [ids[1], ids[3]] END) AS chunk_id, unnest(CASE WHEN ids[1] = ids[3] THEN [1] ELSE [1, 2] END)::INT AS footnote FROM ca")
def chunk_citations(spark, sf_dir):
    given, got = cited(spark, sf_dir)
    return A.chunk_citations(given, got, ["query_id"]).select("query_id", "chunk_id", "footnote")


@registry.add(f"""WITH {CITED_SQL} SELECT query_id, 'a [1] b  c [' || CASE WHEN ids[1] = ids[3] THEN 1 ELSE 2 END || '] d [1]' || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] ' || ids[1] || CASE WHEN ids[1] = ids[3] THEN '' ELSE chr(10) || '[2] ' || ids[3] END AS rendered FROM ca""")
def footnotes(spark, sf_dir):
    given, got = cited(spark, sf_dir)
    ids = A.chunk_citations(given, got, ["query_id"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("footnote", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return given.join(ids, "query_id").select("query_id", A.render_footnotes(F.col("answer"), F.col("ids")).alias("rendered"))


@registry.add(f"""WITH {CITED_SQL}, c AS (SELECT query_id, unnest(list_distinct(ids)) AS cite FROM ca), codes AS (SELECT 'nowhere' AS code) 
SELECT query_id, cite FROM c WHERE cite IN (SELECT code FROM codes WHERE query_id % 2 = 0) OR EXISTS (SELECT 1 FROM ret r WHERE r.query_id = c.query_id AND r.chunk_id = c.cite)""")
def evidence_check(spark, sf_dir):
    """A citation stays if it names a retrieved chunk or a known failure code (here one code, for even questions)."""
    given, got = cited(spark, sf_dir)
    cites = given.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(A.CHUNK_MARKER), F.lit(1)))).alias("cite"))
    by_chunk = cites.join(got.withColumnRenamed("chunk_id", "cite"), ["query_id", "cite"], "left_semi")
    codes = given.where("query_id % 2 = 0").select("query_id", F.lit("nowhere").alias("cite"))
    return by_chunk.unionByName(cites.join(codes, ["query_id", "cite"], "left_semi")).distinct()


GOLD_SQL = f"""{BM25_SQL % 10}, gold AS (SELECT b.item_id AS query_id, b.item_id % 4 AS category, CAST(min(d.doc_id) AS VARCHAR) AS source, list(CAST(d.doc_id AS VARCHAR)) AS alternates FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
hits AS (SELECT r.query_id, min(r.rank) AS first_rank FROM bm25 r JOIN gold g ON g.query_id = r.query_id AND ((CAST(r.doc_id AS VARCHAR) = g.source AND r.chunk_index <= 1) OR list_contains(g.alternates, CAST(r.doc_id AS VARCHAR))) GROUP BY r.query_id),
ev AS (SELECT g.query_id, g.category, first_rank FROM gold g LEFT JOIN hits h USING (query_id))"""


#: Odd factors of the words of a run.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def run_hashes(text: bytes, n: int) -> np.ndarray:
    """Hashes of each ``n`` words in a row, by shifted copies of the words' checksums: linear in the text. Equal runs have equal hashes."""
    words = text.split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    size = max(len(one) - (n - 1), 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += one[k : k + size] * FACTORS[k]
    return out.view(np.int64)


def byte_runs(text: bytes, n: int) -> np.ndarray:
    """Each ``n`` bytes in a row, eight at most, as one number: equal bytes and no others have equal numbers. Of no bytes there is one zero."""
    one = np.frombuffer(text, np.uint8)
    size = max(len(one) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | one[k : k + size]
    return out.view(np.int64)


def word_runs(rows, n: int, hashes=run_hashes):
    """``rows``, whose last column is a text, with the distinct ``hashes`` of its runs of ``n`` words (or bytes) in the text's place; no shuffle."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [np.unique(hashes(t or b"", n)) for t in batch.column(batch.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], runs], [*batch.schema.names[:-1], "runs"])

    *kept, text = rows.columns
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("runs array<long>").fields])
    return rows.select(*kept, F.col(text).cast("binary")).mapInArrow(run, schema)


def golden(spark, sf_dir):
    """Questions with their category, and their golden sources as rows: the documents that contain the passage, found by shared runs and checked on whole texts.

    A document with the passage has the passage's inner words in a row (the outer ones may be parts of longer words), so a run of the
    first six of them, or of all if there are fewer, names every document that can have it. Passages of up to two words have no inner
    one: a run of their first eight bytes, or of all if there are fewer, stands for it. An empty passage is in every text. Only runs that a
    passage asks for go on, and texts are joined back for hits alone.
    """
    items = read(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    inner = F.greatest(F.size(X.words(F.col("passage"))) - 2, F.lit(0))
    items = items.withColumn("inner", F.slice(X.words(F.col("passage")), F.lit(2), inner))
    items = items.withColumn("by_word", F.size("inner") > 0)
    items = items.withColumn("length", F.when(F.col("by_word"), F.least(F.lit(6), F.size("inner"))).otherwise(F.least(F.lit(8), F.octet_length("passage"))))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select(F.lit(None).cast("long").alias("query_id"), "doc_id", F.lit(None).cast("string").alias("passage")).limit(0)
    for by_word, n in sorted(tuple(r) for r in items.select("by_word", "length").distinct().collect()):  # fifteen at most
        own = items.where((F.col("by_word") == by_word) & (F.col("length") == n))
        probe = F.array_join(F.slice("inner", 1, n), " ") if by_word else F.substring(F.col("passage").cast("binary"), 1, n)
        hashes = run_hashes if by_word else byte_runs
        asked = word_runs(own.select("query_id", "passage", probe.alias("text")), n, hashes).select("query_id", "passage", F.get("runs", 0).alias("probe"))
        runs = word_runs(docs, n, hashes).select("doc_id", F.explode("runs").alias("probe"))
        found = found.unionByName(runs.join(asked, "probe").select("query_id", "doc_id", "passage"))
    found = stored(found, "candidates")  # few: its size is known, so that the texts stay where they are
    checked = cut(found.join(docs, "doc_id").where(F.col("text").contains(F.col("passage"))).select("query_id", F.col("doc_id"))).distinct()
    main = checked.groupBy("query_id").agg(F.min("doc_id").cast("string").alias("slug")).select("query_id", "slug", F.lit(0).alias("golden_page"), F.lit(True).alias("main"))
    other = checked.select("query_id", F.col("doc_id").cast("string").alias("slug"), F.lit(None).cast("int").alias("golden_page"), F.lit(False).alias("main"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).distinct()
    return asked.select("query_id", (F.col("query_id") % 4).alias("category")), main.unionByName(other)


def evaluated(spark, sf_dir):
    items, names = golden(spark, sf_dir)
    ranked = lexical(spark, sf_dir).select("query_id", "rank", F.col("doc_id").cast("string").alias("document"), F.concat(F.lit("doc "), "doc_id").alias("title_stem"), F.col("chunk_index").alias("page"))
    return E.first_hit_ranks(items, E.golden_hits(names, ranked)).withColumn("category", F.col("query_id") % 4)


@registry.add(f"WITH {GOLD_SQL} SELECT * FROM ev")
def first_golden_hit(spark, sf_dir):
    return evaluated(spark, sf_dir).select("query_id", "category", "first_rank")


@registry.add(f"WITH {GOLD_SQL} SELECT count(*) AS n, round(avg((first_rank IS NOT NULL)::INT), 4) AS recall, round(avg(coalesce(1 / first_rank, 0)), 4) AS mrr, round(avg(coalesce(1 / log2(first_rank + 1), 0)), 4) AS ndcg, round(avg((first_rank IS NULL)::INT), 4) <= 0.15 AS passed FROM ev")
def retrieval_metrics(spark, sf_dir):
    r = F.col("first_rank")
    return evaluated(spark, sf_dir).agg(F.count("*").alias("n"), E.share(r.isNotNull()).alias("recall"), E.mrr(r).alias("mrr"), E.ndcg(r).alias("ndcg"), E.gate(E.share(r.isNull())).alias("passed"))


@registry.add(f"WITH {GOLD_SQL} SELECT category, count(*) AS total, count(first_rank) AS hits FROM ev GROUP BY category")
def recall_by_category(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("category").agg(F.count("*").alias("total"), F.count("first_rank").alias("hits"))


@registry.add(f"WITH {RERANK_SQL} SELECT query_id, round(avg((rerank_score >= 0.3)::INT), 4) AS precision FROM fin GROUP BY query_id")
def context_precision(spark, sf_dir):
    """Relevance by the judge that needs no model: share of the question's terms in the chunk."""
    rows = reranked(spark, sf_dir).select("query_id", (F.col("rerank_score") >= 0.3).alias("relevant"))
    return E.context_precision(rows, questions(spark, sf_dir))


@registry.add("""SELECT doc_id, lower(trim(regexp_replace(regexp_replace('/plant/' || source || '/Report No.' || doc_id || '.final.PDF', '^.*/', ''), '\\.[^.]*$', ''))) AS stem FROM documents""")
def title_stems(spark, sf_dir):
    name = F.concat(F.lit("/plant/"), "source", F.lit("/Report No."), "doc_id", F.lit(".final.PDF"))
    return read(spark, sf_dir, "documents").select("doc_id", X.title_stem(name).alias("stem"))


@registry.add("""SELECT conv_id, turn, starts_with(lower(regexp_replace(CASE turn % 3 WHEN 0 THEN '**Yes** - ' WHEN 1 THEN '# no, yes' ELSE '- yes ' END || text, '^[*_\\-#\\s]+', '')), 'yes') AS yes FROM conversations""")
def judge_answers(spark, sf_dir):
    t = F.col("turn") % 3
    return read(spark, sf_dir, "conversations").select(*KEYS, X.says_yes(F.concat(F.when(t == 0, "**Yes** - ").when(t == 1, "# no, yes").otherwise("- yes "), "text")).alias("yes"))


ITEMS_SQL = """it AS (SELECT event_id, 'P-' || user_id AS source_tag, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'CMP-' || event_id END AS target_tag, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value / 50 - 0.5, 3) END AS confidence FROM events)"""


def relation_answers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    target = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("CMP-"), "event_id"))
    conf = F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 50 - 0.5, 3))
    item = F.to_json(F.array(F.struct(F.concat(F.lit("P-"), "user_id").alias("source_tag"), F.lit("Equipment").alias("source_type"), F.lit("IS_PART_OF").alias("relation_type"), target.alias("target_tag"), F.lit("Equipment").alias("target_type"), conf.alias("confidence"))))
    k = F.col("event_id") % 4
    answer = F.when(k == 0, item).when(k == 1, F.concat(F.lit("Here you are: "), item, F.lit(" - done [see 3] ]["))).when(k == 2, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).otherwise(F.when(F.col("event_id") % 8 == 3, "sorry, nothing").otherwise(item))
    return e.select("event_id", answer.alias("answer"))


@registry.add(f"""WITH {ITEMS_SQL} SELECT event_id, source_tag, target_tag, least(greatest(coalesce(confidence, 1.0), 0.0), 1.0) AS confidence, least(greatest(coalesce(confidence, 1.0), 0.0), 1.0) < 0.6 AS tentative FROM it WHERE target_tag IS NOT NULL AND event_id % 8 <> 3""")
def relation_items(spark, sf_dir):
    return A.relation_items(relation_answers(spark, sf_dir), ["event_id"]).select("event_id", "source_tag", "target_tag", "confidence", "tentative")


GAPS_SQL = """gp AS (SELECT event_id, user_id AS report, 'clause ' || user_id AS clause, event_type AS description, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'MAJOR' WHEN 'view' THEN 'MINOR' ELSE 'LOW' END AS severity FROM events),
kept AS (SELECT * FROM gp WHERE severity <> 'LOW')"""


def gap_answers(spark, sf_dir):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "click", " Major").when(kind == "view", "MINOR").otherwise("LOW")
    item = F.to_json(F.array(F.struct(F.concat(F.lit("clause "), "user_id").alias("clause"), kind.alias("description"), severity.alias("severity"))))
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("report"), F.concat(F.lit("Gaps: "), item).alias("answer"))


@registry.add(f"WITH {GAPS_SQL} SELECT event_id, clause, description, severity FROM kept")
def gap_items(spark, sf_dir):
    return A.gap_items(gap_answers(spark, sf_dir), ["event_id"]).select("event_id", "clause", "description", "severity")


@registry.add(f"WITH {GAPS_SQL} SELECT report, count(*) AS n_gaps, bool_or(severity = 'CRITICAL') AS has_critical_gaps FROM kept GROUP BY report")
def critical_reports(spark, sf_dir):
    gaps = A.gap_items(gap_answers(spark, sf_dir), ["report"])
    return gaps.groupBy("report").agg(F.count("*").alias("n_gaps"), F.bool_or(F.col("severity") == "CRITICAL").alias("has_critical_gaps"))


@registry.add(f"""WITH {GAPS_SQL} SELECT report, md5('| Clause | Severity | Description |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || clause || ' | ' || severity || ' | ' || description || ' |', chr(10) ORDER BY event_id)) AS table_md5 FROM kept GROUP BY report""")
def gap_tables(spark, sf_dir):
    gaps = A.gap_items(gap_answers(spark, sf_dir), ["report", "event_id"])
    return gaps.groupBy("report").agg(F.md5(A.markdown_table(["Clause", "Severity", "Description"], ["clause", "severity", "description"], ["event_id"])).alias("table_md5"))


@registry.add("""SELECT event_id, 'user ' || user_id || ' did ' || event_type || CASE WHEN event_id % 5 = 0 THEN ' {extra}' ELSE '' END AS rendered, CASE WHEN event_id % 5 = 0 THEN 'missing variable: extra' END AS error FROM events""")
def rendered_templates(spark, sf_dir):
    template = F.concat(F.lit("user {user} did {what}"), F.when(F.col("event_id") % 5 == 0, " {extra}").otherwise(""))
    out, error = A.render_template(template, {"user": F.col("user_id").cast("string"), "what": F.col("event_type")})
    return read(spark, sf_dir, "events").select("event_id", out.alias("rendered"), error.alias("error"))


@registry.add("""WITH g AS (SELECT l_orderkey AS order_id, count(*) AS chunks, count(*) FILTER (l_linenumber % 3 = 0) AS failed FROM lineitem GROUP BY ALL)
SELECT order_id, chunks, failed, 4 * (chunks - failed) AS entities, 9 * (chunks - failed) AS relations, round((chunks - failed) / chunks, 4) AS success_rate FROM g""")
def extraction_report(spark, sf_dir):
    """An order's lines as chunks with four tags each and nine allowed relations among these; every third one fails."""
    from .graph import G, tag_texts, typed_pairs

    chunks = tag_texts(spark, sf_dir).withColumn("failed", F.col("line") % 3 == 0)
    done = chunks.where("NOT failed")
    return E.extraction_report(chunks, G.extract_entities(done, ["order_id", "line"]), typed_pairs(done, ["order_id", "line"]), "order_id")


@registry.add("SELECT run, mrr, mrr - lag(mrr) OVER (ORDER BY run) AS delta FROM (SELECT label AS run, round(avg(vec_id), 4) AS mrr FROM embeddings GROUP BY label)")
def run_trend(spark, sf_dir):
    """Labels stand for runs: a run table has one row per run, so one ordered window over it is small."""
    runs = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run")).agg(F.round(F.avg("vec_id"), 4).alias("mrr"))
    return runs.withColumn("delta", F.col("mrr") - F.lag("mrr").over(W.orderBy("run")))


@registry.add("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
j AS (SELECT *, least(greatest((n + 1) * 95 // 100, 1), n - 1) AS j95, least(greatest((n + 1) * 99 // 100, 1), n - 1) AS j99 FROM s)
SELECT event_type, count(*) AS n, round(median(value), 1) AS p50,
 round(sum(CASE WHEN k = j95 THEN value * (100 - ((n + 1) * 95 - j95 * 100)) / 100 WHEN k = j95 + 1 THEN value * ((n + 1) * 95 - j95 * 100) / 100 END), 1) AS p95,
 round(sum(CASE WHEN k = j99 THEN value * (100 - ((n + 1) * 99 - j99 * 100)) / 100 WHEN k = j99 + 1 THEN value * ((n + 1) * 99 - j99 * 100) / 100 END), 1) AS p99,
 round(min(value), 1) AS min, round(max(value), 1) AS max FROM j GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    return E.latency_summary(read(spark, sf_dir, "events"), ["event_type"], "value")


@registry.add("SELECT event_type, median(value) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def group_statistics(spark, sf_dir):
    return E.group_statistics(read(spark, sf_dir, "events"), ["event_type"], "value")


@registry.add(f"WITH {RERANK_SQL} SELECT query_id, doc_id, left(text, 200) AS excerpt, round(rerank_score, 4) AS score FROM fin WHERE final_rank <= 5")
def citation_excerpts(spark, sf_dir):
    return reranked(spark, sf_dir).where("final_rank <= 5").select("query_id", "doc_id", F.substring("text", 1, 200).alias("excerpt"), F.round("rerank_score", 4).alias("score"))
