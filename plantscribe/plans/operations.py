"""Work orders, jobs, versions and lists over ``orders``, ``part``, ``events``, ``conversations`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import answers as A, relational as O
from ..session import shared_root
from ..sources import tables as T
from .base import Registry, read, sql_list

registry = Registry()

WO_SQL = """wo AS (SELECT 'WO-' || o_orderkey AS wo_id, 'P-' || o_custkey AS asset_tag, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status,
 o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS scheduled_date, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 30 END AS completed_date FROM orders)"""


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.lit("WO-"), F.col("o_orderkey")).alias("wo_id"), F.concat(F.lit("P-"), F.col("o_custkey")).alias("asset_tag"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("COMPLETED").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, day).alias("scheduled_date"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 30)).alias("completed_date"),
    )


JOBS_SQL = """jobs AS (SELECT event_id AS job_id, user_id AS document_id, ts AS created_at, CASE event_type WHEN 'click' THEN 'PARSING' WHEN 'view' THEN 'EXTRACTING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'QUEUED' ELSE 'FAILED' END AS status FROM events)"""


def as_jobs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "click", "PARSING").when(kind == "view", "EXTRACTING").when(kind == "purchase", "COMPLETED").when(kind == "signup", "QUEUED").otherwise("FAILED")
    return events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), status.alias("status"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_jobs(read(spark, sf_dir, "events"))


NEWEST_SQL = "newest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) WHERE r = 1)"


def newest_jobs(spark, sf_dir):
    return O.latest(job_events(spark, sf_dir), ["document_id"], [F.desc("created_at"), F.desc("job_id")])


PROGRESS_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.JOB_PROGRESS.items()) + " ELSE 0 END"


@registry.add(f"WITH {JOBS_SQL}, {NEWEST_SQL} SELECT document_id, job_id, status, ({PROGRESS_SQL})::INT AS progress FROM newest")
def latest_job_status(spark, sf_dir):
    return newest_jobs(spark, sf_dir).select("document_id", "job_id", "status", O.progress(F.col("status")).alias("progress"))


@registry.add(f"WITH {JOBS_SQL}, {NEWEST_SQL} SELECT d.doc_id, n.status FROM documents d LEFT JOIN newest n ON n.document_id = d.doc_id")
def documents_with_status(spark, sf_dir):
    jobs = newest_jobs(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "status")
    return read(spark, sf_dir, "documents").select("doc_id").join(jobs, "doc_id", "left")


@registry.add(f"WITH {JOBS_SQL}, {NEWEST_SQL} SELECT count(*) FILTER (status = 'COMPLETED') AS done, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED')) AS processing FROM newest")
def status_counters(spark, sf_dir):
    s = F.col("status")
    return newest_jobs(spark, sf_dir).agg(F.count_if(s == "COMPLETED").alias("done"), F.count_if(s == "FAILED").alias("failed"), F.count_if(~s.isin("COMPLETED", "FAILED")).alias("processing"))


@registry.add(f"WITH {JOBS_SQL}, {NEWEST_SQL} SELECT document_id, 'QUEUED' AS status, job_id AS retry_of FROM newest WHERE status = 'FAILED'")
def retry_jobs(spark, sf_dir):
    return O.retryable(job_events(spark, sf_dir))


@registry.add(f"WITH {WO_SQL} SELECT wo_id, asset_tag, priority, scheduled_date, row_number() OVER (PARTITION BY asset_tag ORDER BY scheduled_date ASC NULLS LAST, wo_id)::INT AS position FROM wo WHERE status IN ('OPEN', 'IN_PROGRESS')")
def open_work_orders(spark, sf_dir):
    return O.work_orders_of(work_orders(spark, sf_dir), open_only=True).select("wo_id", "asset_tag", "priority", "scheduled_date", "position")


@registry.add(f"WITH {WO_SQL} SELECT wo_id, asset_tag, status, row_number() OVER (PARTITION BY asset_tag ORDER BY scheduled_date ASC NULLS LAST, wo_id)::INT AS position FROM wo")
def asset_work_orders(spark, sf_dir):
    return O.work_orders_of(work_orders(spark, sf_dir)).select("wo_id", "asset_tag", "status", "position")


@registry.add(f"WITH {WO_SQL} SELECT * FROM wo WHERE wo_id = 'WO-7'")
def work_order_by_id(spark, sf_dir):
    return work_orders(spark, sf_dir).where("wo_id = 'WO-7'")


@registry.add(f"""WITH {WO_SQL}, q AS (SELECT event_id AS question_id, CASE WHEN event_id % 2 = 0 THEN 'what about wo-' || event_id ELSE 'open orders of P-' || user_id END AS question FROM events)
SELECT question_id, wo_id, 'by_id' AS found FROM q JOIN wo ON wo_id = upper(nullif(regexp_extract(question, '(?i)\\bWO-\\d+\\b'), ''))
UNION ALL SELECT question_id, wo_id, 'by_asset' FROM q JOIN wo ON asset_tag = nullif(regexp_extract(question, '\\b(?:[A-Z]{{1,4}}-\\d+[A-Z]?|[A-Z]{{1,4}}\\d{{3,}}[A-Z]?)\\b'), '') WHERE NOT regexp_matches(question, '(?i)\\bWO-\\d+\\b') AND status IN ('OPEN', 'IN_PROGRESS')""")
def work_order_lookup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    question = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("what about wo-"), F.col("event_id"))).otherwise(F.concat(F.lit("open orders of P-"), F.col("user_id")))
    return O.work_order_lookup(e.select(F.col("event_id").alias("question_id"), question.alias("question")), work_orders(spark, sf_dir))


@registry.add(f"WITH {WO_SQL} SELECT '- ' || wo_id || ' [' || status || '/' || priority || '] scheduled ' || coalesce(strftime(scheduled_date, '%Y-%m-%d'), 'unscheduled') AS line FROM wo")
def work_order_lines(spark, sf_dir):
    return O.work_order_lines(work_orders(spark, sf_dir))


KEYWORDS_SQL = rf"list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9\-]+'), lambda x: length(x) > 2 AND NOT list_contains({sql_list(X.KEYWORD_STOP_WORDS)}, x))"
FIRST6_SQL = f"list_transform(list_sort(list_transform(list_distinct({KEYWORDS_SQL}), lambda k: {{'p': list_position({KEYWORDS_SQL}, k), 'k': k}}))[1:6], lambda s: s.k)"


@registry.add(f"SELECT item_id AS incident_id, {FIRST6_SQL} AS keywords FROM benchmark")
def incident_keywords(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("incident_id"), X.keywords(F.col("text")).alias("keywords"))


@registry.add(f"""WITH k AS (SELECT item_id AS incident_id, unnest({FIRST6_SQL}) AS kw FROM benchmark),
h AS (SELECT conv_id * 100 + turn AS wo_id, text AS description, DATE '2024-01-01' + conv_id::INT AS completed_date FROM conversations),
m AS (SELECT DISTINCT incident_id, wo_id, completed_date FROM k JOIN h ON contains(lower(description), kw))
SELECT incident_id, wo_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY completed_date DESC NULLS LAST, wo_id)::INT AS rank FROM m) WHERE rank <= 5""")
def incident_keyword_search(spark, sf_dir):
    incidents = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("incident_id"), "text")
    history = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("wo_id"), F.col("text").alias("description"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")).alias("completed_date"))
    return O.keyword_search(incidents, history).select("incident_id", "wo_id", "rank")


@registry.add("SELECT item_id AS incident_id, c AS category, sha256(text || ' ' || c) AS query_key FROM benchmark, unnest(['Equipment', 'Method', 'Material', 'Man', 'Environment', 'Measurement']) AS u(c)")
def cause_fan_out(spark, sf_dir):
    return O.fan_out(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("incident_id"), "text")).select("incident_id", "category", F.sha2("query_text", 256).alias("query_key"))


@registry.add("SELECT doc_id, source, (SELECT count(*) FROM documents WHERE doc_id % 11 <> 0 AND lang = 'de') AS total FROM documents WHERE doc_id % 11 <> 0 AND lang = 'de' ORDER BY doc_id DESC OFFSET 10 LIMIT 25")
def document_page(spark, sf_dir):
    """A list page is a limit by nature: not deleted (every 11th is), one status, newest first."""
    kept = read(spark, sf_dir, "documents").where("doc_id % 11 <> 0 AND lang = 'de'").select("doc_id", "source")
    return O.page(kept, [F.desc("doc_id")], 10, 25)


@registry.add("SELECT page_id, url FROM pages WHERE contains(lower(url), lower('Item'))  OR contains(lower(url), '1')")
def name_search(spark, sf_dir):
    url = F.lower("url")
    return read(spark, sf_dir, "pages").where(url.contains("item") | url.contains("1")).select("page_id", "url")


@registry.add("SELECT doc_id, doc_id % 11 = 0 AND doc_id % 22 <> 0 AS is_deleted FROM documents")
def soft_delete_restore(spark, sf_dir):
    """Every 11th document is deleted, every 22nd restored: keyed changes to a flag, applied in order."""
    base = read(spark, sf_dir, "documents").select("doc_id", F.lit(False).alias("is_deleted"))
    deleted = O.upsert(base, base.where("doc_id % 11 = 0").withColumn("is_deleted", F.lit(True)), ["doc_id"])
    return O.upsert(deleted, deleted.where("doc_id % 22 = 0").withColumn("is_deleted", F.lit(False)), ["doc_id"])


@registry.add("SELECT session, conv_id, turn, role, row_number() OVER (PARTITION BY session ORDER BY conv_id, turn)::INT AS position FROM (SELECT *, conv_id % 7 AS session, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 20")
def chat_history(spark, sf_dir):
    """The last 20 messages of each session, oldest first; conversations in seven sessions, as none has 20 turns."""
    rows = read(spark, sf_dir, "conversations").withColumn("session", F.col("conv_id") % 7)
    return O.last_messages(rows, ["session"], ["conv_id", "turn"]).select("session", "conv_id", "turn", "role", "position")


RUNS_SQL = "runs AS (SELECT label AS run, count(*) AS items, round(avg(vec_id), 4) AS mrr FROM embeddings GROUP BY label)"


@registry.add(f"WITH {RUNS_SQL} SELECT run, items, mrr FROM runs ORDER BY run DESC LIMIT 3")
def newest_runs(spark, sf_dir):
    """Evaluation runs are appended one by one; the newest three come back."""
    path = f"{shared_root(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    runs = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run")).agg(F.count("*").alias("items"), F.round(F.avg("vec_id"), 4).alias("mrr"))
    T.append(runs.where("run % 2 = 0"), path)
    T.append(runs.where("run % 2 = 1"), path)
    return T.newest(spark, path, "run", 3)


@registry.add("WITH r AS (SELECT user_id AS session, count(*) AS gaps, bool_or(event_type = 'error') AS has_critical_gaps FROM events GROUP BY user_id) SELECT session, gaps, has_critical_gaps FROM r")
def compliance_reports(spark, sf_dir):
    """Reports are appended with their flag and body and read back."""
    path = f"{shared_root(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    T.append(T.compliance_report(read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("gaps"), F.bool_or(F.col("event_type") == "error").alias("has_critical_gaps"))), path)
    return spark.read.parquet(path).select("session", F.get_json_object("report", "$.gaps").cast("long").alias("gaps"), "has_critical_gaps")


@registry.add("SELECT conv_id, turn AS newest, text AS newest_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def newest_version(spark, sf_dir):
    """Turns stand for versions of a document."""
    return O.latest(read(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", F.col("turn").alias("newest"), F.col("text").alias("newest_text"))


@registry.add("SELECT conv_id, turn, text FROM conversations WHERE turn = 2")
def chosen_version(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("turn = 2").select("conv_id", "turn", "text")


@registry.add("""SELECT d.doc_id, coalesce(list_sort(list(c.turn) FILTER (c.turn IS NOT NULL)), []) AS versions, any_value(l.quality) AS quality FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def documents_with_versions(spark, sf_dir):
    versions = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list("turn")).alias("versions"))
    out = read(spark, sf_dir, "documents").select("doc_id").join(versions, "doc_id", "left").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.withColumn("versions", F.coalesce("versions", F.array().cast("array<bigint>")))


@registry.add("SELECT user_id AS doc_id, max_by(props, event_id) AS metadata, min(ts) AS created_at FROM events GROUP BY user_id")
def metadata_upsert(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("props", "event_id").alias("metadata"), F.min("ts").alias("created_at"))


@registry.add("""WITH b AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS summary FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, source || '-new' AS source, 'new' AS summary FROM documents WHERE doc_id % 5 < 3)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, coalesce(n.source, b.source) AS source, coalesce(b.summary, n.summary) AS summary FROM b FULL JOIN n ON b.doc_id = n.doc_id""")
def lesson_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    base = d.where("doc_id % 2 = 0").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "old").alias("summary"))
    new = d.where("doc_id % 5 < 3").select("doc_id", F.concat("source", F.lit("-new")).alias("source"), F.lit("new").alias("summary"))
    return O.coalesce_merge(base, new, "doc_id", ["summary"])


@registry.add(f"WITH {WO_SQL}, c AS (SELECT wo_id, asset_tag, 'CLOSED' AS status, priority, scheduled_date, completed_date FROM wo WHERE priority = '1-URGENT') SELECT * FROM wo WHERE wo_id NOT IN (SELECT wo_id FROM c) UNION ALL SELECT * FROM c")
def work_order_upsert(spark, sf_dir):
    wo = work_orders(spark, sf_dir)
    return O.upsert(wo, wo.where("priority = '1-URGENT'").withColumn("status", F.lit("CLOSED")), ["wo_id"])


@registry.add("""WITH a AS (SELECT conv_id AS session_id, turn, role, CASE WHEN turn % 3 = 0 THEN '' WHEN trim(text, ' ') = '' THEN '' ELSE text END AS answer FROM conversations)
SELECT session_id, count(*) FILTER (answer <> '') AS answered, count(*) FILTER (answer <> '') >= 5 AS complete, md5(string_agg(turn || '. ' || role || ': ' || CASE WHEN answer = '' THEN '(awaiting answer)' ELSE answer END, chr(10) ORDER BY turn)) AS chain_md5 FROM a GROUP BY session_id""")
def why_chain(spark, sf_dir):
    """Every third answer is still awaited."""
    steps = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("answer"))
    return A.why_chain(steps, "session_id", "turn", "role", "answer").select("session_id", "answered", "complete", F.md5("chain").alias("chain_md5"))


@registry.add("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang END AS filter_lang, lang NOT IN ('en', 'de') AS bad_filter FROM documents")
def status_filter_check(spark, sf_dir):
    ok = F.col("lang").isin("en", "de")
    return read(spark, sf_dir, "documents").select("doc_id", F.when(ok, F.col("lang")).alias("filter_lang"), (~ok).alias("bad_filter"))


@registry.add("SELECT event_id, try_cast(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE 'n/a' END, '') AS DATE) AS day FROM events")
def lenient_dates(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("n/a")
    return read(spark, sf_dir, "events").select("event_id", F.try_to_date(F.nullif(raw, F.lit(""))).alias("day") if hasattr(F, "try_to_date") else raw.try_cast("date").alias("day"))
