"""Telemetry over ``events``: batch forms and a streaming run of the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..streaming import jobs as J, sessions as C, telemetry as S
from ..session import shared_root
from ..sources.keyed import KeyedTables
from .base import POSTINGS_SQL, Registry, read
from .graph import lessons, registry as graph_registry, warned
from .operations import JOBS_SQL, NEWEST_SQL, as_jobs

registry = Registry()
warning_sql = graph_registry.sql["proactive_warnings"]
W5 = "time_bucket(INTERVAL 5 MINUTE, ts)"


def shared(spark, name):
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def streamed(spark, sf_dir, name, keys, build):
    """``build`` over the events as a stream that processes what is there and stops; then what its keyed sink holds."""
    root = shared(spark, name)
    J.keyed(build(J.table_stream(spark, f"{sf_dir}/events.parquet")), name, root).awaitTermination()
    rows = J.newest_rows(spark, root, name, keys)
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) if "window_start" in keys else rows


RATES_SQL = f"SELECT {W5} AS window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM events GROUP BY ALL"


@registry.add(RATES_SQL)
def request_rates(spark, sf_dir):
    return S.rates(read(spark, sf_dir, "events"), ["event_type"])


@registry.add(RATES_SQL)
def request_rates_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "rates", ["window_start", "event_type"], lambda e: S.rates(e, ["event_type"]))


@registry.add(f"WITH {JOBS_SQL}, {NEWEST_SQL} SELECT document_id, status, created_at AS since FROM newest")
def newest_status_stream(spark, sf_dir):
    root = shared(spark, "status")
    jobs = as_jobs(J.table_stream(spark, f"{sf_dir}/events.parquet"))
    J.newest_status(jobs, root).awaitTermination()
    return J.newest_rows(spark, root, "newest_status", ["document_id"]).select("document_id", "status", "since")


@registry.add(f"SELECT {W5} AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate FROM events GROUP BY ALL")
def failure_rates(spark, sf_dir):
    return S.failure_rates(read(spark, sf_dir, "events"), F.col("event_type") == "error")


@registry.add(registry.sql["failure_rates"])
def failure_rates_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "failures", ["window_start"], lambda e: S.failure_rates(e, F.col("event_type") == "error"))


def _quantile_sql(q: float) -> str:
    out = f"{S.BUCKETS[-1]}::DOUBLE"
    for k in reversed(range(len(S.BUCKETS))):
        low, below = (S.BUCKETS[k - 1], f"c[{k}]") if k else (0.0, "0")
        out = f"CASE WHEN c[{k + 1}] >= n * {q} THEN {low} + CASE WHEN c[{k + 1}] > {below} THEN (n * {q} - {below}) / (c[{k + 1}] - {below}) ELSE 0 END * ({S.BUCKETS[k]} - {low}) ELSE {out} END"
    return f"round({out}, 6)"


COUNTS_SQL = "[" + ", ".join(f"count(*) FILTER (value / 20 <= {b})" for b in S.BUCKETS) + "]"


QUANTILES_SQL = f"WITH h AS (SELECT {W5} AS window_start, count(*) AS n, {COUNTS_SQL} AS c FROM events GROUP BY ALL) SELECT window_start, n, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95, {_quantile_sql(0.99)} AS p99 FROM h"


def quantiles(events):
    rows = S.bucket_counts(events.withColumn("latency", F.col("value") / 20), "latency")
    return rows.select("window_start", "n", *(S.histogram_quantile(q, F.col("counts"), F.col("n")).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)))


@registry.add(QUANTILES_SQL)
def request_quantiles(spark, sf_dir):
    return quantiles(read(spark, sf_dir, "events"))


@registry.add(QUANTILES_SQL)
def request_quantiles_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "quantiles", ["window_start"], quantiles)


@registry.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tokens_per_hour(spark, sf_dir):
    return S.window_sums(read(spark, sf_dir, "events"), ["event_type"], "value")


@registry.add(registry.sql["tokens_per_hour"])
def tokens_per_hour_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "tokens", ["window_start", "event_type"], lambda e: S.window_sums(e, ["event_type"], "value"))


@registry.add(f"SELECT {W5} AS window_start, event_type = 'error' AS failed, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM events GROUP BY ALL")
def task_rates(spark, sf_dir):
    return S.rates(read(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error"), ["failed"])


@registry.add(registry.sql["task_rates"])
def task_rates_stream(spark, sf_dir):
    return streamed(spark, sf_dir, "tasks", ["window_start", "failed"], lambda e: S.rates(e.withColumn("failed", F.col("event_type") == "error"), ["failed"]))


@registry.add("SELECT event_id, user_id, (sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS open FROM events")
def open_connections(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return S.open_now(read(spark, sf_dir, "events"), step, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "open")


@registry.add("SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)::BIGINT AS open FROM events GROUP BY user_id")
def open_connections_stream(spark, sf_dir):
    """Openings minus closings of each user, as a running sum in the stream's state."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return streamed(spark, sf_dir, "open", ["user_id"], lambda e: e.groupBy("user_id").agg(F.sum(step).alias("open")))


@registry.add("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, k""")
def chat_sessions(spark, sf_dir):
    return S.sessions(read(spark, sf_dir, "events"), ["user_id"])


SESSIONS_SQL = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)"""


@registry.add(f"""WITH {SESSIONS_SQL} SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS expires, count(*) AS n, md5(array_to_string(list(event_id ORDER BY ts, event_id)[-20:], ',')) AS messages_md5 FROM s GROUP BY user_id, k""")
def chat_sessions_stream(spark, sf_dir):
    """Sessions with their last twenty messages, kept as state with a timer that each turn renews."""
    root = shared(spark, "sessions")
    C.chat_sessions(J.table_stream(spark, f"{sf_dir}/events.parquet"), root, "user_id", "ts", "event_id").awaitTermination()
    rows = spark.read.parquet(f"{root}/sessions").groupBy("session", "session_start").agg(F.max_by(F.struct("expires", "n", "messages"), F.struct("batch", "n")).alias("r"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return rows.select(F.col("session").alias("user_id"), time("session_start").alias("session_start"), time("r.expires").alias("expires"), "r.n", F.md5(F.array_join(F.col("r.messages").cast("array<string>"), ",")).alias("messages_md5"))


@registry.add("""WITH RECURSIVE q AS (SELECT sha256('do ' || event_type || '|' || user_id % 7 || '|' || 10) AS request, ts, event_id FROM events), firsts AS (SELECT request, min(ts) AS ts FROM q GROUP BY request),
w AS (SELECT request, ts FROM firsts UNION ALL SELECT w.request, (SELECT min(q.ts) FROM q WHERE q.request = w.request AND q.ts >= w.ts + INTERVAL 300 SECOND) FROM w WHERE w.ts IS NOT NULL)
SELECT w.request, w.ts, min(q.event_id) AS event_id FROM w JOIN q ON q.request = w.request AND q.ts = w.ts GROUP BY ALL""")
def unrepeated_questions_stream(spark, sf_dir):
    """Questions by their request key; one within 300 seconds of the same that passed is held back."""
    root = shared(spark, "passed")
    stream = J.table_stream(spark, f"{sf_dir}/events.parquet")
    asked = stream.withColumn("request", X.request_key(F.concat(F.lit("do "), "event_type"), (F.col("user_id") % 7).cast("string"), F.lit(10)))
    C.without_repeats(asked, root, "request", "ts", "event_id").awaitTermination()
    return spark.read.parquet(f"{root}/passed").select("request", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"))


@registry.add("SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'completion' END AS kind, sum(user_id)::BIGINT AS tokens FROM events GROUP BY ALL")
def token_usage(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, "prompt").otherwise("completion").alias("kind")).agg(F.sum("user_id").alias("tokens"))


@registry.add(f"WITH {POSTINGS_SQL}, n AS (SELECT doc_id, chunk_index, count(*) AS n_terms FROM postings GROUP BY ALL) SELECT c.doc_id, c.chunk_index, md5(c.text) AS text_md5, c.token_count, coalesce(n_terms, 0) AS n_terms FROM chunks c LEFT JOIN n USING (doc_id, chunk_index)")
def ingest_stream(spark, sf_dir):
    """Documents stream into chunks and postings."""
    root = shared(spark, "ingest")
    J.ingest(J.table_stream(spark, f"{sf_dir}/documents.parquet"), root).awaitTermination()
    return ingested(spark, root)


def ingested(spark, root):
    chunk = ["doc_id", "version", "chunk_index"]
    terms = J.current(spark, root, "postings", lists=True).select(*chunk, F.size("counts").cast("long").alias("n_terms"))
    met = J.current(spark, root).select(*chunk, F.md5("text").alias("text_md5"), "token_count").join(terms, chunk, "left")  # texts stay where they are
    return met.select("doc_id", "chunk_index", "text_md5", "token_count", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


CHANGED_SQL = f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN ' ' WHEN doc_id % 10 = 0 THEN 'tested again: ' || text ELSE text END AS text FROM documents), {POSTINGS_SQL.replace('FROM documents', 'FROM changed')}, n AS (SELECT doc_id, chunk_index, count(*) AS n_terms FROM postings GROUP BY ALL)
SELECT c.doc_id, c.chunk_index, md5(c.text) AS text_md5, c.token_count, coalesce(n_terms, 0) AS n_terms FROM chunks c LEFT JOIN n USING (doc_id, chunk_index)"""


def change_every_tenth(spark, sf_dir, root):
    """All documents in one batch; in a second one every tenth with another text and every 25th without any, given twice."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("version"))
    text = F.when(F.col("doc_id") % 25 == 0, " ").otherwise(F.concat(F.lit("tested again: "), "text"))
    tables = KeyedTables(spark, root, "doc_id")
    for number, own in ((0, docs), (1, docs.where("doc_id % 10 = 0 OR doc_id % 25 = 0").withColumn("text", text)), (1, docs.limit(0))):
        if tables.manifest()["done"].get("load", -1) < number:
            batch = tables.batch()
            J.described(batch, own, ["doc_id", "version"], number)
            tables.commit(batch, own, "load", number)
    return tables


@registry.add(CHANGED_SQL)
def keyed_replacement(spark, sf_dir):
    """Chunks and postings on disk: a small batch replaces its documents, all others stay."""
    return ingested(spark, change_every_tenth(spark, sf_dir, shared(spark, "keyed")).root)


@registry.add(CHANGED_SQL)
def compacted_replacement(spark, sf_dir):
    """The same after compaction, with old batches cleared."""
    tables = change_every_tenth(spark, sf_dir, shared(spark, "compacted"))
    tables.compact()
    tables.clear()
    return ingested(spark, tables.root)


TAGGED_SQL = POSTINGS_SQL.replace("FROM documents", "FROM tagged")


@registry.add(rf"""WITH tagged AS (SELECT doc_id, CASE WHEN trim(text) <> '' THEN 'P-' || doc_id % 50 || ' and FT-7: ' || text END AS text FROM documents), {TAGGED_SQL},
dims AS (SELECT doc_id, chunk_index, (('0x' || substr(md5(term), 1, 7))::BIGINT % 64) AS dimension, tf FROM postings),
found AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(text, '\b(?:[A-Z]{{1,4}}-\d+[A-Z]?|[A-Z]{{1,4}}\d{{3,}}[A-Z]?)\b')) AS tag FROM chunks),
ids AS (SELECT doc_id, chunk_index, sha256(doc_id || ':' || chunk_index) AS chunk_id FROM chunks),
rows AS (SELECT 'chunks' AS stage, doc_id, md5(chunk_index || text) AS row_md5 FROM chunks UNION ALL SELECT 'postings', doc_id, md5(chunk_index || term) FROM postings
UNION ALL SELECT 'vectors', doc_id, md5(chunk_index || ':' || dimension) FROM (SELECT DISTINCT doc_id, chunk_index, dimension FROM dims) UNION ALL SELECT 'entities', doc_id, md5(chunk_index || tag) FROM found
UNION ALL SELECT 'edges', doc_id, md5(doc_id || chunk_id) FROM ids UNION ALL SELECT 'edges', doc_id, md5(chunk_id || tag) FROM (SELECT DISTINCT doc_id, chunk_index, tag FROM found) JOIN ids USING (doc_id, chunk_index))
SELECT stage, doc_id, count(*) AS n, min(row_md5) AS first_md5, max(row_md5) AS last_md5, 0 AS batch_number FROM rows GROUP BY ALL""")
def ingest_chain_stream(spark, sf_dir):
    """The whole chain of one stream, table by table: rows of each document with their batch's number, which is one over all tables."""
    root = shared(spark, "chain")
    tagged = F.when(F.trim("text") != "", F.concat(F.lit("P-"), F.col("doc_id") % 50, F.lit(" and FT-7: "), "text"))
    stream = J.table_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", tagged.alias("text"))
    J.ingest(stream, root).awaitTermination()
    row = lambda *own: F.md5(F.concat(*own))
    tell = {
        "chunks": F.array(row("chunk_index", "text")), "entities": F.array(row("chunk_index", "tag")), "edges": F.array(row("src", "dst")),
        "postings": F.transform(R.split_terms(), lambda term: row("chunk_index", term)),
        "vectors": F.filter(F.transform("weights", lambda w, k: F.when(w.isNotNull(), row("chunk_index", F.lit(":"), k))), lambda x: x.isNotNull()),
    }
    parts = []
    for name, rows in tell.items():
        own = J.current(spark, root, name, lists=True).select("doc_id", "batch_number", rows.alias("_r"))
        own = own.select("doc_id", "batch_number", F.size("_r").alias("n"), F.array_min("_r").alias("first_md5"), F.array_max("_r").alias("last_md5"))
        own = own.groupBy("doc_id", "batch_number").agg(F.sum("n").alias("n"), F.min("first_md5").alias("first_md5"), F.max("last_md5").alias("last_md5"))
        parts.append(own.select(F.lit(name).alias("stage"), *own.columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


@registry.add(warning_sql)
def proactive_warnings_stream(spark, sf_dir):
    """Incidents stream in; each batch searches the standing lessons."""
    root = shared(spark, "warnings")
    vectors = read(spark, sf_dir, "embeddings")
    incidents = J.table_stream(spark, f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    J.warnings(incidents, lessons(spark, sf_dir), lambda rows, known: warned(rows, vectors, known), root).awaitTermination()
    return spark.read.parquet(f"{root}/warnings").drop("batch")
