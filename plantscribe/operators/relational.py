"""Keyed upserts, latest rows, lookups and work-order operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

# Progress percent by job status.
JOB_PROGRESS = {"QUEUED": 5, "EXTRACTING": 20, "EXTRACTED": 40, "PARSING": 55, "CHUNKED": 70, "EMBEDDING": 85, "INDEXED": 90, "KG_EXTRACTING": 93, "KG_POPULATED": 97, "COMPLETED": 100, "FAILED": 0}
# Statuses of open work orders, and the categories of causes in order.
OPEN_STATUSES = ("OPEN", "IN_PROGRESS")
CAUSE_CATEGORIES = ("Equipment", "Method", "Material", "Man", "Environment", "Measurement")


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in that order; ``row_number`` is pre-limited before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same keys; the rest stays."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_by(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert of everything under the keys that ``new`` has."""
    return upsert(base, new, [key])


def merge_overlay(rows: DataFrame, keys: list[str], properties: str, order: str) -> DataFrame:
    """One row per key; its property map holds each property's last value by ``order``."""
    each = rows.select(*keys, order, F.explode_outer(properties).alias("_k", "_v"))
    last = each.groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
    pairs = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias(properties))


def coalesce_merge(base: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Full outer merge by ``key``: new values win, but a value that ``base`` has in ``keep`` stays."""
    b, n = base.alias("b"), new.alias("n")
    cols = [F.coalesce(*(F.col(f"{side}.{c}") for side in (("b", "n") if c in keep else ("n", "b")))).alias(c) for c in base.columns if c != key]
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), *cols)


def page(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """One page of a list and, on each row, the number of rows before paging."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(*order).offset(skip).limit(limit)  # one row


def progress(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in JOB_PROGRESS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, status), F.lit(0))


def work_orders_of(orders: DataFrame, asset: Column | None = None, open_only: bool = False) -> DataFrame:
    """Work orders by scheduled date, unscheduled last."""
    rows = orders if asset is None else orders.where(F.col("asset_tag") == asset)
    rows = rows.where(F.col("status").isin(*OPEN_STATUSES)) if open_only else rows
    order = W.partitionBy("asset_tag").orderBy(F.asc_nulls_last("scheduled_date"), "wo_id")
    return rows.withColumn("position", F.row_number().over(order))


def work_order_lookup(questions: DataFrame, orders: DataFrame, text: str = "question") -> DataFrame:
    """An id named in the question wins; else open orders of its first asset tag."""
    asked = questions.withColumns({"wo_id": X.first_work_order(F.col(text)), "asset_tag": X.first_tag(F.regexp_replace(text, "(?i)" + X.WORK_ORDER, ""))})
    by_id = asked.where("wo_id IS NOT NULL").select("question_id", "wo_id").join(orders, "wo_id").select("question_id", "wo_id", F.lit("by_id").alias("found"))
    by_asset = asked.where("wo_id IS NULL AND asset_tag IS NOT NULL").select("question_id", "asset_tag").join(orders.where(F.col("status").isin(*OPEN_STATUSES)), "asset_tag").select("question_id", "wo_id", F.lit("by_asset").alias("found"))
    return by_id.unionByName(by_asset)


def keyword_search(incidents: DataFrame, history: DataFrame, limit: int = 5) -> DataFrame:
    """``incident_id, text`` against ``wo_id, description, completed_date``: rows with any keyword, newest first.

    Keywords have three characters at least, so a word that contains one has its first three. The distinct words of the descriptions
    meet the keywords by these, are compared whole, and only words with a keyword join back; work is linear in the words' lengths.
    """
    asked = incidents.select("incident_id", F.explode(X.keywords(F.col("text"))).alias("keyword"))
    words = history.select("wo_id", "completed_date", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"[a-z0-9\-]+"), F.lit(0)))).alias("word"))
    vocabulary = words.select("word").distinct().where("length(word) > 2")
    threes = vocabulary.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda k: F.substring("word", k, F.lit(3))))).alias("three"))
    keywords = asked.select("keyword").distinct().withColumn("three", F.substring("keyword", 1, 3))
    hits = threes.join(keywords, "three").where(F.col("word").contains(F.col("keyword"))).select("word", "keyword")
    found = asked.join(hits, "keyword").select("incident_id", "word").distinct().join(words, "word").select("incident_id", "wo_id", "completed_date").distinct()
    return found.withColumn("rank", F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc_nulls_last("completed_date"), "wo_id"))).where(F.col("rank") <= limit)


def last_messages(rows: DataFrame, session: list[str], order: list[str], n: int = 20) -> DataFrame:
    """The last ``n`` rows of each session with their ``position``, oldest first."""
    kept = latest(rows, session, [F.desc(c) for c in order], n)
    return kept.withColumn("position", F.row_number().over(W.partitionBy(*session).orderBy(*order)))


def failure_lines(history: DataFrame):
    """``tag, code, description, occurrences`` -> one line of text each."""
    return history.select("tag", F.concat(F.lit("- "), "tag", F.lit(": "), "description", F.lit(" ("), "code", F.lit(", "), F.col("occurrences").cast("string"), F.lit("x)")).alias("line"))


def work_order_lines(orders: DataFrame) -> DataFrame:
    """One line of text for each order; a null date is ``unscheduled``."""
    day = F.coalesce(F.date_format("scheduled_date", "yyyy-MM-dd"), F.lit("unscheduled"))
    return orders.select(F.concat(F.lit("- "), "wo_id", F.lit(" ["), "status", F.lit("/"), "priority", F.lit("] scheduled "), day).alias("line"))


def fan_out(incidents: DataFrame) -> DataFrame:
    """One retrieval question per incident and cause category."""
    return incidents.select("incident_id", F.explode(F.array(*map(F.lit, CAUSE_CATEGORIES))).alias("category"), "text").withColumn("query_text", F.concat_ws(" ", "text", "category"))


def retryable(job_events: DataFrame) -> DataFrame:
    """New QUEUED rows for documents whose newest job failed."""
    newest = latest(job_events, ["document_id"], [F.desc("created_at"), F.desc("job_id")])
    return newest.where("status = 'FAILED'").select("document_id", F.lit("QUEUED").alias("status"), F.col("job_id").alias("retry_of"))
