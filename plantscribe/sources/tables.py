"""Readers and writers: explicit schemas, keyed replacement and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORK_ORDER = "wo_id string, asset_tag string, description string, status string, priority string, scheduled_date string, completed_date string"
GOLDEN = "question string, expected_answer string, source_document_id string, source_page int, expected_entity_mentions array<string>, category string, alternate_sources array<string>"


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, content, size, sha256`` of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def date_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("date")


def work_order_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed_work_orders(spark.read.schema(WORK_ORDER).csv(path, header=True))


def typed_work_orders(rows: DataFrame) -> DataFrame:
    """Blank dates are null."""
    return rows.withColumns({c: date_or_null(F.col(c)) for c in ("scheduled_date", "completed_date")})


def golden_defaults(rows: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return rows.withColumns({"category": F.coalesce("category", F.lit("general")), "expected_entity_mentions": F.coalesce("expected_entity_mentions", empty), "alternate_sources": F.coalesce("alternate_sources", empty)})


def golden_json(spark: SparkSession, path: str) -> DataFrame:
    return golden_defaults(spark.read.schema(GOLDEN).json(path, multiLine=True))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def compliance_report(rows: DataFrame, session: str = "session", flag: str = "has_critical_gaps") -> DataFrame:
    """``session, report, has_critical_gaps``: the row as JSON beside the flag that lists filter on."""
    return rows.select(session, F.to_json(F.struct(*rows.columns)).alias("report"), F.col(flag).alias("has_critical_gaps"))


def newest(spark: SparkSession, path: str, order: str, n: int = 20) -> DataFrame:
    """The newest rows of an appended table, 100 at most."""
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(min(n, 100))
