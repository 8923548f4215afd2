"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the last return the
columns of ``documents``.

In every stage null and empty texts count as texts without words (the language stage drops them, having no letter), rows that repeat a
doc_id or have none are judged one by one, ties go to the smaller doc_id, texts are read whole, an empty table stays empty, and other
columns than those of ``documents`` are left behind whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantscribe.llm import language_id, packing, quality_model, shingle_dedup, substring_dedup
from plantscribe.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry model rejects go."""
    return quality_model.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose likeliest language has a probability below one half, go."""
    docs = docs.select(*COLUMNS)
    return language_id.keep_identified(docs, language_id.train(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) one row stays, that of the smallest doc_id.

    Bit-sliced SimHash comparison finds the pairs, exact similarity confirms them.
    """
    rows = shingle_dedup.numbered(docs.select(*COLUMNS))
    return rows.join(shingle_dedup.representatives(rows), "row", "left_semi").select(*COLUMNS)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut out; every document stays, if only as an empty text."""
    found = substring_dedup.deduplicate(docs, ("lang", "source"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_identification),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", best_fit_packing),
]
#: Learned models and a public tokenizer: not expressible in SQL, so tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
