"""The numbered corpus queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import importance, iso_media, language_id, merkle, nbest_pieces, packing, personal_data, quality_model, quality_rules, simhash, substring_dedup, token_orc, toxicity
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = iso_media.store(iso_media.to_media(table(spark, sf_dir, "documents")), scratch(spark, "iso-media"))
    found = iso_media.probe_media(spark.read.parquet(path))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-orc"))
    return token_orc.token_index(spark, path)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_pieces.encode(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(stored_ledger(spark, sf_dir))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.stored_ledger(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))


def ledger_base_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another version of the policy on the stored ledger."""
    return quality_rules.apply_policy(stored_ledger(spark, sf_dir), "base")


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule rejects, alone and with others, from the stored bits."""
    return quality_rules.ablations(stored_ledger(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.train(docs))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    numbered = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return numbered | {"ledger_base_policy": ledger_base_policy, "ledger_ablation": ledger_ablation}


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality_rules.ORACLE_SQL, "ledger_base_policy": quality_rules.BASE_SQL, "ledger_ablation": quality_rules.ABLATION_SQL, "op11_importance_resampling": importance.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
