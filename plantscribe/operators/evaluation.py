"""Retrieval evaluation: golden matches, first-hit ranks, aggregates, gate and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import values_at

MAX_HALLUCINATION = 0.15


def golden_names(golden: DataFrame) -> DataFrame:
    """``golden(query_id, source, page, alternates array)`` -> one row ``query_id, slug, golden_page, main`` for each name."""
    main = golden.select("query_id", F.lower("source").alias("slug"), F.col("page").alias("golden_page"), F.lit(True).alias("main"))
    return main.unionByName(golden.select("query_id", F.explode(F.transform("alternates", lambda a: F.lower(a))).alias("slug"), F.lit(None).cast("int").alias("golden_page"), F.lit(False).alias("main")))


def golden_hits(golden: DataFrame, ranked: DataFrame) -> DataFrame:
    """``query_id, rank`` of ranked chunks of a golden source.

    ``golden`` as rows of ``golden_names``, or as these are made of; ``ranked(query_id, rank, document, title_stem, page)``. The main source
    matches by document or stem, with pages at most one apart where both are known; alternates match by document alone. Names stay rows,
    so a question may have any number of them.
    """
    known = golden if "slug" in golden.columns else golden_names(golden)
    names = ranked.select("query_id", "rank", "page", F.explode(F.array_distinct(F.array(F.lower("document"), F.lower("title_stem")))).alias("slug"))
    near = F.coalesce(F.abs(F.col("page") - F.col("golden_page")) <= 1, F.lit(True))
    return known.join(names, ["query_id", "slug"]).where(~F.col("main") | near).select("query_id", "rank").distinct()


def first_hit_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Smallest golden rank of each query, null where it has none."""
    return queries.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")


def mrr(rank: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 4), F.lit(0.0))


def ndcg(rank: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.coalesce(1 / F.log2(rank + 1), F.lit(0.0))), 4), F.lit(0.0))


def share(flag: Column) -> Column:
    """Mean of a flag, four places (half up), 0 for no rows."""
    return F.coalesce(F.round(F.avg(flag.cast("double")), 4), F.lit(0.0))


def context_precision(flags: DataFrame, queries: DataFrame) -> DataFrame:
    """Relevant share of what was retrieved for a query, 0 where nothing was."""
    found = flags.groupBy("query_id").agg(share(F.col("relevant")).alias("precision"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("precision", F.coalesce("precision", F.lit(0.0)))


def gate(hallucination_rate: Column, most: float = MAX_HALLUCINATION) -> Column:
    return hallucination_rate <= most


def exclusive_percentile(sorted_values: Column, p: int) -> Column:
    """Percentile at (n + 1) * p / 100 of a sorted array by linear interpolation, beyond the ends by the end's slope.

    ``percentile`` is the inclusive method, which differs for few values.
    """
    n = F.size(sorted_values)
    j = F.least(F.greatest(F.floor((n + 1) * p / 100), F.lit(1)), n - 1).cast("int")
    delta = (n + 1) * p - j * 100
    low, high = F.try_element_at(sorted_values, j), F.try_element_at(sorted_values, j + 1)
    return F.when(n == 1, F.try_element_at(sorted_values, F.lit(1))).otherwise((low * (100 - delta) + high * delta) / 100)


def latency_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, median, exclusive 95th and 99th percentile, least and largest, one place.

    Values are counted, sorted over all tasks and only those at the wanted ranks are gathered, so a group may hold any share of the rows.
    """
    below = lambda n, p: F.least(F.greatest(F.floor((n + 1) * p / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    ranks = {"_m0": lambda n: F.floor((n - 1) / 2), "_m1": lambda n: F.floor(n / 2)}
    for p in (95, 99):
        ranks |= {f"_a{p}": lambda n, p=p: below(n, p) - 1, f"_b{p}": lambda n, p=p: F.least(below(n, p), n - 1)}
    found = values_at(rows.withColumn("_d", F.col(value).cast("double")), keys, "_d", ranks)

    def at(p: int) -> Column:
        delta = (F.col("n") + 1) * p - below(F.col("n"), p) * 100
        mixed = F.col(f"_a{p}") * (100 - delta) / 100 + F.col(f"_b{p}") * delta / 100
        return F.round(F.when(F.col("n") == 1, F.col(f"_a{p}")).otherwise(mixed), 1)

    return found.select(*keys, "n", F.round((F.col("_m0") + F.col("_m1")) / 2, 1).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.round("least", 1).alias("min"), F.round("largest", 1).alias("max"))


def group_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median, least and largest value of each group, whatever its size."""
    found = values_at(rows, keys, value, {"_m0": lambda n: F.floor((n - 1) / 2), "_m1": lambda n: F.floor(n / 2)})
    return found.select(*keys, ((F.col("_m0") + F.col("_m1")) / 2).alias("median"), F.col("least").alias("min"), F.col("largest").alias("max"))


def extraction_report(chunks: DataFrame, entities: DataFrame, relations: DataFrame, document: str = "doc_id", failed: str = "failed") -> DataFrame:
    """``document, chunks, failed, entities, relations, success_rate`` of the documents in ``chunks``; a null chunk is none, and a
    document without chunks succeeds."""
    count = lambda rows, name: rows.groupBy(document).agg(F.count("*").alias(name))
    some = F.col(failed).isNotNull()
    base = chunks.groupBy(document).agg(F.count_if(some).alias("chunks"), F.count_if(some & F.col(failed)).alias("failed"))
    met = base.join(count(entities, "entities"), document, "left").join(count(relations, "relations"), document, "left").na.fill(0, ["entities", "relations"])
    return met.withColumn("success_rate", F.round(F.when(F.col("chunks") == 0, 1.0).otherwise((F.col("chunks") - F.col("failed")) / F.col("chunks")), 4))
