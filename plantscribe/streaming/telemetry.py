"""Windowed service telemetry; each function takes a batch or a streaming frame alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Upper bounds of the latency histogram, seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LATENESS = "10 minutes"


def _late(events: DataFrame, time: str) -> DataFrame:
    """Streams drop what comes later than LATENESS; their event time has to be a timestamp with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATENESS) if events.isStreaming else events


def rates(events: DataFrame, keys: list[str], time: str = "ts", width: str = "5 minutes", seconds: int = 300, slide: str | None = None) -> DataFrame:
    """Rows a second by key and window; windows slide where ``slide`` is given."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    counted = _late(events, time).groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def failure_rates(events: DataFrame, failed: Column, time: str = "ts", width: str = "5 minutes") -> DataFrame:
    grouped = _late(events, time).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return grouped.select(F.col("w.start").alias("window_start"), "n", "failed", F.round(F.col("failed") / F.col("n"), 6).alias("failure_rate"))


def bucket_counts(events: DataFrame, value: str, time: str = "ts", width: str = "5 minutes", bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative histogram: observations up to each bound."""
    grouped = _late(events, time).groupBy(F.window(time, width).alias("w")).agg(F.count(value).alias("n"), *(F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)))
    return grouped.select(F.col("w.start").alias("window_start"), "n", F.array(*(f"le_{k}" for k in range(len(bounds)))).alias("counts"))


def histogram_quantile(q: float, counts: Column, n: Column, bounds: tuple[float, ...] = BUCKETS) -> Column:
    """Linear interpolation inside the bucket that holds the rank; above the last bound, that bound."""
    rank = n * q
    out = F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        low, below = (bounds[k - 1], counts[k - 1]) if k else (0.0, F.lit(0))
        inside = counts[k] - below
        value = F.lit(low) + F.when(inside > 0, (rank - below) / inside).otherwise(F.lit(0.0)) * (bounds[k] - low)
        out = F.when(counts[k] >= rank, value).otherwise(out)
    return F.when(n > 0, F.round(out, 6))


def window_sums(events: DataFrame, keys: list[str], value: str, time: str = "ts", width: str = "1 hour") -> DataFrame:
    summed = _late(events, time).groupBy(F.window(time, width).alias("w"), *keys).agg(F.sum(value).alias("total"))
    return summed.select(F.col("w.start").alias("window_start"), *keys, F.round("total", 4).alias("total"))


def open_now(events: DataFrame, step: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Openings minus closings so far, within each key."""
    return events.withColumn("open", F.sum(step).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def sessions(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "1 hour") -> DataFrame:
    """Sessions that each event keeps alive for ``gap``."""
    grouped = _late(events, time).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("expires"), "n")


def without_repeats(questions: DataFrame, keys: list[str], time: str = "ts", within: str = "5 minutes") -> DataFrame:
    """A question stream without those asked again within that time."""
    return questions.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
