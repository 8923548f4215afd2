"""Places in a total order and exact ranks of groups, over all tasks: no window that would gather a table or a group in one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in that order, written as a table.

    Rows are range-partitioned by Spark's sort and numbered within their partition; the partitions' sizes, as many rows as partitions,
    are summed up and broadcast. Rows that are equal in all of ``order`` share a partition, so name a column that tells rows apart
    where many may be.
    """
    low = F.lit((1 << 33) - 1)  # the row's number within its partition
    sorted_rows = rows.orderBy(*order).withColumns({"_pos_part": F.spark_partition_id(), "_pos_at": F.monotonically_increasing_id().bitwiseAND(low)})
    kept = stored(sorted_rows, "positions")
    sizes = kept.groupBy("_pos_part").agg(F.count("*").alias("_pos_n"))
    before = sizes.select("_pos_part", (F.sum("_pos_n").over(W.orderBy("_pos_part")) - F.col("_pos_n")).alias("_pos_before"))
    return kept.join(F.broadcast(before), "_pos_part").withColumn(name, F.col("_pos_before") + F.col("_pos_at")).drop("_pos_part", "_pos_at", "_pos_before")


RANGE = 65536


def running_total(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before them in that order: within a sorted partition, plus the partitions before."""
    kept = positions(rows, order, "_run_place").withColumn("_run_range", F.floor(F.col("_run_place") / RANGE))
    sums = kept.groupBy("_run_range").agg(F.sum(amount).alias("_run_n"))  # one row for each RANGE rows
    blocks = sums.withColumn("_run_block", F.floor(F.col("_run_range") / RANGE))
    above = blocks.groupBy("_run_block").agg(F.sum("_run_n").alias("_run_b"))
    above = above.select("_run_block", (F.sum("_run_b").over(W.orderBy("_run_block")) - F.col("_run_b")).alias("_run_start"))  # one for each RANGE * RANGE
    before = blocks.join(above, "_run_block").select("_run_range", (F.col("_run_start") + F.sum("_run_n").over(W.partitionBy("_run_block").orderBy("_run_range")) - F.col("_run_n")).alias("_run_before"))
    own = F.sum(amount).over(W.partitionBy("_run_range").orderBy("_run_place")) - F.col(amount)
    return kept.withColumn("_run_own", own).join(before, "_run_range").withColumn(name, F.col("_run_before") + F.col("_run_own")).drop("_run_range", "_run_before", "_run_own", "_run_place")


def values_at(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each group the number ``n`` of values, the ``least`` and ``largest``, and its value at each wanted rank, by name.

    A rank is a column function of ``n``, counted from 0. Equal values are counted before anything is sorted, their running counts are
    summed up over all tasks, and only the rows that hold a wanted rank are gathered: a group may hold any share of the rows.
    Null values don't count; null keys are a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = stored(running_total(counted, [*map(F.col, keys), F.col("_v")], "_n", "_before"), "ranks")
    groups = placed.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_before").alias("_start"), F.min("_v").alias("least"), F.max("_v").alias("largest"))
    named = groups.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n", "_start")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
    met = placed.join(named, same)  # one row a group; AQE splits a group that is large
    rank = F.col("_before") - F.col("_start")
    at = {name: F.max(F.when((rank <= f(F.col("n"))) & (f(F.col("n")) < rank + F.col("_n")), F.col("_v"))).alias(name) for name, f in wanted.items()}
    hit = reduce(lambda a, b: a | b, ((rank <= f(F.col("n"))) & (f(F.col("n")) < rank + F.col("_n")) for f in wanted.values()))
    found = met.where(hit).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(*at.values())
    return groups.drop("_start").join(found, same).drop(*(f"_k{i}" for i in range(len(keys))))
