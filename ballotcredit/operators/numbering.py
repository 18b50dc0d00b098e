"""Ranks over a whole table without a task that sees all of it.

The different keys are sorted in ranges, each range adds up its own rows, and the sums of the ranges
before, one row a range, are added to its places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.operators.joins import key_join
from ballotcredit.sources.sinks import written


def ranked_keys(df: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The different values of ``within`` and ``order`` with rank, dense_rank and n, their rows.

    Ranks follow ``order`` ascending, missing values first, and start from 1 for each value of
    ``within``; equal rows share one. Work per task is a range of keys, whatever one value of
    ``within`` holds. The sorted keys are a written table, so that all steps see the same ranges.
    """
    keys = [*within, *order]
    taken = {"rank", "dense_rank", "n"} & {k.lower() for k in keys}
    if not order or taken:
        raise ValueError(f"keys cannot be named {sorted(taken)}" if taken else "no order is named")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(
        counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_place", 33))
    inside = Window.partitionBy("_range").orderBy("_place")
    placed = ranged.withColumns({
        "_rows": F.sum("n").over(inside) - F.col("n"), "_keys": F.row_number().over(inside) - 1})
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    # One row per range, of which there are at most as many as shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k"))
    whole = placed.join(F.broadcast(offsets), "_range").select(
        *keys, "n", (F.col("_n") + F.col("_rows") + 1).alias("rank"),
        (F.col("_k") + F.col("_keys") + 1).alias("dense_rank"))
    if not within:
        return whole
    first = whole.groupBy(*within).agg(
        (F.min("rank") - 1).alias("_n"), (F.min("dense_rank") - 1).alias("_k"))
    return key_join(whole, first, within, match_nulls=tuple(within)).select(
        *keys, "n", (F.col("rank") - F.col("_n")).alias("rank"),
        (F.col("dense_rank") - F.col("_k")).alias("dense_rank"))


def with_rank(
    df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = (), dense: bool = False,
) -> DataFrame:
    """``df`` with a row's rank (a long) as ``name``, as ``ranked_keys`` counts it."""
    keys = [*within, *order]
    ranks = ranked_keys(df, order, within).select(
        *keys, F.col("dense_rank" if dense else "rank").alias(name))
    return key_join(df, ranks, keys, match_nulls=tuple(keys))


def factor_levels(df: DataFrame, column: str, code: str) -> DataFrame:
    """The different values of ``column`` numbered from 1 in sorted order; a missing one has none."""
    return ranked_keys(df.where(F.col(column).isNotNull()), [column]).select(
        column, F.col("dense_rank").cast("int").alias(code))
