"""Distinct rows, first rows and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.functions.numeric import nan_to_null


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select ``names`` in order; a name given twice is kept once."""
    return df.select(*dict.fromkeys(names))


def drop_matching(df: DataFrame, text: str) -> DataFrame:
    """Drop the columns whose name contains ``text`` in any case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if text.lower() not in c.lower()])


def move_columns(
    df: DataFrame, names: Sequence[str], after: str | None = None, before: str | None = None
) -> DataFrame:
    """Move ``names`` next to another column, or to the front."""
    rest = [c for c in df.columns if c not in names]
    if after is not None:
        at = rest.index(after) + 1
    else:
        at = rest.index(before) if before is not None else 0
    return df.select(*[F.col(f"`{c}`") for c in (*rest[:at], *names, *rest[at:])])


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``columns``."""
    return keep_columns(df, columns).distinct()


def first_row_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Whole first row of every key under a stated order.

    Each task keeps its own first row before the shuffle (a window group limit), so a key that
    holds a large part of the rows costs one row per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter("_position = 1").drop("_position")


def top_with_ties(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """Rows among the ``n`` largest of ``by`` per key; rows tied with the last one all stay.

    Limited per task before the shuffle like ``first_row_per_key``. Rows without a value of
    ``by``, NaN included, are left out.
    """
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(by).desc()))
    value = F.col(by)
    if dict(df.dtypes)[by] in ("double", "float"):
        value = nan_to_null(value)
    ranked = df.filter(value.isNotNull()).withColumn("_place", place)
    return ranked.filter(F.col("_place") <= n).drop("_place")
