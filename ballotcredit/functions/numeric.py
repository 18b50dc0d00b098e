"""Column functions with the missing-value rules the study relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballotcredit.constants import STARS


def na_sum(c: Column, skip_nulls: bool = False) -> Column:
    """Aggregate: sum that is NULL as soon as one value of the group is NULL."""
    if skip_nulls:
        return F.sum(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice where a NULL condition gives NULL instead of the second value."""
    return F.when(condition, yes).when(~condition, no)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero or missing denominator gives NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def zero_if_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not reach a rank."""
    return F.when(~F.isnan(c), c)


def log_one_plus(c: Column) -> Column:
    return F.log(F.lit(1.0) + c.cast("double"))


def format_pattern(c: Column, pattern: str) -> Column:
    """Number as text by a decimal pattern such as ``#,##0.0#``; rounds half to even."""
    return F.call_function("format_number", c, F.lit(pattern))


def magnitude(c: Column) -> Column:
    """Short money text with decimal comma: ``12,25 bi``, ``1,2 mi``, ``999.999``."""
    x = c.cast("double")
    bn, mn = x / F.lit(1e9), x / F.lit(1e6)
    # Fixed rule of the printed reports: seven significant digits, so one decimal is left from
    # 100 thousand billions up.
    billions = F.when(bn < 99999.995, format_pattern(bn, "#,##0.0#")).otherwise(
        format_pattern(bn, "#,##0.0")
    )
    text = (
        F.when(x > 999999999, F.concat(billions, F.lit(" bi")))
        .when(x > 999999, F.concat(format_pattern(mn, "#,##0.0"), F.lit(" mi")))
        .otherwise(format_pattern(x, "#,##0"))
    )
    return F.translate(text, ",.", ".,")


def stars(estimate: Column, std_error: Column) -> Column:
    """Significance marks of a two-sided normal test; NULL when there is no standard error."""
    # Multiplied out, so that a standard error of zero cannot divide.
    marked = F.when(estimate.isNull() | std_error.isNull(), F.lit(None).cast("string"))
    for mark, critical in STARS:
        marked = marked.when(F.abs(estimate) > F.lit(critical) * std_error, F.lit(mark))
    return marked.otherwise(F.lit(""))
