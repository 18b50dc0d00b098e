"""Left joins with the conventions of the study: the left column wins, missing keys may match,
a table can be asserted to match at most one row, and hot keys are spread by salting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


def _pairs(on: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
    return dict(on) if isinstance(on, Mapping) else {name: name for name in on}


def _condition(pairs: Mapping[str, str], match_nulls: Sequence[str]) -> Column:
    tests = [
        F.col(a).eqNullSafe(F.col(b)) if a in match_nulls else F.col(a) == F.col(b)
        for a, b in pairs.items()
    ]
    return reduce(lambda x, y: x & y, tests)


def _spread(left, slim, joined_on, spread_by, salts):
    """Give the left rows a salt and copy the right rows once per salt."""
    if salts == 1:
        return left, slim, joined_on
    if not spread_by:
        raise ValueError("salts need spread_by columns")
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        left.withColumn(_SALT, salt), slim.withColumn("_key_salt", copies),
        {**joined_on, _SALT: "_key_salt"},
    )


def key_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    *,
    how: str = "left",
    match_nulls: Sequence[str] = (),
    spread_by: Sequence[str] = (),
    salts: int = 1,
) -> DataFrame:
    """Equi join that keeps the left columns and adds what only the right side has.

    ``on`` maps left to right key names. Right columns named like a left one are dropped, so no
    suffixes arise. Left keys named in ``match_nulls`` match NULL with NULL; leave the other
    keys out of it, because only plain equality carries a filter to both scans.

    With ``salts`` > 1 the left rows of one key go to that many join partitions, chosen by a
    hash of the ``spread_by`` columns (the same on every retry), and the right rows are copied
    once per salt. Use it when a key may be hot on the left and the right side has about one row
    per key. No side is broadcast by hint: Spark compares the size with its threshold.
    """
    pairs = _pairs(on)
    extra = [c for c in right.columns if c not in left.columns and c not in pairs.values()]
    keys = {b: f"_key_{i}" for i, b in enumerate(pairs.values())}
    slim = right.select(*[F.col(b).alias(k) for b, k in keys.items()], *extra)
    joined_on = {a: keys[b] for a, b in pairs.items()}
    left, slim, joined_on = _spread(left, slim, joined_on, spread_by, salts)
    # The names on the two sides differ, so the condition needs no table references.
    joined = left.join(slim, _condition(joined_on, match_nulls), how)
    return joined.drop(_SALT, *joined_on.values())


def key_semi_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    match_nulls: Sequence[str] = (),
    *,
    spread_by: Sequence[str] = (),
    salts: int = 1,
) -> DataFrame:
    """Left rows whose key is in the right table; NULL is in a table that holds NULL when named
    in ``match_nulls``. The right side is made distinct first, so repeated keys are shuffled once.
    ``spread_by`` and ``salts`` spread hot left keys as in ``key_join``.
    """
    pairs = _pairs(on)
    slim = right.select(
        *[F.col(b).alias(f"_key_{i}") for i, b in enumerate(pairs.values())]
    ).distinct()
    joined_on = {a: f"_key_{i}" for i, a in enumerate(pairs)}
    left, slim, joined_on = _spread(left, slim, joined_on, spread_by, salts)
    return left.join(slim, _condition(joined_on, match_nulls), "left_semi").drop(_SALT)


def one_to_many_violations(
    left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Keys that break "each right row matches at most one left row", with their left row count."""
    pairs = _pairs(on)
    return key_semi_join(_repeated(left, pairs), right, pairs, match_nulls=tuple(pairs))


def _repeated(left: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    return left.groupBy(*pairs).agg(F.count(F.lit(1)).alias("n_left")).filter("n_left > 1")


def require_one_to_many(
    left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str]
) -> None:
    """Raise ``ValueError`` naming a few offending keys; runs a job.

    Only keys that the left table repeats can offend: without any, the right table is not read.
    """
    if _repeated(left, _pairs(on)).isEmpty():
        return
    offending = one_to_many_violations(left, right, on).limit(5).collect()
    if offending:
        raise ValueError(f"right rows match several left rows: {offending}")
