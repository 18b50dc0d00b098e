"""Vote margin of candidates inside their list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import MARGIN_STATUSES, WINNER_STATUSES
from ballotcredit.functions.numeric import if_else
from ballotcredit.operators.joins import key_join


def won_seat(statuses: Mapping[int | None, Sequence[str]] = WINNER_STATUSES) -> Column:
    """Whether ``resultado`` means a seat in the row's year; NULL for an unknown result."""
    other = F.col("resultado").isin(*statuses[None])
    special = [year for year in statuses if year is not None]
    if not special:
        return other
    chosen = None
    for year in special:
        test = F.col("resultado").isin(*statuses[year])
        is_year = F.col("ano") == year
        chosen = F.when(is_year, test) if chosen is None else chosen.when(is_year, test)
    return chosen.otherwise(other)


def list_thresholds(
    df: DataFrame, statuses: Mapping[int | None, Sequence[str]] = WINNER_STATUSES
) -> DataFrame:
    """Votes of the last winner and the best loser per election, state and list, in one pass."""
    won = won_seat(statuses)
    return df.groupBy("ano", "sigla_uf", "colig").agg(
        F.min(F.when(won, F.col("votos"))).alias("min_votos_win"),
        F.max(F.when(~won, F.col("votos"))).alias("max_votos_loss"),
    )


def vote_margin(
    df: DataFrame,
    statuses: Mapping[int | None, Sequence[str]] = WINNER_STATUSES,
    margin_statuses: Sequence[str] | None = MARGIN_STATUSES,
    *,
    drop_ties: bool = True,
    salts: int = 1,
) -> DataFrame:
    """Add ``elected``, the list thresholds and the signed and absolute margin.

    Candidates with a result in ``margin_statuses`` are measured from the best loser, the others
    from the last winner; ``None`` uses the winners of the year instead. Lists without a winner
    are left out, and with ``drop_ties`` candidates whose margin is zero or unknown.

    The thresholds are combined per list before the shuffle and joined back with salts, so no
    list is gathered in one task. ``df`` is read twice; pass a written table when it is costly.
    """
    won = won_seat(statuses)
    thresholds = list_thresholds(df, statuses).filter(F.col("min_votos_win").isNotNull())
    joined = key_join(
        df.withColumn("elected", if_else(won, F.lit(1), F.lit(0))), thresholds,
        ["ano", "sigla_uf", "colig"], how="inner", match_nulls=("sigla_uf", "colig"),
        spread_by=("id_candidato_bd",), salts=salts,
    )
    from_loser = won if margin_statuses is None else F.col("resultado").isin(*margin_statuses)
    margin = if_else(
        from_loser,
        F.col("votos") - F.col("max_votos_loss"),
        F.col("votos") - F.col("min_votos_win"),
    )
    measured = joined.withColumn("vote_margin", margin).withColumn(
        "abs_vote_margin", F.abs(F.col("vote_margin"))
    )
    return measured.filter(F.col("abs_vote_margin") != 0) if drop_ties else measured
