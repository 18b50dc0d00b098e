"""The two channels from input tables to the pooled panel, all elections in one plan.

The margin reads the candidate rows twice (list thresholds, then the candidates themselves), so
each channel writes them once in between: the joins over loans, votes and donations run once, and
what follows restarts from the written table when executors are lost. The municipality channel
writes the loan totals before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import (
    BASE_SIZE,
    ELECTIONS,
    MARGIN_STATUSES,
    PARTY,
    WINNER_STATUSES,
    YEARS_AFTER,
)
from ballotcredit.operators.coalition import with_coalition
from ballotcredit.operators.candidates import KEYS
from ballotcredit.operators.donors import donor_loan_outcomes, firm_loan_totals
from ballotcredit.operators.joins import require_one_to_many
from ballotcredit.operators.loans import municipality_loan_totals
from ballotcredit.operators.margin import vote_margin
from ballotcredit.operators.panel import pooled_panel
from ballotcredit.operators.votes import base_loan_outcomes, electoral_base
from ballotcredit.sources.sinks import written

MUNICIPALITY = "municipios"
FIRM = "empresas"


def municipality_panel(
    candidates: DataFrame,
    votes: DataFrame,
    loans: DataFrame,
    coalition: DataFrame,
    *,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    base_size: int = BASE_SIZE,
    party: str = PARTY,
    statuses: Mapping[int | None, Sequence[str]] = WINNER_STATUSES,
    margin_statuses: Sequence[str] | None = MARGIN_STATUSES,
    fold_names: bool = False,
    skip_nulls: bool = False,
    loan_order: str = "data_da_contratacao",
    vote_order: str = "nm_municipio",
    salts: int = 1,
    check: bool = True,
) -> DataFrame:
    """Panel of candidates with the loans contracted in their electoral base.

    ``candidates`` comes from ``candidate_frame``; ``votes`` are the votes by candidate and
    municipality; ``loans`` is the union of both loan tables. ``loan_order`` and ``vote_order``
    say which row is the first where that decides. Two candidates of one election, state and
    number that receive votes raise, unless ``check`` is off. ``salts`` spread hot join keys.
    """
    of_election = F.col("ano").isin(*elections)
    running, given = candidates.filter(of_election), votes.filter(of_election)
    if check:
        require_one_to_many(running, given, {
            "ano": "ano", "sigla_uf": "sg_uf", "numero_candidato": "nr_candidato"})
    # Written, their size is known before the base is shuffled: small ones are broadcast.
    totals = written(municipality_loan_totals(
        loans, elections=elections, years_after=years_after, fold_names=fold_names,
        skip_nulls=skip_nulls, order=loan_order))
    base = electoral_base(running, given, base_size)
    outcomes = base_loan_outcomes(base, totals, tie_order=(vote_order,), salts=salts)
    listed = with_coalition(outcomes, coalition, party, fill_before_flag=True, salts=salts)
    return pooled_panel(vote_margin(written(listed), statuses, margin_statuses, salts=salts))


def firm_panel(
    candidates: DataFrame,
    donations: DataFrame,
    loans: DataFrame,
    coalition: DataFrame,
    *,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    party: str = PARTY,
    statuses: Mapping[int | None, Sequence[str]] = WINNER_STATUSES,
    margin_statuses: Sequence[str] | None = MARGIN_STATUSES,
    match_nulls: bool = True,
    skip_nulls: bool = False,
    indicator: str = "first",
    loan_order: str = "data_da_contratacao",
    donation_order: str = "data_receita",
    salts: int = 1,
    check: bool = True,
) -> DataFrame:
    """Panel of candidates with the non-automatic loans of their corporate donors.

    ``donations`` and ``loans`` carry parsed ids (``parse_tax_id``). A donation that matches two
    candidates raises, unless ``check`` is off. ``salts`` spread hot join keys.
    """
    running = candidates.filter(F.col("ano").isin(*elections))
    given = donations.filter(F.col("ano").isin(*elections))
    if check:
        require_one_to_many(running, given, KEYS)
    totals = firm_loan_totals(
        loans, elections=elections, years_after=years_after, skip_nulls=skip_nulls,
        order=loan_order)
    outcomes = donor_loan_outcomes(
        running, given, totals, match_nulls=match_nulls, indicator=indicator,
        order=donation_order, salts=salts)
    listed = with_coalition(outcomes, coalition, party, fill_before_flag=False, salts=salts)
    return pooled_panel(vote_margin(written(listed), statuses, margin_statuses, salts=salts))
