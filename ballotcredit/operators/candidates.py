"""Candidate frame: office candidates with votes and result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import FEDERAL_DEPUTY, FIRST_YEAR
from ballotcredit.functions.text import birth_place
from ballotcredit.operators.joins import key_join
from ballotcredit.operators.rows import drop_matching

KEYS = ("id_candidato_bd", "ano", "tipo_eleicao")


def candidate_frame(
    demographics: DataFrame,
    voting: DataFrame,
    office: str = FEDERAL_DEPUTY,
    first_year: int = FIRST_YEAR,
) -> DataFrame:
    """Candidates of one office since ``first_year`` with the columns of the results table.

    Columns present in both tables come from ``demographics``. Candidates without an id drop;
    candidates without a result row keep NULL votes.
    """
    people = demographics.filter(
        F.col("id_candidato_bd").isNotNull()
        & (F.col("cargo") == office)
        & (F.col("ano") >= first_year)
    )
    results = voting.filter(F.col("ano") >= first_year)
    frame = drop_matching(
        key_join(people, results, KEYS, match_nulls=("tipo_eleicao",)), "email")
    if "municipio_nascimento" in frame.columns:
        frame = frame.withColumn("municipio_nascimento", birth_place(F.col("municipio_nascimento")))
    return frame
