"""Votes by municipality: vote shares, the electoral base, and the loans of the base."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import ACCEPTED_REGISTRATION, BASE_SIZE
from ballotcredit.functions.numeric import log_one_plus, safe_ratio, zero_if_missing
from ballotcredit.functions.text import normalize_name
from ballotcredit.operators.joins import key_join
from ballotcredit.operators.rows import top_with_ties

CANDIDATE = ("id_candidato_bd", "ano")
NUMBER = ("ano", "_uf", "_uf_known", "_number", "_number_known")
# Columns of the outcome table, as far as the inputs have them.
OUTCOME_COLUMNS = (
    "sigla_uf", "votos", "resultado", "nome", "numero_partido", "sigla_partido", "sg_partido",
    "ds_composicao_coligacao", "idade", "genero", "instrucao", "estado_civil", "nacionalidade",
    "raca", "numero_candidato", "ds_sit_tot_turno", "vot_prop_cand",
)


def municipal_vote_share(votes: DataFrame, totals: DataFrame, salts: int = 1) -> DataFrame:
    """Votes with the municipality's valid votes, the candidate's share of them and a comparable
    name. Names are joined as written; ``totals`` has (ano, uf, nm_municipio, qt_votos_mun)."""
    joined = key_join(
        votes, totals, {"ano": "ano", "sg_uf": "uf", "nm_municipio": "nm_municipio"},
        match_nulls=("sg_uf", "nm_municipio"), spread_by=("nr_candidato",), salts=salts,
    )
    return joined.withColumn(
        "vot_prop_mun", safe_ratio(F.col("qt_votos_nom_validos"), F.col("qt_votos_mun"))
    ).withColumn("municipio", normalize_name(F.col("nm_municipio")))


def electoral_base(candidates: DataFrame, votes: DataFrame, k: int = BASE_SIZE) -> DataFrame:
    """The ``k`` municipalities with the largest shares of a candidate's own votes, ties included.

    Only positive shares count. Within one (year, state, number) the order by share is the order
    by votes, so each number's votes are first cut to the top ``k`` before they meet the
    candidates; the rank over the candidate's id then settles ids that have several rows.
    Adds a comparable ``municipio`` when ``votes`` has none.
    """
    numbered = _without_nulls(candidates, {"_uf": "sigla_uf", "_number": "numero_candidato"})
    given = _without_nulls(
        votes.filter(F.col("qt_votos_nom_validos") > 0),
        {"_uf": "sg_uf", "_number": "nr_candidato"}).drop("sg_uf", "nr_candidato")
    leading = top_with_ties(given, NUMBER, "qt_votos_nom_validos", k)
    joined = key_join(numbered, leading, NUMBER, how="inner").drop(*NUMBER[1:])
    share = safe_ratio(F.col("qt_votos_nom_validos"), F.col("votos"))
    shared = joined.withColumn("vot_prop_cand", share).filter(F.col("vot_prop_cand") > 0)
    base = top_with_ties(shared, CANDIDATE, "vot_prop_cand", k)
    if "municipio" in base.columns:
        return base
    # The name that nm_municipio gives is as long: it is made where no shuffle follows.
    name = normalize_name(F.col("nm_municipio")).alias("municipio")
    return base.select(*base.columns[:-1], name, "vot_prop_cand")


def _without_nulls(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The columns again as keys that are never NULL, each with a mark where it was: a rank and a
    join by them, in which missing values match, need one shuffle, and a plain equality."""
    for key, name in names.items():
        empty = "''" if dict(df.dtypes)[name] == "string" else "0"
        df = df.withColumn(key, F.coalesce(F.col(name), F.expr(empty))).withColumn(
            f"{key}_known", F.col(name).isNotNull())
    return df


def base_loan_outcomes(
    base: DataFrame,
    municipality_totals: DataFrame,
    *,
    accepted: Sequence[str] = ACCEPTED_REGISTRATION,
    tie_order: Sequence[str] = ("nm_municipio",),
    salts: int = 1,
) -> DataFrame:
    """One row per candidate and election: loans of the base, their logs, candidate columns.

    A municipality without loans or with an unknown total counts as zero. Columns that differ
    between the municipalities come from the one with the largest share (then ``tie_order``).
    """
    totals = municipality_totals.select(
        "ano", "uf", "municipio", "total_contratado", "total_desembolsado"
    )
    attached = key_join(
        base.filter(F.col("situacao").isin(*accepted)), totals,
        {"ano": "ano", "sigla_uf": "uf", "municipio": "municipio"},
        match_nulls=("sigla_uf", "municipio"), spread_by=("id_candidato_bd",), salts=salts,
    )
    kept = [c for c in OUTCOME_COLUMNS if c in base.columns]
    largest = F.struct(
        (-F.col("vot_prop_cand")).alias("_share"), *tie_order,
    )
    summed = attached.groupBy(*CANDIDATE).agg(
        F.sum(zero_if_missing(F.col("total_contratado"))).alias("total_contratado_base"),
        F.sum(zero_if_missing(F.col("total_desembolsado"))).alias("total_desembolsado_base"),
        F.min_by(F.struct(*kept), largest).alias("_row"),
    )
    return summed.select(
        *CANDIDATE, "total_contratado_base", "total_desembolsado_base",
        log_one_plus(F.col("total_contratado_base")).alias("log_c"),
        log_one_plus(F.col("total_desembolsado_base")).alias("log_d"),
        "_row.*",
    )
