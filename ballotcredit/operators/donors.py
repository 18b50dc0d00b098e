"""Firm channel: loans of a candidate's corporate donors."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from ballotcredit.constants import (
    ACCEPTED_REGISTRATION,
    CORPORATE_ORIGIN,
    ELECTIONS,
    YEARS_AFTER,
)
from ballotcredit.functions.numeric import if_else, log_one_plus, zero_if_missing
from ballotcredit.operators.candidates import KEYS
from ballotcredit.operators.joins import key_join, key_semi_join
from ballotcredit.operators.loans import window_sums

CANDIDATE = ("id_candidato_bd", "ano")
CONTRACTED = "valor_contratado_reais"
# A donation's order and value in one number: order * _STEP + value + _SHIFT. An order is a long and a
# value has 18 digits and a sign: the number fits a decimal of 38 digits whatever they are. As powers
# of two they leave the bytes of both apart, which shuffles compress.
_STEP, _SHIFT = Decimal(2**61), Decimal(2**60)
_UNKNOWN = Decimal(-(2**63))
# Candidate columns of the outcome table, as far as the inputs have them.
ATTRIBUTES = (
    "sigla_uf", "nome", "resultado", "votos", "numero_partido", "sigla_partido", "situacao",
    "idade", "genero", "instrucao", "estado_civil", "nacionalidade", "sigla_uf_nascimento",
    "raca", "turno", "numero_candidato",
)


def firm_loan_totals(
    loans: DataFrame,
    *,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    skip_nulls: bool = False,
    order: str = "data_da_contratacao",
) -> DataFrame:
    """One row per election and firm: loan totals and the client of its first loan.

    ``cnpj`` is a parsed id. The first loan is the smallest ``order``, then the smallest (client,
    state, municipality). A missing amount makes the firm's total NULL unless ``skip_nulls``.

    Each task combines a firm's loans of a year wherever they were contracted, so what is shuffled
    grows with the firms.
    """
    sums = window_sums(
        loans, ["cnpj"], CONTRACTED, elections, years_after, order,
        of_first=("cliente", "uf", "municipio"))

    def total(part: str, present: str):
        return F.col(part) if skip_nulls else F.when(F.col("_n") == F.col(present), F.col(part))

    return sums.select(
        "ano", "cnpj", total("_sum_c", "_n_c").alias("total_contratado"),
        total("_sum_d", "_n_d").alias("total_desembolsado"),
        "_first.cliente", "_first.uf", "_first.municipio",
    )


def donor_loan_totals(
    loans: DataFrame,
    donations: DataFrame,
    candidates: DataFrame | None = None,
    *,
    match_nulls: bool = True,
    **options,
) -> DataFrame:
    """``firm_loan_totals`` (which takes the other options) of the firms that are donors.

    With ``candidates`` the donors are those of the candidates' donations, and a candidate without
    donations contributes a missing donor; without them any donation names a donor. Loans and
    donors whose id could not be parsed match each other while ``match_nulls``.
    """
    donors = donations.select(*KEYS, "cpf_cnpj_doador").distinct()
    if candidates is not None:
        donors = key_join(candidates.select(*KEYS).distinct(), donors, KEYS,
                          match_nulls=("tipo_eleicao",))
    return key_semi_join(
        firm_loan_totals(loans, **options), donors, {"ano": "ano", "cnpj": "cpf_cnpj_doador"},
        match_nulls=("cnpj",) if match_nulls else (),
    )


def combined_gifts(
    donations: DataFrame, origin: str = CORPORATE_ORIGIN, order: str = "data_receita"
) -> DataFrame:
    """Donations of one origin per candidate and donor: count, value, and the first donation.

    The first donation has the smallest ``order`` (a date or a file position), then the smallest
    value; an unknown order, which counts as the smallest long, comes first. Both lie in one
    decimal, so that raw rows are combined by hash aggregation: the order, any long, above 61
    bits for the value, which is a decimal of at most 18 digits.
    """
    return _packed_gifts(donations, origin, order).select(
        *KEYS, "cpf_cnpj_doador", "_n", "_value", _first_gift(donations, order).alias("_gift"))


def _gift_scale(donations: DataFrame) -> int:
    kind = donations.schema["valor_receita"].dataType
    return kind.scale if isinstance(kind, DecimalType) else 4


def _packed_gifts(donations: DataFrame, origin: str, order: str) -> DataFrame:
    """``combined_gifts`` with the first donation as the number ``_key``, and with its ``_date``
    where that is not the order itself: narrow rows for the shuffles in between."""
    value, scale = zero_if_missing(F.col("valor_receita")), _gift_scale(donations)
    place = F.col(order)
    if isinstance(donations.schema[order].dataType, DateType):
        place = F.unix_date(order)
    units = (value.cast(f"decimal(18,{scale})").cast(f"decimal(38,{scale})")
             * F.lit(10**scale)).cast("decimal(20,0)")
    # An unknown order comes first, as a missing value does in a sort.
    key = (F.coalesce(place.cast("decimal(19,0)"), F.lit(_UNKNOWN).cast("decimal(19,0)"))
           * F.lit(_STEP) + units + F.lit(_SHIFT)).cast("decimal(38,0)")
    date = [] if _dated_by(donations, order) else [F.min_by("data_receita", key).alias("_date")]
    return donations.filter(F.col("origem_receita") == origin).groupBy(
        *KEYS, "cpf_cnpj_doador").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_value"), F.min(key).alias("_key"),
        *date,
    )


def _dated_by(donations: DataFrame, order: str) -> bool:
    return order == "data_receita" and isinstance(donations.schema[order].dataType, DateType)


def _first_gift(donations: DataFrame, order: str):
    """The first donation as a struct, from the columns of ``_packed_gifts``."""
    scale = _gift_scale(donations)
    place = F.floor(F.col("_key") / F.lit(_STEP))
    rest = F.pmod(F.col("_key"), F.lit(_STEP)) - F.lit(_SHIFT)
    worth = (rest.cast("decimal(20,0)") / F.lit(10**scale).cast("decimal(6,0)")).cast(
        f"decimal(18,{scale})")
    date = F.col("_date")
    if _dated_by(donations, order):
        # Any day is an int; an unknown one is the smallest long.
        date = F.date_from_unix_date(F.when(place != F.lit(_UNKNOWN), place).cast("int"))
    return F.struct(
        place.alias("_order"), date.alias("data_receita"), "cpf_cnpj_doador",
        worth.alias("valor_receita"))


def donor_loan_outcomes(
    candidates: DataFrame,
    donations: DataFrame,
    firm_totals: DataFrame,
    *,
    origin: str = CORPORATE_ORIGIN,
    accepted: Sequence[str] = ACCEPTED_REGISTRATION,
    match_nulls: bool = True,
    indicator: str = "first",
    order: str = "data_receita",
    salts: int = 1,
) -> DataFrame:
    """One row per candidate and election with corporate donations and the donors' loans.

    A donor's loans count once per donation in the sums and once in ``n_clients``. The row's
    donation columns belong to the first donation by ``order`` (then date, donor and value);
    ``indic_bndes`` says whether that donor has loans, or with ``indicator="any"`` whether any
    donor has. Candidates stay with positive donations and an accepted registration.
    ``firm_totals`` may hold firms that gave nothing.

    Donations are read once and combined per candidate and donor before they meet the loans, and
    per candidate and client name before they meet the candidates, once, with their attributes.
    """
    if indicator not in ("first", "any"):
        raise ValueError("indicator is 'first' or 'any'")
    attached = key_join(
        _packed_gifts(donations, origin, order), firm_totals,
        {"ano": "ano", "cpf_cnpj_doador": "cnpj"},
        match_nulls=("cpf_cnpj_doador",) if match_nulls else (),
        spread_by=("id_candidato_bd",), salts=salts,
    )
    if salts == 1:  # one shuffle for the clients, the candidates that they meet, and the sums
        attached = attached.repartition(*CANDIDATE)
    contracted = zero_if_missing(F.col("total_contratado"))
    disbursed = zero_if_missing(F.col("total_desembolsado"))
    first_row = F.struct(
        _first_gift(donations, order).alias("gift"), "tipo_eleicao",
        contracted.alias("total_contratado"), disbursed.alias("total_desembolsado"),
    )
    # One row per candidate and client name; donors without loans share the missing name.
    clients = attached.groupBy(*KEYS, "cliente").agg(
        F.sum("_value").alias("_value"),
        F.sum(F.col("_n") * contracted).alias("_c"),
        F.sum(F.col("_n") * disbursed).alias("_d"),
        F.min(first_row).alias("_first"),
        F.max(contracted).alias("_largest"),
    )
    # Only gifts to known candidates count; registration decides which row may be the first.
    attributes = [c for c in ATTRIBUTES if c in candidates.columns]
    known = candidates.select(
        *KEYS, F.col("situacao").isin(*accepted).alias("_accepted"),
        F.struct(*attributes).alias("_attributes"))
    of_candidates = key_join(
        clients, known, KEYS, how="inner", match_nulls=("tipo_eleicao",),
        spread_by=("cliente",), salts=salts)
    summed = of_candidates.groupBy(*CANDIDATE).agg(
        F.sum("_value").alias("total_donations"),
        F.sum("_c").alias("total_bndes_donors_c"),
        F.sum("_d").alias("total_bndes_donors_d"),
        F.countDistinct("cliente").alias("n_clients"),
        F.min(F.when(F.col("_accepted"), F.struct("_first", "_attributes"))).alias("_kept"),
        F.max("_largest").alias("_largest"),
    ).filter((F.col("total_donations") > 0) & F.col("_kept").isNotNull()).withColumn(
        "_row", F.col("_kept._first"))

    def average(total: str):
        # 0/0 counts as zero; clients are missing exactly when no donor has loans.
        return F.coalesce(
            F.try_divide(F.col(total).cast("double"), F.col("n_clients").cast("double")),
            F.lit(0.0),
        )

    loans_of = F.col("_row.total_contratado") if indicator == "first" else F.col("_largest")
    return summed.select(
        *CANDIDATE, "_row.tipo_eleicao", "total_donations", "total_bndes_donors_c",
        "total_bndes_donors_d", "n_clients",
        average("total_bndes_donors_c").alias("avg_bndes_donors_c"),
        average("total_bndes_donors_d").alias("avg_bndes_donors_d"),
        log_one_plus(average("total_bndes_donors_c")).alias("log_avg_c"),
        log_one_plus(average("total_bndes_donors_d")).alias("log_avg_d"),
        F.col("_row.gift.cpf_cnpj_doador").alias("cpf_cnpj_doador"),
        F.col("_row.gift.valor_receita").alias("valor_receita"),
        F.col("_row.gift.data_receita").alias("data_receita"),
        F.col("_row.total_contratado").alias("total_contratado"),
        F.col("_row.total_desembolsado").alias("total_desembolsado"),
        if_else(loans_of > 0, F.lit(1), F.lit(0)).alias("indic_bndes"),
        "_kept._attributes.*",
    )
