"""Registered queries: every operator over whole driver tables in the roles of the study."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotcredit import functions as fn
from ballotcredit.constants import AUTOMATIC, NON_AUTOMATIC
from ballotcredit.functions.numeric import format_pattern
from ballotcredit.operators import coalition as co
from ballotcredit.operators import (
    donors,
    joins,
    loans,
    margin,
    numbering,
    panel,
    rd,
    rd_bandwidth,
    rd_robust,
    rows,
    votes,
)
from ballotcredit.operators.candidates import candidate_frame
from ballotcredit.plans import channels
from ballotcredit.sources import readers, schemas, sinks
from ballotcredit.workload.roles import (
    BASE_SIZE,
    ELECTIONS,
    PARTY,
    STATUSES,
    YEARS_AFTER,
    Tables,
)

VOLUME_FROM, VOLUME_TO = 1996, 2000
MIXED = "Mista"
# Windows from April to March, which overlap.
DATE_WINDOWS = [(year, date(year, 4, 1), date(year + 2, 3, 31)) for year in range(1994, 1998)]
BANDWIDTH = 150000
SAMPLES = tuple(
    f"{name}{year}" for name in ("all", "pt", "pt_colig")
    for year in ("", *[f"_{y}" for y in ELECTIONS])
)
# Order 1 and 3, each with a fixed and a wider bandwidth, as in the printed tables.
COLUMNS = ((1, BANDWIDTH), (1, 200000), (3, BANDWIDTH), (3, 300000))
SPECS = rd.grid_specs({sample: COLUMNS for sample in SAMPLES})
LINEAR = [s for s in SPECS if s[2] == 1]
CUBIC = [s for s in SPECS if s[2] == 3]
# The first column of each sample with a wider pilot bandwidth.
ROBUST = rd_robust.with_pilots([s for s in SPECS if s[1] == 1], 1.5)


# Written municipality panels, which the regression queries share while the tables stay the same.
_PANELS: dict[tuple, DataFrame] = {}


def money(name: str, digits: int = 2):
    return F.round(F.col(name).cast("double"), digits).alias(name)


def _all_loans(t):
    return loans.loans_union(t["non_automatic"], t["automatic"])


def _order():
    """A position that both engines compute: later contracts first, then by state and place."""
    place = F.regexp_extract("uf", r"(\d+)", 1).cast("long") * 100 + F.regexp_extract(
        "municipio", r"(\d+)", 1).cast("long")
    return F.lit(10**9) - F.unix_date("data_da_contratacao").cast("long") * 10**4 + place


def _candidates(t):
    return candidate_frame(
        t["demographics"], t["voting"], first_year=1995
    )


def _running(t):
    return _candidates(t).filter(F.col("ano").isin(*ELECTIONS))


def _shares(t):
    return votes.municipal_vote_share(
        t["votes"], t["valid_votes"]
    )


def _base(t):
    return votes.electoral_base(_running(t), t["votes"], BASE_SIZE)


def _outcomes(t, fold_names=False):
    totals = sinks.written(loans.municipality_loan_totals(
        t["loans"], elections=ELECTIONS, years_after=YEARS_AFTER, fold_names=fold_names
    ))
    return votes.base_loan_outcomes(_base(t), totals)


def _donations(t):
    return t["revenue"].withColumn(
        "cpf_cnpj_doador", fn.parse_tax_id(F.col("cpf_cnpj_doador"))
    )


def _firm_loans(t):
    return t["non_automatic"].withColumn("cnpj", fn.parse_tax_id(F.col("cnpj")))


def _firm_windows(t):
    return loans.loans_in_election_window(_firm_loans(t), ELECTIONS, YEARS_AFTER)


def _firm_totals(t, **options):
    return donors.firm_loan_totals(
        _firm_loans(t), elections=ELECTIONS, years_after=YEARS_AFTER, **options)


def _municipality_panel(t, **options):
    return channels.municipality_panel(
        _candidates(t), t["votes"], t["loans"], t["coalition"],
        elections=ELECTIONS, years_after=YEARS_AFTER, base_size=BASE_SIZE, party=PARTY,
        statuses=STATUSES, **options,
    )


def _firm_panel(t, **options):
    return channels.firm_panel(
        _candidates(t), _donations(t), _firm_loans(t),
        t["coalition"], elections=ELECTIONS, years_after=YEARS_AFTER,
        party=PARTY, statuses=STATUSES, **options,
    )


def _samples(t):
    """The subsamples of the municipality panel, written once per session and state of the tables."""
    key = (t.spark.sparkContext.applicationId, *t.state())
    known = _PANELS.get(key)
    if known is None or not sinks.exists(known):
        _PANELS[key] = sinks.written(_municipality_panel(t, check=False))
    return panel.panel_subsamples(_PANELS[key], SAMPLES, BANDWIDTH, PARTY)


# --- descriptive -----------------------------------------------------------------------------

def _volume(t):
    return loans.loan_volume_by_type_year(_all_loans(t), VOLUME_FROM, VOLUME_TO)


def loan_volume_by_type_year(t):
    return _volume(t).select(
        "tipo_op", "ano", money("total_contratado"), money("total_desembolsado", 4), "n_operacoes",
        money("media_contratado"),
        F.round(F.col("var_contratado") / 1e6, 3).alias("var_contratado_mi"),
    )


def loan_table_wide_on(t):
    return loans.loan_table_wide(_volume(t)).withColumnsRenamed({
        f"{m}_{kind}": f"{m}_{short}"
        for m in ("total_contratado", "media_contratado", "n_operacoes")
        for kind, short in ((AUTOMATIC, "aut"), (NON_AUTOMATIC, "nao_aut"))
    })


def loan_measures_wide(t):
    wide = loans.pivot_measures(
        _volume(t), ["ano"], "tipo_op", (AUTOMATIC, NON_AUTOMATIC),
        ("total_desembolsado", "n_operacoes"),
    )
    return wide.select(
        "ano", *[
            F.round(F.col(f"`{m}_{kind}`").cast("double"), 4).alias(f"{m}_{short}")
            for m in ("total_desembolsado", "n_operacoes")
            for kind, short in ((AUTOMATIC, "aut"), (NON_AUTOMATIC, "nao_aut"))
        ]
    )


def loan_types_found(t):
    """Counts and sums by year and type, the types named by the data: a third one is among them."""
    quarter = F.month("data_da_contratacao") % 3 == 0
    mixed = _all_loans(t).withColumn(
        "tipo_op", F.when(quarter, F.lit(MIXED)).otherwise(F.col("tipo_op")))
    volume = loans.loan_volume_by_type_year(mixed, VOLUME_FROM, VOLUME_TO)
    wide = loans.pivot_measures(
        volume, ["ano"], "tipo_op", None, ("n_operacoes", "total_desembolsado"))
    return wide.select(
        "ano", *[
            F.round(F.col(f"`{m}_{kind}`").cast("double"), 4).alias(f"{m}_{short}")
            for m in ("n_operacoes", "total_desembolsado")
            for kind, short in ((AUTOMATIC, "aut"), (NON_AUTOMATIC, "nao_aut"), (MIXED, "mista"))
        ])


# --- loans -----------------------------------------------------------------------------------

def loans_union_types(t):
    return _all_loans(t).select(
        "tipo_op", "cliente", "cnpj", "uf",
        F.col("data_da_contratacao").cast("string").alias("data_da_contratacao"),
        money("valor_da_operacao_em_reais"), money("valor_desembolsado_reais", 4),
    )


def loans_in_election_window(t):
    return _firm_windows(t).select(
        "ano", "cliente", F.col("data_da_contratacao").cast("string").alias("data"),
        money("valor_desembolsado_reais", 4),
    )


def loans_in_date_windows(t):
    return loans.loans_in_date_windows(t["non_automatic"], DATE_WINDOWS).select(
        "ano", "cliente", F.col("data_da_contratacao").cast("string").alias("data"),
        money("valor_desembolsado_reais", 4),
    )


def _municipality_totals(t, **options):
    totals = loans.municipality_loan_totals(
        t["loans"], elections=ELECTIONS, years_after=YEARS_AFTER, **options)
    return totals.select(
        "ano", "municipio_codigo", "uf", "municipio", money("total_contratado"),
        money("total_desembolsado", 4),
    )


def municipality_loan_totals(t):
    return _municipality_totals(t)


def municipality_loan_totals_folded(t):
    return _municipality_totals(t, fold_names=True, skip_nulls=True)


def na_sum_injected(t):
    amounts = t["lineitem"].select(
        "l_partkey",
        F.when(F.col("l_quantity") != 50, F.col("l_extendedprice").cast("decimal(18,2)"))
        .alias("amount"),
    )
    return amounts.groupBy("l_partkey").agg(
        F.round(fn.na_sum(F.col("amount")).cast("double"), 2).alias("na_total"),
        F.round(fn.na_sum(F.col("amount"), skip_nulls=True).cast("double"), 2).alias("total"),
    )


# --- cleaning --------------------------------------------------------------------------------

def normalized_names(t):
    text = F.col("text")
    return t["documents"].select(
        "doc_id", fn.fold_accents(text).alias("folded"), fn.normalize_name(text).alias("name"),
        fn.letters_and_digits(text).alias("letters"),
    )


def normalized_turns(t):
    return t["conversations"].select(
        "conv_id", "turn", "role", fn.normalize_name(F.col("text")).alias("name")
    )


def stripped_punctuation(t):
    return t["documents"].select(
        "doc_id", fn.strip_punctuation(F.col("text")).alias("plain")
    )


def place_alias(t):
    """Birth places, some of them with the known misspelling."""
    wrong = F.when(F.col("c_custkey") % 3 == 0, F.lit("Mazag ão")).otherwise(F.col("c_name"))
    return t["customer"].select("c_custkey", fn.birth_place(wrong).alias("place"))


def tax_id_parse(t):
    return t["non_automatic"].select(
        "cnpj", fn.parse_tax_id(F.col("cnpj")).alias("id"),
        fn.tax_id_digits(F.col("cnpj")).alias("digits"),
    )


def decimal_comma_parse(t):
    comma = F.translate(format_pattern(F.col("l_extendedprice"), "#,##0.00"), ",.", ".,")
    text = F.when(F.col("l_quantity") == 1, F.lit("n/d")).otherwise(comma)
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", text.alias("text"),
        F.round(fn.parse_decimal(text).cast("double"), 2).alias("amount"),
    )


def magnitude_text(t):
    """Order values from cents to billions as short text."""
    scaled = F.floor(F.col("o_totalprice")) * F.when(
        F.col("o_orderpriority") == "1-URGENT", 100000).when(
        F.col("o_orderpriority") == "2-HIGH", 100).otherwise(1)
    return t["orders"].select(
        "o_orderkey", fn.magnitude(scaled).alias("text")
    )


# --- candidates and joins --------------------------------------------------------------------

def candidate_frame_on(t):
    return _candidates(t).select(
        "id_candidato_bd", "ano", "nome", "municipio_nascimento", "sigla_uf", "sigla_partido",
        "situacao", "votos", "resultado",
    )


def one_to_many_violations(t):
    """Line item keys that repeat and also occur in the orders."""
    lines = t["lineitem"].withColumnRenamed("l_orderkey", "key")
    orders = t["orders"].withColumnRenamed("o_orderkey", "key")
    return joins.one_to_many_violations(lines, orders, ["key"])


def candidate_number_violations(t):
    """Numbers with votes that several candidates of a year and segment would share."""
    numbered = _running(t).withColumn("numero_candidato", F.col("numero_candidato") % 1000)
    given = t["votes"].withColumn("nr_candidato", F.col("nr_candidato") % 1000)
    return joins.one_to_many_violations(numbered, given, {
        "ano": "ano", "sigla_uf": "sg_uf", "numero_candidato": "nr_candidato"})


def null_safe_left_join(t):
    firms = _firm_loans(t).groupBy("cnpj").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.sum("valor_desembolsado_reais").alias("disbursed"),
    )
    # Both a donor and a candidate may be hot, so the salt also depends on date and value.
    joined = joins.key_join(
        _donations(t), firms, {"cpf_cnpj_doador": "cnpj"}, match_nulls=["cpf_cnpj_doador"],
        spread_by=["id_candidato_bd", "data_receita", "valor_receita"], salts=8,
    )
    return joined.select(
        "id_candidato_bd", "ano", "cpf_cnpj_doador", "n_loans", money("disbursed")
    )


def null_safe_semi_join(t):
    """Loans of donors; unreadable ids on both sides match each other."""
    kept = joins.key_semi_join(
        _firm_loans(t), _donations(t), {"cnpj": "cpf_cnpj_doador"}, match_nulls=["cnpj"],
        spread_by=["data_da_contratacao", "valor_desembolsado_reais"], salts=8,
    )
    return kept.groupBy("cnpj").agg(F.count(F.lit(1)).alias("n_loans"))


def first_row_per_candidate(t):
    first = rows.first_row_per_key(
        _donations(t), ["id_candidato_bd", "ano"],
        ["data_receita", "cpf_cnpj_doador", F.col("valor_receita").desc_nulls_last()],
    )
    return first.select(
        "id_candidato_bd", "ano", F.col("data_receita").cast("string").alias("data_receita"),
        "cpf_cnpj_doador", money("valor_receita", 4),
    )


# --- municipality channel --------------------------------------------------------------------

def municipal_vote_share(t):
    return _shares(t).select(
        "ano", "sg_uf", "nr_candidato", "municipio", "qt_votos_nom_validos", "qt_votos_mun",
        money("vot_prop_mun", 9),
    )


def electoral_base_topk(t):
    return _base(t).select(
        "id_candidato_bd", "ano", "sigla_uf", "municipio", "qt_votos_nom_validos", "votos",
        money("vot_prop_cand", 12),
    )


def _outcome_columns(df):
    return df.select(
        "id_candidato_bd", "ano", "sigla_uf", "sigla_partido", "votos", "resultado",
        money("total_contratado_base"), money("total_desembolsado_base", 4), money("log_c", 6),
        money("log_d", 6), money("vot_prop_cand", 12),
    )


def base_loan_outcomes(t):
    return _outcome_columns(_outcomes(t))


def base_loan_outcomes_folded(t):
    return _outcome_columns(_outcomes(t, fold_names=True))


# --- firm channel ----------------------------------------------------------------------------

def donor_loan_totals(t):
    totals = donors.donor_loan_totals(
        _firm_loans(t), _donations(t), _running(t), elections=ELECTIONS, years_after=YEARS_AFTER)
    return totals.select(
        "ano", "cnpj", "cliente", "uf", "municipio", money("total_contratado"),
        money("total_desembolsado", 4),
    )


def _donor_columns(df):
    return df.select(
        "id_candidato_bd", "ano", money("total_donations", 4), money("total_bndes_donors_c"),
        money("total_bndes_donors_d", 4), "n_clients", "avg_bndes_donors_c",
        "avg_bndes_donors_d", money("log_avg_c", 6), money("log_avg_d", 6),
        "cpf_cnpj_doador", money("valor_receita", 4),
        F.col("data_receita").cast("string").alias("data_receita"),
        money("total_contratado"), "indic_bndes", "sigla_uf", "sigla_partido", "votos",
    )


def donor_loan_outcomes(t):
    given = _donations(t).filter(F.col("ano").isin(*ELECTIONS))
    return _donor_columns(donors.donor_loan_outcomes(_running(t), given, _firm_totals(t)))


def donor_loan_outcomes_any(t):
    given = _donations(t).filter(F.col("ano").isin(*ELECTIONS))
    return _donor_columns(donors.donor_loan_outcomes(
        _running(t), given, _firm_totals(t, skip_nulls=True), match_nulls=False, indicator="any"
    ))


# --- coalition, margin, panel ----------------------------------------------------------------

def coalition_map(t):
    return co.coalition_map(t["coalition"])


def _with_coalition(t, **options):
    return co.with_coalition(
        _running(t), t["coalition"], PARTY, **options
    ).select("id_candidato_bd", "ano", "sigla_uf", "sigla_partido", "resultado", "votos",
             "colig", "colig_pt", "is_colig_pt")


def party_coalition_flag(t):
    return _with_coalition(t)


def party_coalition_flag_unfilled(t):
    return _with_coalition(t, fill_before_flag=False)


def vote_margin(t):
    return margin.vote_margin(_with_coalition(t), STATUSES)


def vote_margin_consistent(t):
    return margin.vote_margin(
        _with_coalition(t), STATUSES, margin_statuses=None, drop_ties=False
    )


def _panel_columns(df, outcomes):
    return df.select(
        "id_candidato_bd", "ano", "sigla_uf", "sigla_partido", "colig", "is_colig_pt",
        "elected", "votos", "min_votos_win", "max_votos_loss", "vote_margin",
        "abs_vote_margin", *[money(c, 6) for c in outcomes], "factor_cluster", "factor_uf",
    )


def pooled_panel(t):
    return _panel_columns(_municipality_panel(t), ("log_c", "log_d"))


def municipality_panel_of_files(t):
    """The panel from both loan tables, where a row order says which loan and vote come first."""
    both = loans.loans_union(
        t["non_automatic"].withColumn("posicao", _order()),
        t["automatic"].withColumn("posicao", _order()), "posicao")
    given = t["votes"].withColumn(
        "posicao", -F.regexp_extract("nm_municipio", r"(\d+)", 1).cast("long"))
    made = channels.municipality_panel(
        _candidates(t), given, both, t["coalition"], elections=ELECTIONS,
        years_after=YEARS_AFTER, base_size=BASE_SIZE, party=PARTY, statuses=STATUSES,
        loan_order="posicao", vote_order="posicao")
    return _panel_columns(made, ("log_c", "log_d"))


def municipality_first_rows(t):
    """Totals per spelling, whose state is the one of the first row in a stated order."""
    ordered = t["loans"].withColumn("posicao", _order()).withColumn(
        "uf", F.concat("uf", F.lit("/"), F.month("data_da_contratacao")))
    return loans.municipality_loan_totals(
        ordered, elections=ELECTIONS, years_after=YEARS_AFTER, order="posicao"
    ).select("ano", "municipio_codigo", "municipio", "uf", money("total_contratado"))


def pooled_panel_strict_union(t):
    """Panels of one election each under one layout."""
    candidates = _candidates(t)
    single = [
        channels.municipality_panel(
            candidates, t["votes"], t["loans"], t["coalition"], elections=(year,),
            years_after=YEARS_AFTER, base_size=BASE_SIZE, party=PARTY, statuses=STATUSES,
            check=False).drop("factor_cluster", "factor_uf")
        for year in ELECTIONS
    ]
    return _panel_columns(panel.pooled_panel(*single), ("log_c", "log_d"))


def pooled_panel_firms(t):
    return _panel_columns(_firm_panel(t), ("log_avg_c", "log_avg_d"))


def panel_subsamples(t):
    return panel.panel_subsamples(
        _municipality_panel(t), (*SAMPLES, "reg"), BANDWIDTH, PARTY
    ).select("sample", "id_candidato_bd", "ano", "elected", "elected_label", "vote_margin")


def panel_in_reading_order(t):
    """The panel in reading order with each row's position within its election.

    Rows that tie keep any order among them, so a tied row shows the first of its positions.
    """
    read = numbering.with_rank(
        _municipality_panel(t, check=False), ["colig", "votos"], "position", within=["ano"])
    return panel.inspection_order(read).select(
        "ano", "colig", "votos", "id_candidato_bd", "vote_margin", "position")


def state_factor(t):
    listed = _with_coalition(t)
    levels = numbering.factor_levels(listed, "sigla_uf", "code")
    coded = joins.key_join(listed, levels, ["sigla_uf"])
    return coded.groupBy("sigla_uf", "code").agg(F.count(F.lit(1)).alias("n"))


# --- regression discontinuity ----------------------------------------------------------------

def rd_effective_counts(t):
    return rd.rd_effective_counts(_samples(t), SPECS)


def rd_local_linear(t):
    jumps = rd.rd_local_polynomial(_samples(t), "log_c", LINEAR)
    return jumps.select(*rd.KEYS, money("intercept_left", 5), money("intercept_right", 5),
                        money("estimate", 5))


def rd_local_cubic(t):
    jumps = rd.rd_local_polynomial(_samples(t), "log_c", CUBIC)
    return jumps.select(*rd.KEYS, money("intercept_left", 4), money("intercept_right", 4),
                        money("estimate", 4))


def rd_std_error(t):
    errors = rd.rd_std_error(_samples(t), "log_c", LINEAR)
    return errors.select(*rd.KEYS, money("estimate", 5), money("std_error", 5), "n_left",
                         "n_right")


def _robust(errors):
    return errors.select(
        *rd_robust.KEYS, money("estimate", 5), money("estimate_bc", 5), money("std_error", 5),
        money("robust_error", 5), "n_left", "n_right")


def rd_robust_error(t):
    return _robust(rd_robust.rd_robust_error(_samples(t), "log_c", ROBUST))


def rd_neighbour_error(t):
    return _robust(rd_robust.rd_neighbour_error(_samples(t), "log_c", ROBUST))


def rd_bandwidth_rule(t):
    found = rd_bandwidth.rd_bandwidth(_samples(t), "log_c")
    return found.select(
        "sample", money("bandwidth", 1), F.round(F.col("density") * 1e6, 6).alias("density_mi"),
        money("noise_left", 6), money("noise_right", 6), "n_left", "n_right")


def rd_result_grid(t):
    grid = rd.rd_result_grid(_samples(t), "log_c", SPECS)
    return grid.select("sample", "spec", money("estimate", 4), "stars", money("std_error", 4),
                       "n_left", "n_right", "bandwidth", "order", "kernel")


def rd_result_grid_firms(t):
    samples = panel.panel_subsamples(_firm_panel(t), SAMPLES, BANDWIDTH, PARTY)
    grid = rd.rd_result_grid(samples, "log_avg_c", SPECS)
    return grid.select("sample", "spec", money("estimate", 4), "stars", money("std_error", 4),
                       "n_left", "n_right", "bandwidth", "order", "kernel")


def rd_table_layout(t):
    grid = rd.rd_result_grid(_samples(t), "log_c", SPECS)
    return rd.rd_table_layout(grid, len(COLUMNS)).withColumnsRenamed(
        {f"({i})": f"spec_{i}" for i in range(1, 5)}
    )


# --- sources and sinks -----------------------------------------------------------------------

def loan_file_scan(t):
    """Loans written as semicolon files with decimal commas in Latin-1, read back and summed."""
    comma = F.translate(format_pattern(F.col("valor_contratado_reais"), "#,##0.00"), ",.", ".,")
    folder = sinks.work_folder(t.spark)
    text = t["non_automatic"].select(
        "cliente", "cnpj", "municipio", "uf",
        F.col("municipio_codigo").cast("string").alias("municipio_codigo"), "data_da_contratacao",
        F.lit("extra").alias("area_operacional"), comma.alias("valor_contratado_reais"),
        F.translate(F.col("valor_desembolsado_reais").cast("decimal(18,2)").cast("string"),
                    ".", ",").alias("valor_desembolsado_reais"),
    )
    sinks.write_csv(text, folder, sep=";", encoding="ISO-8859-1")
    read = readers.read_delimited(
        t.spark, folder, schemas.NON_AUTOMATIC_LOANS, sep=";", decimal_mark=",",
        grouping_mark=".", encoding="ISO-8859-1", doubled_quotes=False,
    )
    return read.groupBy(
        "uf", "municipio", "municipio_codigo", F.year("data_da_contratacao").alias("ano")).agg(
        F.round(F.sum("valor_contratado_reais").cast("double"), 2).alias("contracted"),
        F.round(F.sum("valor_desembolsado_reais").cast("double"), 2).alias("disbursed"),
        F.count("valor_contratado_reais").alias("n_known"), F.count(F.lit(1)).alias("n"),
    )


def coalition_file_scan(t):
    """Coalitions written as one Latin-1 file per election and read back by their reader."""
    folder = sinks.work_folder(t.spark)
    paths = {}
    for year in ELECTIONS:
        paths[year] = f"{folder}/{year}"
        sinks.write_csv(t["coalition"].filter(F.col("ano") == year).drop("ano"), paths[year],
                        sep=";", encoding="ISO-8859-1")
    read = readers.read_coalitions(t.spark, paths)
    return read.groupBy("ano", "sg_uf", "sg_partido", "ds_composicao_coligacao").agg(
        F.count(F.lit(1)).alias("n"), F.sum("nr_candidato").alias("numbers"))


def disbursement_file_scan(t):
    """Disbursements without grouping marks written as text and read back by their reader."""
    folder = sinks.work_folder(t.spark)
    text = t["automatic"].select("cliente", "uf", F.translate(
        F.col("valor_desembolsado_reais").cast("string"), ".", ",").alias("valor"))
    sinks.write_csv(text, folder, sep=";")
    read = readers.read_disbursements(
        t.spark, folder, {"cliente": "string", "uf": "string", "valor": "decimal(18,4)"})
    return read.groupBy("cliente", "uf").agg(
        F.round(F.sum("valor").cast("double"), 4).alias("disbursed"), F.count("valor").alias("n"))


def report_file_scan(t):
    """The formatted report table written as a file and read back."""
    folder = sinks.work_folder(t.spark)
    report = loan_table_wide_on(t)
    sinks.write_report(report, folder)
    types = {c: "int" if c == "ano" else "string" for c in report.columns}
    return readers.read_delimited(t.spark, folder, types)


def quoted_file_scan(t):
    """Texts with line breaks and quotes written as cells, their records found in all splits."""
    folder = sinks.work_folder(t.spark)
    sinks.write_csv(t["documents"].select("doc_id", "source", "text"), folder)
    read = readers.read_delimited(
        t.spark, folder, {"doc_id": "bigint", "source": "string", "text": "string"},
        multi_line=readers.SPLITS)
    # Words, and lines that hold one: white space at a text's ends is not kept in a file.
    words, lines = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D][^\n]*"
    return read.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"),
        F.sum(F.regexp_count("text", F.lit(words))).cast("long").alias("words"),
        F.sum(F.regexp_count("text", F.lit(lines))).cast("long").alias("lines"))


def vote_files_by_year(t):
    """Votes written as one comma file per election and read back as one table."""
    folder = sinks.work_folder(t.spark)
    paths = {}
    for year in ELECTIONS:
        paths[year] = f"{folder}/{year}"
        of_year = t["votes"].filter(F.col("ano") == year).drop("ano")
        sinks.write_csv(
            of_year.withColumn("ds_composicao_coligacao", F.lit(None).cast("string")),
            paths[year],
        )
    read = readers.read_municipal_votes(t.spark, paths)
    return read.groupBy("ano", "sg_uf", "nm_municipio").agg(
        F.sum("qt_votos_nom_validos").alias("votes"), F.count(F.lit(1)).alias("n"),
        F.count("ds_composicao_coligacao").alias("n_listed"),
    )


def snapshot_by_year(t):
    """Candidate results written as a partitioned snapshot, read back with partition pruning."""
    folder = sinks.work_folder(t.spark)
    sinks.snapshot(t["voting"], folder)
    read = readers.read_table(t.spark, folder).filter(F.col("ano").isin(*ELECTIONS))
    return read.groupBy("ano", "resultado").agg(
        F.sum("votos").alias("votos"), F.count(F.lit(1)).alias("n")
    )


def panel_folders(t):
    """Both channels' panels written below one folder and read back as one table."""
    folder = sinks.work_folder(t.spark)
    columns = ("id_candidato_bd", "ano", "vote_margin", "elected")
    sinks.write_panel(
        _municipality_panel(t).select(*columns), folder, channels.MUNICIPALITY
    )
    sinks.write_panel(_firm_panel(t).select(*columns), folder, channels.FIRM)
    return t.spark.read.parquet(folder).groupBy("canal", "ano").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vote_margin").alias("margins"),
        F.sum("elected").alias("elected"),
    )


def panel_one_year_again(t):
    """A panel of all elections but the last, to which the last is added and one written again."""
    folder = sinks.work_folder(t.spark)
    whole = _municipality_panel(t).select("id_candidato_bd", "ano", "vote_margin", "elected")
    sinks.write_panel(whole.where(F.col("ano") < ELECTIONS[-1]), folder, channels.MUNICIPALITY)
    for year in (ELECTIONS[-1], ELECTIONS[0]):
        sinks.write_panel(whole, folder, channels.MUNICIPALITY, elections=[year])
    return t.spark.read.parquet(folder).groupBy("canal", "ano").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vote_margin").alias("margins"),
        F.sum("elected").alias("elected"),
    )


def _on_tables(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Tables(spark, sf_dir))

    return run


QUERIES = {
    f.__name__.removesuffix("_on"): _on_tables(f)
    for f in (
        loan_volume_by_type_year, loan_table_wide_on, loan_measures_wide, loans_union_types,
        loans_in_election_window, municipality_loan_totals, municipality_loan_totals_folded,
        na_sum_injected, normalized_names, normalized_turns, stripped_punctuation, tax_id_parse,
        decimal_comma_parse, magnitude_text, candidate_frame_on, one_to_many_violations,
        null_safe_left_join, null_safe_semi_join, first_row_per_candidate, municipal_vote_share,
        electoral_base_topk, base_loan_outcomes, base_loan_outcomes_folded, donor_loan_totals,
        donor_loan_outcomes, donor_loan_outcomes_any, coalition_map, party_coalition_flag,
        party_coalition_flag_unfilled, vote_margin, vote_margin_consistent, pooled_panel,
        pooled_panel_firms, panel_subsamples, state_factor, rd_effective_counts,
        rd_local_linear, rd_local_cubic, rd_std_error, rd_robust_error, rd_neighbour_error,
        rd_bandwidth_rule, rd_result_grid, rd_result_grid_firms, rd_table_layout, loan_file_scan,
        report_file_scan,
        panel_in_reading_order,
        vote_files_by_year, snapshot_by_year, panel_folders, candidate_number_violations,
        municipality_panel_of_files, municipality_first_rows, pooled_panel_strict_union,
        place_alias, coalition_file_scan, disbursement_file_scan, quoted_file_scan,
        panel_one_year_again, loans_in_date_windows, loan_types_found,
    )
}
