"""Votes, donors, coalitions and margins on hand-made rows, one per trap."""

import math
from datetime import date
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ballotcredit import functions as fn
from ballotcredit.constants import CORPORATE_ORIGIN
from ballotcredit.operators import coalition as co
from ballotcredit.operators import donors, votes
from ballotcredit.operators.candidates import candidate_frame
from ballotcredit.operators.loans import loans_in_election_window
from ballotcredit.operators.margin import vote_margin
from ballotcredit.plans import channels

# --- candidates ------------------------------------------------------------------------------


def test_candidate_frame(table):
    people = table(
        "id_candidato_bd string, ano int, tipo_eleicao string, cargo string, email string, "
        "municipio_nascimento string, nome string",
        ("1", 2006, "o", "deputado federal", "e", "Mazag ão", "left"),
        (None, 2006, "o", "deputado federal", "e", "x", "no id"),
        ("2", 2006, "o", "senador", "e", "x", "other office"),
        ("3", 1998, "o", "deputado federal", "e", "x", "too early"),
        ("4", 2006, None, "deputado federal", "e", None, "no result"),
        ("5", 2006, None, "deputado federal", "e", None, "kind missing twice"))
    results = table(
        "id_candidato_bd string, ano int, tipo_eleicao string, votos long, nome string",
        ("1", 2006, "o", 10, "right"), ("5", 2006, None, 7, "right"))
    got = candidate_frame(people, results)
    assert "email" not in got.columns and got.columns.count("nome") == 1
    assert rows(got.select("id_candidato_bd", "nome", "municipio_nascimento", "votos")) == [
        ("1", "left", "MAZAGAO", 10), ("4", "no result", None, None),
        ("5", "kind missing twice", None, 7)]


# --- electoral base --------------------------------------------------------------------------

CANDIDATE = ("id_candidato_bd string, ano int, sigla_uf string, numero_candidato int, "
             "votos long, situacao string, nome string")
VOTES = ("ano int, sg_uf string, nr_candidato int, nm_municipio string, "
         "qt_votos_nom_validos long")


def test_base_keeps_ties_and_ids_with_several_rows(table):
    people = table(CANDIDATE, ("1", 2006, "SP", 10, 100, "deferido", "a"),
                   ("2", 2006, "SP", 20, 100, "deferido", "b"),
                   ("2", 2006, "SP", 21, 10, "deferido", "b, second row"))
    counts = [("A", 20), ("B", 15), ("C", 12), ("D", 10), ("E", 5), ("F", 5), ("G", 4)]
    given = table(VOTES, *[(2006, "SP", 10, m, q) for m, q in counts],
                  *[(2006, "SP", 20, m, q) for m, q in counts],
                  *[(2006, "SP", 21, m, 9) for m in "XY"])
    got = votes.electoral_base(people, given)
    sizes = rows(got.groupBy("id_candidato_bd").agg(F.collect_list("nm_municipio").alias("m")))
    assert [sorted(m) for _, m in sizes] == [
        ["A", "B", "C", "D", "E", "F"], ["A", "B", "C", "X", "Y"]]


def test_base_without_votes(table):
    people = table(CANDIDATE, ("1", 2006, "SP", 10, 0, "deferido", "a"),
                   ("2", 2006, "SP", 20, None, "deferido", "b"),
                   ("3", 2006, None, 30, 10, "deferido", "state missing on both sides"))
    given = table(VOTES, (2006, "SP", 10, "A", 0), (2006, "SP", 10, "B", 3),
                  (2006, "SP", 20, "A", 3), (2006, None, 30, "A", 3), (2006, None, 30, "B", 0),
                  (2006, None, 30, "C", None))
    got = votes.electoral_base(people, given)
    assert rows(got.select("id_candidato_bd", "nm_municipio", "vot_prop_cand")) == [
        ("3", "A", 0.3)]


def test_vote_share_of_the_municipality(table):
    given = table(VOTES, (2006, "SP", 1, "São João", 5), (2006, "SP", 1, "Sao Joao", 5),
                  (2010, "SP", 1, "São João", 5))
    totals = table("ano int, uf string, nm_municipio string, qt_votos_mun long",
                   (2006, "SP", "São João", 20), (2010, "SP", "São João", 0))
    got = votes.municipal_vote_share(given, totals)
    assert rows(got.select("ano", "nm_municipio", "municipio", "vot_prop_mun")) == [
        (2006, "Sao Joao", "SAOJOAO", None), (2006, "São João", "SAOJOAO", 0.25),
        (2010, "São João", "SAOJOAO", None)]


def test_base_loans(table):
    base = table(
        CANDIDATE + ", nm_municipio string, municipio string, vot_prop_cand double",
        ("1", 2006, "SP", 10, 9, "deferido", "a", "x", "X", 0.2),
        ("1", 2006, "SP", 10, 9, "deferido", "a", "y", "Y", 0.5),
        ("1", 2006, "SP", 10, 9, "deferido", "a", "u", "U", 0.1),
        ("2", 2006, "SP", 20, 9, "indeferido", "b", "x", "X", 0.2),
        ("3", 2010, "SP", 30, 9, "deferido com recurso", "c", "x", "X", 0.2))
    totals = table(
        "ano int, municipio_codigo long, uf string, municipio string, "
        "total_contratado decimal(28,2), total_desembolsado decimal(28,2)",
        (2006, 1, "SP", "X", Decimal(10), Decimal(1)),
        (2006, 2, "SP", "Y", None, Decimal(4)),       # unknown total counts as zero
        (2006, 3, "SP", "X", Decimal(100), None),     # a name with two codes counts both
        (2006, 4, "RJ", "U", Decimal(7), Decimal(7)))
    got = votes.base_loan_outcomes(base, totals)
    assert rows(got.select("id_candidato_bd", "ano", "total_contratado_base",
                           "total_desembolsado_base", "vot_prop_cand", "nome")) == [
        ("1", 2006, 110, 5, 0.5, "a"), ("3", 2010, 0, 0, 0.2, "c")]
    assert [r[0] for r in rows(got.select("log_c"))] == [0.0, math.log(111)]


# --- donors ----------------------------------------------------------------------------------

LOANS = ("ano int, cnpj bigint, cliente string, uf string, municipio string, "
         "data_da_contratacao date, valor_contratado_reais decimal(18,2), "
         "valor_desembolsado_reais decimal(18,2)")
GIFTS = ("id_candidato_bd string, ano int, tipo_eleicao string, cpf_cnpj_doador bigint, "
         "valor_receita decimal(18,2), data_receita date, origem_receita string")
PJ = "recursos de pessoas juridicas"


def firm(cnpj, amount, client="firm", day=1):
    value = None if amount is None else Decimal(amount)
    return (2006, cnpj, client, "SP", "M", date(2006, 1, day), value, Decimal(1))


def gift(candidate, donor, value, day=1, origin=PJ):
    amount = None if value is None else Decimal(value)
    return (candidate, 2006, "o", donor, amount, date(2006, 1, day), origin)


def running(table, *people):
    return table("id_candidato_bd string, ano int, tipo_eleicao string, situacao string, "
                 "nome string, cpf string", *people)


def test_donor_totals_match_missing_ids_only_in_parity(table):
    loans = table(LOANS, firm(5, 10, "b", 2), firm(5, 7, "a", 3), firm(6, 1), firm(None, 4),
                  firm(8, None), firm(8, 3))
    given = table(GIFTS, gift("1", 5, 1), gift("1", None, 1), gift("1", 8, 1))
    columns = ("cnpj", "cliente", "total_contratado", "total_desembolsado")
    parity = donors.donor_loan_totals(loans, given)
    assert rows(parity.select(*columns)) == [
        (None, "firm", 4, 1), (5, "b", 17, 2), (8, "firm", None, 2)]
    strict = donors.donor_loan_totals(loans, given, match_nulls=False, skip_nulls=True)
    assert rows(strict.select(*columns)) == [(5, "b", 17, 2), (8, "firm", 3, 2)]


def outcomes(table, gifts, loans, people=None, **options):
    people = people or running(table, ("1", 2006, "o", "deferido", "a", "x"))
    given = table(GIFTS, *gifts)
    totals = donors.donor_loan_totals(table(LOANS, *loans), given)
    return donors.donor_loan_outcomes(people, given, totals, **options)


def test_repeated_donor_counts_per_donation_and_once_as_client(table):
    got = outcomes(table, [gift("1", 5, 100), gift("1", 5, 50, 2), gift("1", 6, None, 3)],
                   [firm(5, 10), firm(6, 4, "other")])
    row = got.first()
    assert (row.total_donations, row.total_bndes_donors_c, row.n_clients) == (150, 24, 2)
    assert row.avg_bndes_donors_c == 12.0 and row.log_avg_c == math.log(13)
    assert (row.cpf_cnpj_doador, row.valor_receita, row.data_receita) == (
        5, 100, date(2006, 1, 1))


def test_indicator_looks_at_the_first_donation(table):
    gifts = [gift("1", 9, 1, 1), gift("1", 5, 1, 2)]
    assert outcomes(table, gifts, [firm(5, 10)]).first().indic_bndes == 0
    assert outcomes(table, gifts, [firm(5, 10)], indicator="any").first().indic_bndes == 1
    with pytest.raises(ValueError):
        outcomes(table, gifts, [firm(5, 10)], indicator="last")


def test_no_matching_firm_gives_zero_average(table):
    row = outcomes(table, [gift("1", 9, 1)], [firm(5, 10)]).first()
    assert (row.n_clients, row.avg_bndes_donors_c, row.log_avg_c) == (0, 0.0, 0.0)


def test_who_stays(table):
    people = running(table, ("1", 2006, "o", "indeferido", "refused", None),
                     ("2", 2006, "o", "deferido", "no money", None),
                     ("3", 2006, "o", "deferido", "persons only", None),
                     ("4", 2006, "o", "deferido com recurso", "stays", None))
    got = outcomes(table, [gift("1", 5, 1), gift("2", 5, 0), gift("2", 5, None),
                           gift("3", 5, 9, origin="recursos de pessoas fisicas"),
                           gift("4", 5, 2), gift("unknown", 5, 2)], [firm(5, 10)], people)
    assert rows(got.select("id_candidato_bd", "nome")) == [("4", "stays")]
    assert "cpf" not in got.columns


def test_first_row_comes_from_an_accepted_registration(table):
    people = running(table, ("1", 2006, "o", "indeferido", "a", None),
                     ("1", 2006, "s", "deferido", "a, second election", None))
    given = table(GIFTS, gift("1", 5, 10),
                  ("1", 2006, "s", 6, Decimal(3), date(2006, 5, 5), PJ))
    totals = donors.donor_loan_totals(table(LOANS, firm(5, 10), firm(6, 0, "z")), given)
    row = donors.donor_loan_outcomes(people, given, totals).first()
    assert (row.total_donations, row.total_bndes_donors_c, row.n_clients) == (13, 10, 2)
    assert (row.tipo_eleicao, row.cpf_cnpj_doador, row.indic_bndes) == ("s", 6, 0)


# --- coalition and margin ----------------------------------------------------------------------

LISTS = "ano int, sg_uf string, sg_partido string, ds_composicao_coligacao string"
PEOPLE = "id_candidato_bd string, ano int, sigla_uf string, sigla_partido string"


def test_flag_order(table):
    lists = table(LISTS, (2006, "SP", "PT", "PT / PC"), (2006, "SP", "PC", "PT / PC"),
                  (2006, "SP", "PX", None), (2006, "RJ", "PT", None), (2006, "SP", "PT", "PT / PC"))
    people = table(PEOPLE, ("1", 2006, "SP", "PC"), ("2", 2006, "SP", "PX"),
                   ("3", 2006, "SP", "absent"), ("4", 2006, "RJ", "PT"), ("5", 2010, "SP", "PT"))
    columns = ("id_candidato_bd", "colig", "is_colig_pt")
    filled = co.with_coalition(people, lists).select(*columns)
    assert rows(filled) == [("1", "PT / PC", 1), ("2", "PX", 0), ("3", "absent", 0),
                            ("4", "PT", None), ("5", "PT", None)]
    unfilled = co.with_coalition(people, lists, fill_before_flag=False).select(*columns)
    assert rows(unfilled) == [("1", "PT / PC", 1), ("2", "PX", None), ("3", "absent", None),
                              ("4", "PT", None), ("5", "PT", None)]


def test_party_with_two_lists_fans_out(table):
    lists = table(LISTS, (2006, "SP", "PC", "A"), (2006, "SP", "PC", "B"))
    people = table(PEOPLE, ("1", 2006, "SP", "PC"))
    got = co.with_coalition(people, lists).select("id_candidato_bd", "colig")
    assert rows(got) == [("1", "A"), ("1", "B")]


RESULTS = ("id_candidato_bd string, ano int, sigla_uf string, colig string, "
           "resultado string, votos long")


def results(year, *people, uf="SP", colig="L"):
    return [(f"{year}-{i}", year, uf, colig, r, v) for i, (r, v) in enumerate(people)]


def margins(df, **options):
    got = vote_margin(df, **options).select("id_candidato_bd", "elected", "vote_margin")
    return rows(got)


def test_winner_codes_depend_on_the_year(table):
    same = [("eleito por qp", 90), ("eleito por media", 70), ("suplente", 50)]
    df = table(RESULTS, *results(2014, *same),
               *results(2010, ("eleito", 90), ("eleito por qp", 80), ("suplente", 50)))
    # The margin tests the usual codes in every year: a 2014 quotient winner is measured
    # from the last winner.
    assert margins(df) == [
        ("2010-0", 1, 10), ("2010-1", 0, -10), ("2010-2", 0, -40),
        ("2014-0", 1, 20), ("2014-1", 1, 20), ("2014-2", 0, -20)]
    assert margins(df, margin_statuses=None)[3:] == [
        ("2014-0", 1, 40), ("2014-1", 1, 20), ("2014-2", 0, -20)]


def test_lists_without_winners_or_losers(table):
    df = table(RESULTS, *results(2006, ("eleito", 9), ("eleito", 8), colig="all win"),
               *results(2010, ("suplente", 9), ("suplente", 8), colig="none wins"),
               *results(2014, ("eleito por qp", 9), ("eleito por media", 8), colig="all win"))
    assert margins(df) == [("2014-0", 1, 1)]
    assert margins(df, margin_statuses=None) == []
    assert margins(df, drop_ties=False) == [
        ("2006-0", 1, None), ("2006-1", 1, None), ("2014-0", 1, 1), ("2014-1", 1, None)]


def test_ties_unknown_results_and_missing_keys(table):
    df = table(RESULTS,
               *results(2006, ("eleito", 5), ("suplente", 5), (None, 9), ("suplente", 2)),
               *results(2010, ("eleito", 7), ("suplente", 4), uf=None, colig=None))
    assert margins(df) == [("2006-3", 0, -3), ("2010-0", 1, 3), ("2010-1", 0, -3)]


# --- whole channels ----------------------------------------------------------------------------

def test_both_channels_end_to_end(table):
    people = table(
        CANDIDATE + ", tipo_eleicao string, sigla_partido string, resultado string",
        ("1", 2006, "SP", 10, 100, "deferido", "a", "o", "PT", "eleito"),
        ("2", 2006, "SP", 20, 40, "deferido", "b", "o", "PT", "suplente"),
        ("3", 2006, "SP", 30, 30, "deferido", "c", "o", "PC", "suplente"))
    lists = table(LISTS, (2006, "SP", "PT", "PT / PC"), (2006, "SP", "PC", "PT / PC"))
    given = table(VOTES, (2006, "SP", 10, "São João", 60), (2006, "SP", 20, "Santos", 40),
                  (2006, "SP", 30, "São João", 30))
    credit = table(
        "cliente string, cnpj string, uf string, municipio string, municipio_codigo long, "
        "data_da_contratacao date, valor_da_operacao_em_reais decimal(18,2), "
        "valor_contratado_reais decimal(18,2), valor_desembolsado_reais decimal(18,2)",
        ("f", "00.005", "SP", "SAO JOAO", 1, date(2008, 1, 1), Decimal(99), Decimal(99),
         Decimal(9)),
        ("f", "00.005", "SP", "SAO JOAO", 1, date(2011, 1, 1), Decimal(1), Decimal(1), None))
    cities = channels.municipality_panel(people, given, credit, lists)
    assert rows(cities.select("id_candidato_bd", "vote_margin", "total_contratado_base",
                              "is_colig_pt", "factor_cluster")) == [
        ("1", 60, 99, 1, "2006.SP.PT / PC"), ("2", -60, 0, 1, "2006.SP.PT / PC"),
        ("3", -70, 99, 1, "2006.SP.PT / PC")]
    gifts = table(GIFTS, gift("1", 5, 10), gift("2", 7, 10))
    firms = credit.withColumn("cnpj", fn.parse_tax_id(F.col("cnpj")))
    donor_panel = channels.firm_panel(people, gifts, firms, lists)
    assert rows(donor_panel.select("id_candidato_bd", "vote_margin", "total_bndes_donors_c",
                                   "indic_bndes")) == [("1", 60, 99, 1), ("2", -60, 0, 0)]


def test_windows_cover_the_loan_of_two_elections(table):
    df = table("cnpj bigint, data_da_contratacao date", (1, date(2010, 6, 1)))
    assert rows(loans_in_election_window(df).select("ano")) == [(2006,), (2010,)]


# --- required checks, donors and plans -------------------------------------------------------

def test_two_candidates_on_one_number_raise(table):
    people = table(CANDIDATE, ("1", 2006, "SP", 10, 100, "deferido", "a"),
                   ("2", 2006, "SP", 10, 100, "deferido", "b"))
    given = table(VOTES, (2006, "SP", 10, "A", 5))
    credit = table("municipio_codigo long, municipio string, uf string, data_da_contratacao date, "
                   "valor_da_operacao_em_reais decimal(18,2), "
                   "valor_desembolsado_reais decimal(18,2)")
    lists = table("ano int, sg_uf string, sg_partido string, ds_composicao_coligacao string")
    with pytest.raises(ValueError, match="several left rows"):
        channels.municipality_panel(people, given, credit, lists)


def test_donors_come_from_the_candidates(table):
    people = running(table, ("1", 2006, "o", "deferido", "a", None),
                     ("2", 2006, "o", "deferido", "without donations", None))
    loans = table(LOANS, firm(5, 10), firm(6, 1), firm(None, 4))
    given = table(GIFTS, gift("1", 5, 1), gift("unknown", 6, 1))
    got = donors.donor_loan_totals(loans, given, people)
    assert rows(got.select("cnpj")) == [(None,), (5,)]
    assert rows(donors.donor_loan_totals(loans, given).select("cnpj")) == [(5,), (6,)]


def test_raw_donations_are_read_once_and_not_sorted(spark, tmp_path, table):
    people = running(table, ("1", 2006, "o", "deferido", "a", "x"))
    table(GIFTS, gift("1", 5, 1)).write.parquet(f"{tmp_path}/gifts")
    given = spark.read.parquet(f"{tmp_path}/gifts")
    totals = donors.firm_loan_totals(table(LOANS, firm(5, 10)))
    got = donors.donor_loan_outcomes(people, given, totals)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/gifts") == 1
    scan = plan.index("FileScan parquet")
    below = plan[plan.rindex("Exchange hashpartitioning", 0, scan):scan]
    assert "HashAggregate" in below and "Sort" not in below


def test_first_donation_by_position_and_by_date(table):
    schema = GIFTS + ", posicao long"
    given = table(schema, (*gift("1", 5, 9, 1), 7), (*gift("1", 5, 4, 3), 2),
                  (*gift("1", 5, 6, 1), 9), (*gift("1", 6, None, 1), 3))
    by_place = rows(donors.combined_gifts(given, order="posicao").select(
        "cpf_cnpj_doador", "_n", "_value", "_gift.valor_receita", "_gift.data_receita"))
    assert by_place == [(5, 3, 19, 4, date(2006, 1, 3)), (6, 1, 0, 0, date(2006, 1, 1))]
    by_date = rows(donors.combined_gifts(given).select(
        "cpf_cnpj_doador", "_gift.valor_receita", "_gift.data_receita"))
    assert by_date == [(5, 6, date(2006, 1, 1)), (6, 0, date(2006, 1, 1))]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_first_gift_by_any_position(spark, table, ansi):
    """The last of 32,767 files, and every other long; equal positions go by value."""
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        last, top = 32766 << 44, 2**63 - 1
        most = Decimal("9999999999999999.99")
        given = table(
            "id_candidato_bd string, ano int, tipo_eleicao string, cpf_cnpj_doador string, "
            "valor_receita decimal(18,2), data_receita date, origem_receita string, posicao long",
            *[("c", 2006, "o", donor, value, date(2006, 1, day), CORPORATE_ORIGIN, position)
              for donor, day, position, value in (
                ("late", 2, last + 5, Decimal(3)), ("late", 1, last + 6, Decimal(1)),
                ("ends", 3, top, most), ("ends", 4, -top, Decimal(-1)), ("ends", 5, -top, -most),
                ("unknown", 6, None, Decimal(7)), ("unknown", 7, -top, Decimal(1)))])
        got = donors.combined_gifts(given, order="posicao")
        assert rows(got.select("cpf_cnpj_doador", "_gift.data_receita", "_gift.valor_receita")) == [
            ("ends", date(2006, 1, 5), -most), ("late", date(2006, 1, 2), Decimal(3)),
            ("unknown", date(2006, 1, 6), Decimal(7))]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_clients_and_sums_of_a_candidate_share_a_shuffle(table):
    people = running(table, ("1", 2006, "o", "deferido", "a", "x")).withColumn(
        "tipo_eleicao", F.lit("o"))
    given = table(GIFTS, gift("1", 5, 1)).withColumn("tipo_eleicao", F.lit("o"))
    totals = donors.firm_loan_totals(table(LOANS, firm(5, 10)))
    plan = donors.donor_loan_outcomes(people, given, totals)._jdf.queryExecution()
    # One for the gifts of a candidate and donor, one for what follows.
    assert plan.executedPlan().toString().count("Exchange hashpartitioning(id_candidato_bd") == 2


# --- what is shuffled --------------------------------------------------------------------------

def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]


def test_loans_of_a_firm_in_many_places_are_shuffled_by_firm(table):
    loans = table(
        LOANS, *[(2006, 5, "b", "SP", f"M{i}", date(2006, 2, 1), Decimal(i), Decimal(1))
                 for i in range(20)],
        (2007, 5, "c", "RJ", "A", date(2007, 1, 1), Decimal(10), None),
        (2006, 5, "a", "SP", "Z", date(2006, 2, 1), Decimal(0), Decimal(1)))
    got = donors.firm_loan_totals(loans)
    assert rows(got) == [(2006, 5, 200, None, "a", "SP", "Z")]
    assert shuffles(got) and not any("municipio" in s or "cliente" in s for s in shuffles(got))


def test_first_loan_by_position_before_name(table):
    loans = table(LOANS + ", posicao long", (*firm(5, 1, "a", 1), 9), (*firm(5, 2, "b", 7), 2),
                  (*firm(5, 3, None, 8), 2), (*firm(None, 4, "n", 3), 1))
    got = donors.firm_loan_totals(loans, order="posicao").select(
        "cnpj", "cliente", "total_contratado")
    assert rows(got) == [(None, "n", 4), (5, None, 6)]
    by_date = donors.firm_loan_totals(loans).select("cnpj", "cliente")
    assert rows(by_date) == [(None, "n"), (5, "a")]


def test_gifts_go_through_the_shuffles_with_one_date(table):
    people = running(table, ("1", 2006, "o", "deferido", "a", "x"))
    late = date(9999, 12, 31)
    given = table(GIFTS, gift("1", 5, 4), ("1", 2006, "o", 5, Decimal(3), None, PJ),
                  ("1", 2006, "o", 6, Decimal(2), late, PJ),
                  ("1", 2006, "o", 7, Decimal(2), date(1, 1, 1), PJ))
    first = rows(donors.combined_gifts(given).select(
        "cpf_cnpj_doador", "_gift.data_receita", "_gift.valor_receita"))
    assert first == [(5, None, 3), (6, late, 2), (7, date(1, 1, 1), 2)]
    totals = donors.firm_loan_totals(table(LOANS, firm(5, 10)))
    got = donors.donor_loan_outcomes(people, given, totals)
    assert rows(got.select("cpf_cnpj_doador", "data_receita", "valor_receita", "n_clients")) == [
        (5, None, 3, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "min_by(data_receita" not in plan


def test_votes_of_a_number_are_shuffled_once(table):
    people = table(CANDIDATE, ("1", 2006, "SP", 10, 100, "deferido", "a"),
                   ("2", 2006, None, 10, 100, "deferido", "no state"),
                   ("3", 2006, "", 0, 100, "deferido", "empty state"),
                   ("4", 2006, "", None, 100, "deferido", "no number"))
    given = table(VOTES, (2006, "SP", 10, "São João", 5), (2006, None, 10, "B", 4),
                  (2006, "", 0, "C", 3), (2006, "", None, "D", 2), (2006, None, None, "E", 1))
    got = votes.electoral_base(people, given)
    assert rows(got.select("id_candidato_bd", "nm_municipio", "municipio")) == [
        ("1", "São João", "SAOJOAO"), ("2", "B", "B"), ("3", "C", "C"), ("4", "D", "D")]
    assert got.columns[-2:] == ["municipio", "vot_prop_cand"]
    assert len(shuffles(got)) == 3  # candidates, votes, and the bases by candidate


def test_municipality_totals_are_written_before_the_base_meets_them(table, monkeypatch):
    seen = []
    whole = channels.base_loan_outcomes
    monkeypatch.setattr(channels, "base_loan_outcomes", lambda base, totals, **options: (
        seen.append((base, totals)), whole(base, totals, **options))[1])
    people = table(
        CANDIDATE + ", sigla_partido string, resultado string",
        ("1", 2006, "SP", 10, 100, "deferido", "a", "PT", "eleito"),
        ("2", 2006, "SP", 20, 40, "deferido", "b", "PT", "suplente"))
    given = table(VOTES, (2006, "SP", 10, "A", 60), (2006, "SP", 20, "A", 40))
    credit = table(
        "uf string, municipio string, municipio_codigo long, data_da_contratacao date, "
        "valor_da_operacao_em_reais decimal(18,2), valor_desembolsado_reais decimal(18,2)",
        ("SP", "A", 1, date(2008, 1, 1), Decimal(99), Decimal(9)))
    lists = table(LISTS, (2006, "SP", "PT", "PT / PC"))
    got = channels.municipality_panel(people, given, credit, lists)
    assert rows(got.select("id_candidato_bd", "total_contratado_base")) == [("1", 99), ("2", 99)]
    base, totals = seen[0]
    assert totals.inputFiles()
    # The small totals are broadcast, and the sums need no shuffle after the base's own.
    assert len(shuffles(whole(base, totals))) == len(shuffles(base))
