from datetime import date, timedelta
from decimal import Decimal

import pytest
from helpers import rows

from ballotcredit.operators import loans

LOAN = ("municipio_codigo long, municipio string, uf string, data_da_contratacao date, "
        "valor_da_operacao_em_reais decimal(18,2), valor_desembolsado_reais decimal(18,2)")


def loan(code, name, amount, disbursed=1, uf="SP", day=date(2007, 1, 1)):
    def money(x):
        return None if x is None else Decimal(x)
    return (code, name, uf, day, money(amount), money(disbursed))


def test_windows_are_whole_years_and_overlap(table):
    days = [date(2005, 12, 31), date(2006, 1, 1), date(2010, 6, 1), date(2010, 12, 31),
            date(2011, 1, 1), date(2018, 12, 31), date(2019, 1, 1)]
    df = table("data_da_contratacao date", *[(d,) for d in days])
    got = loans.loans_in_election_window(df)
    assert rows(got) == [
        (date(2006, 1, 1), 2006), (date(2010, 6, 1), 2006), (date(2010, 6, 1), 2010),
        (date(2010, 12, 31), 2006), (date(2010, 12, 31), 2010), (date(2011, 1, 1), 2010),
        (date(2018, 12, 31), 2014)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_window_filter_reaches_the_scan(spark, tmp_path, table):
    table("data_da_contratacao date, v int", (date(2006, 1, 1), 1)).write.parquet(f"{tmp_path}/l")
    got = loans.loans_in_election_window(spark.read.parquet(f"{tmp_path}/l"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(data_da_contratacao,2006-01-01)" in plan


def windows(table, *loan_rows):
    return loans.loans_in_election_window(table(LOAN, *loan_rows), [2006], 4)


def test_missing_amount_makes_the_code_total_unknown(table):
    df = windows(table, loan(1, "A", 10), loan(1, "A", None), loan(2, "B", 10), loan(2, "B", 5))
    got = loans.municipality_loan_totals(df)
    assert rows(got.select("municipio", "total_contratado", "total_desembolsado")) == [
        ("A", None, 2), ("B", 15, 2)]
    skipped = loans.municipality_loan_totals(df, skip_nulls=True)
    assert rows(skipped.select("municipio", "total_contratado")) == [("A", 10), ("B", 15)]


def test_loans_without_municipality_are_left_out(table):
    df = windows(table, loan(0, "SEM MUNICÍPIO", 10), loan(None, "X", 1), loan(3, "C", 7))
    assert rows(loans.municipality_loan_totals(df).select("municipio_codigo")) == [(3,)]


def test_spellings_keep_rows_with_the_whole_total(table):
    df = windows(table, loan(1, "São João", 10), loan(1, "SAO JOAO", 5), loan(1, "São-João", 1))
    parity = loans.municipality_loan_totals(df).select("municipio", "total_contratado")
    assert rows(parity) == [("SAOJOAO", 16), ("SãoJoão", 16)]
    folded = loans.municipality_loan_totals(df, fold_names=True)
    assert rows(folded.select("municipio", "total_contratado")) == [("SAOJOAO", 16)]


def test_state_comes_from_the_first_loan(table):
    df = windows(table, loan(1, "A", 1, uf="RJ", day=date(2008, 1, 1)),
                 loan(1, "A", 2, uf="SP", day=date(2007, 1, 1)))
    assert rows(loans.municipality_loan_totals(df).select("uf", "total_contratado")) == [("SP", 3)]


def test_union_fills_missing_columns(table):
    a = table("cliente string, cnpj string, valor_contratado_reais int", ("x", "1", 5))
    b = table("cliente string, valor_da_operacao_em_reais int", ("y", 6))
    got = loans.loans_union(a, b).select(
        "cliente", "cnpj", "valor_da_operacao_em_reais", "tipo_op")
    assert rows(got) == [("x", "1", 5, "Não automática"), ("y", None, 6, "Automática")]


def volume_rows(table):
    schema = ("tipo_op string, data_da_contratacao date, "
              "valor_da_operacao_em_reais double, valor_desembolsado_reais double")
    return table(
        schema,
        ("Automática", date(2002, 5, 1), 1e9, 1.0), ("Automática", date(2002, 6, 1), 2e9, 1.0),
        ("Não automática", date(2002, 1, 1), 500.0, None),
        ("Não automática", date(2003, 1, 1), None, 4.0),
        ("Não automática", date(2003, 1, 2), 1500000.0, 4.0),
        ("Automática", date(2001, 1, 1), 1.0, 1.0), ("Automática", date(2019, 1, 1), 1.0, 1.0))


def test_volume_by_type_and_year(table):
    got = loans.loan_volume_by_type_year(volume_rows(table))
    assert rows(got) == [
        ("Automática", 2002, 3e9, 2.0, 2, 1.5e9, 5e17),
        ("Não automática", 2002, 500.0, None, 1, 500.0, None),
        ("Não automática", 2003, None, 8.0, 2, 1500000.0, None)]


def test_wide_report_table(table):
    got = loans.loan_table_wide(loans.loan_volume_by_type_year(volume_rows(table)))
    assert got.columns == [
        "ano", "total_contratado_Automática", "media_contratado_Automática",
        "n_operacoes_Automática", "total_contratado_Não automática",
        "media_contratado_Não automática", "n_operacoes_Não automática"]
    assert rows(got, "ano") == [
        (2002, "3,0 bi", "1,5 bi", "2", "500", "500", "1"),
        (2003, None, None, None, None, "1,5 mi", "2")]


def test_an_unlisted_type_fails_the_wide_table(table):
    volume = table("tipo_op string, ano int, total_contratado double, media_contratado double, "
                   "n_operacoes long", ("Automática", 2002, 1.0, 1.0, 1), ("Outra", 2002, 1.0, 1.0, 1))
    with pytest.raises(Exception, match="not listed"):
        loans.loan_table_wide(volume).collect()
    assert "n_operacoes_Outra" in loans.loan_table_wide(
        volume, types=("Automática", "Outra")).columns


def test_types_that_the_data_name(table):
    volume = table("tipo_op string, ano int, total_contratado double, media_contratado double, "
                   "n_operacoes long", ("Outra", 2002, 1.0, 1.0, 1), ("Automática", 2002, 1.0, 1.0, 2),
                   (None, 2003, 1.0, 1.0, 3), ("Não automática", 2003, 1.0, 1.0, 4))
    wide = loans.loan_table_wide(volume, types=None, measures=("n_operacoes",))
    assert wide.columns == ["ano", "n_operacoes_Automática", "n_operacoes_NA",
                            "n_operacoes_Não automática", "n_operacoes_Outra"]
    assert rows(wide, "ano") == [(2002, "2", None, None, "1"), (2003, None, "3", "4", None)]
    with pytest.raises(ValueError, match="more than 3"):
        loans.found_names(volume, "tipo_op", most=3)
    empty = loans.pivot_measures(volume.limit(0), ["ano"], "tipo_op", None, ("n_operacoes",))
    assert empty.columns == ["ano"] and empty.count() == 0


def test_windows_of_any_days(spark, tmp_path, table):
    """Every pair of a day and a window, across ranges of any width, against plain comparisons."""
    days = [date(2005, 12, 1) + timedelta(d) for d in range(0, 1200, 7)] + [None]
    windows = [(1, date(2006, 4, 1), date(2008, 3, 31)), (2, date(2007, 4, 1), date(2007, 4, 1)),
               (3, date(1969, 1, 1), date(2006, 4, 7)), (2, date(2008, 1, 5), date(2009, 3, 1))]
    df = table("data_da_contratacao date, k int", *[(d, i) for i, d in enumerate(days)])
    want = sorted((d, i, n) for i, d in enumerate(days) if d
                  for n, a, b in windows if a <= d <= b)
    for width in (1, 30, 64, 5000):
        got = loans.loans_in_date_windows(df, windows, bin_days=width)
        assert rows(got) == want
    df.write.parquet(f"{tmp_path}/l")
    plan = loans.loans_in_date_windows(spark.read.parquet(f"{tmp_path}/l"), windows[:2])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(data_da_contratacao,2006-04-01)" in text
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Exchange hash" not in text
    for bad in ([], [(1, date(2006, 1, 2), date(2006, 1, 1))]):
        with pytest.raises(ValueError):
            loans.loans_in_date_windows(df, bad)


def test_volume_years_reach_the_scan(spark, tmp_path, table):
    volume_rows(table).write.parquet(f"{tmp_path}/v")
    got = loans.loan_volume_by_type_year(spark.read.parquet(f"{tmp_path}/v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(data_da_contratacao,2002-01-01)" in plan


def test_state_comes_from_the_first_row_in_file_order(table):
    df = table(LOAN + ", posicao long", (*loan(1, "X", 1, uf="B", day=date(2007, 1, 1)), 1),
               (*loan(1, "X", 2, uf="A", day=date(2006, 1, 1)), 2))
    assert [r.uf for r in loans.municipality_loan_totals(df, order="posicao").collect()] == ["B"]
    assert [r.uf for r in loans.municipality_loan_totals(df).collect()] == ["A"]


def test_loans_are_summed_before_they_meet_the_elections(table):
    df = table(LOAN, loan(1, "A", 3, day=date(2010, 5, 5)), loan(1, "A", 4, day=date(2011, 5, 5)))
    got = loans.municipality_loan_totals(df)
    assert rows(got.select("ano", "total_contratado")) == [(2006, 3), (2010, 7)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = plan.index("BroadcastHashJoin")
    assert "HashAggregate" in plan[join:] and "SortAggregate" not in plan


def test_second_table_comes_after_the_first_in_a_union(table):
    first = table("cliente string, valor_contratado_reais int, posicao long", ("x", 5, 9))
    second = table("cliente string, valor_da_operacao_em_reais int, posicao long", ("y", 6, 0))
    got = loans.loans_union(first, second, "posicao").orderBy("posicao")
    assert [r.cliente for r in got.collect()] == ["x", "y"]
