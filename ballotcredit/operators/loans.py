"""Loan tables: union, election windows, totals per municipality, volume by type and year."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.constants import (
    AUTOMATIC,
    ELECTIONS,
    NO_MUNICIPALITY,
    NON_AUTOMATIC,
    VOLUME_YEARS,
    YEARS_AFTER,
)
from ballotcredit.functions.numeric import magnitude, na_sum
from ballotcredit.functions.text import letters_and_digits, normalize_name
from ballotcredit.operators.rows import move_columns
from ballotcredit.operators.tables import parameter_table

CONTRACTED = "valor_da_operacao_em_reais"
DISBURSED = "valor_desembolsado_reais"


def loans_union(
    non_automatic: DataFrame, automatic: DataFrame, row_order: str | None = None
) -> DataFrame:
    """Both loan tables under one layout with the type of operation in ``tipo_op``.

    A column that only one table has is NULL for the rows of the other. ``row_order`` names the
    file positions of both; the second table's rows then come after the first's.
    """
    first = non_automatic.withColumn("tipo_op", F.lit(NON_AUTOMATIC)).withColumnRenamed(
        "valor_contratado_reais", CONTRACTED
    )
    second = automatic.withColumn("tipo_op", F.lit(AUTOMATIC))
    if row_order:
        second = second.withColumn(row_order, F.col(row_order) + F.lit(1 << 60))
    return first.unionByName(second, allowMissingColumns=True)


def _windows(df: DataFrame, elections: Sequence[int], years_after: int) -> DataFrame:
    """(ano, _window_year): the years of each election's window, a table of parameters."""
    years = [(election, election + lag) for election in elections for lag in range(years_after + 1)]
    return parameter_table(df.sparkSession, {"ano": "int", "_window_year": "int"}, years)


def _dated(loans: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Loans of whole years; the literal range reaches the scan."""
    return loans.filter(
        F.col(date).between(F.make_date(F.lit(first), F.lit(1), F.lit(1)),
                            F.make_date(F.lit(last), F.lit(12), F.lit(31)))
    )


def loans_in_election_window(
    loans: DataFrame,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    date: str = "data_da_contratacao",
) -> DataFrame:
    """Every loan once per election whose window holds its date, with the election in ``ano``.

    A window runs from January 1 of the election year to December 31 ``years_after`` years
    later, so windows may overlap. Windows are whole years: the interval join is an equi join on
    the contract year with a table of elections x years.
    """
    windows = _windows(loans, elections, years_after)
    dated = _dated(loans, date, min(elections), max(elections) + years_after)
    return dated.join(windows, F.year(date) == windows["_window_year"]).drop("_window_year")


def loans_in_date_windows(
    loans: DataFrame,
    windows: Sequence[tuple[int, date, date]],
    day: str = "data_da_contratacao",
    bin_days: int = 64,
) -> DataFrame:
    """Every loan once per window that holds its date, with the window's number in ``ano``.

    Windows are (number, first day, last day), both inclusive, of any length; they may overlap. A
    window is a row for each range of ``bin_days`` days that it touches, a loan belongs to the range
    of its date, and the dates decide inside an equi join on the range: each pair meets once. The
    days from the first window to the last reach the scan. A loan without a date is in no window.
    """
    if any(last < first for _, first, last in windows) or not windows or bin_days < 1:
        raise ValueError("a window ends before it begins, or there is none")
    epoch = date(1970, 1, 1)
    ranges = [
        (number, (first - epoch).days, (last - epoch).days, bin_)
        for number, first, last in windows
        for bin_ in range((first - epoch).days // bin_days, (last - epoch).days // bin_days + 1)
    ]
    table = parameter_table(
        loans.sparkSession, {"ano": "int", "_from": "int", "_to": "int", "_bin": "int"}, ranges)
    dated = loans.filter(F.col(day).between(
        F.lit(min(first for _, first, _ in windows)), F.lit(max(last for _, _, last in windows))))
    number = F.unix_date(day)
    return dated.withColumn("_day", number).withColumn(
        "_bin", F.floor(F.col("_day") / bin_days).cast("int")).join(table, "_bin").filter(
        F.col("_day").between(F.col("_from"), F.col("_to"))).drop("_day", "_bin", "_from", "_to")


def window_sums(
    loans: DataFrame,
    keys: Sequence[str],
    contracted: str,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    order: str = "data_da_contratacao",
    date: str = "data_da_contratacao",
    of_first: Sequence[str] = (),
) -> DataFrame:
    """Sums of loans per election (``ano``) and ``keys``: ``_sum_c``, ``_sum_d``, the counts of
    rows and known amounts, and the smallest ``order``.

    Loans are summed per contract year first, by hash aggregation in each task, and only the sums
    meet the elections, so raw rows are never copied for overlapping windows. With ``of_first``
    the smallest ``order`` comes with these columns of its loan, the smallest of several and an
    unknown ``order`` first: ``_first`` is then a struct. Its texts need a sort in each task.
    """
    first = F.struct(F.col(order).alias("_order"), *of_first) if of_first else F.col(order)
    yearly = (
        _dated(loans, date, min(elections), max(elections) + years_after)
        .groupBy(F.year(date).alias("_window_year"), *keys)
        .agg(
            F.sum(contracted).alias("_sum_c"),
            F.sum(DISBURSED).alias("_sum_d"),
            F.count(F.lit(1)).alias("_n"),
            F.count(contracted).alias("_n_c"),
            F.count(DISBURSED).alias("_n_d"),
            F.min(first).alias("_first"),
        )
    )
    sums = ("_sum_c", "_sum_d", "_n", "_n_c", "_n_d")
    return (
        yearly.join(_windows(loans, elections, years_after), "_window_year")
        .groupBy("ano", *keys)
        .agg(*[F.sum(c).alias(c) for c in sums], F.min("_first").alias("_first"))
    )


def municipality_loan_totals(
    loans: DataFrame,
    *,
    elections: Sequence[int] = ELECTIONS,
    years_after: int = YEARS_AFTER,
    fold_names: bool = False,
    skip_nulls: bool = False,
    order: str = "data_da_contratacao",
) -> DataFrame:
    """One row per election, municipality code and spelling, with the totals of the whole code.

    Loans without a municipality (code 0 or NULL) are left out. A missing amount makes the
    total of its code NULL unless ``skip_nulls``. Names keep their case and accents unless
    ``fold_names``. A spelling used in several states takes the state of its first loan by
    ``order`` (then the smallest state). Names are cleaned once per name, after the sums.
    """
    clean = normalize_name if fold_names else letters_and_digits
    located = loans.filter(F.col("municipio_codigo") != NO_MUNICIPALITY)
    spellings = window_sums(
        located, ["municipio_codigo", "municipio", "uf"], CONTRACTED, elections, years_after, order
    ).withColumn("municipio", clean(F.col("municipio")))
    # Second level: one row per written name, so a code's window is as long as its names.
    code = Window.partitionBy("ano", "municipio_codigo")
    spelling = Window.partitionBy("ano", "municipio_codigo", "municipio").orderBy("_first", "uf")

    def total(part: str, present: str):
        whole = F.sum(part).over(code)
        if skip_nulls:
            return whole
        return F.when(F.sum("_n").over(code) == F.sum(present).over(code), whole)

    return (
        spellings.withColumn("total_contratado", total("_sum_c", "_n_c"))
        .withColumn("total_desembolsado", total("_sum_d", "_n_d"))
        .withColumn("_position", F.row_number().over(spelling))
        .filter("_position = 1")
        .select("ano", "municipio_codigo", "uf", "municipio", "total_contratado",
                "total_desembolsado")
    )


def loan_volume_by_type_year(
    loans: DataFrame,
    first_year: int = VOLUME_YEARS[0],
    last_year: int = VOLUME_YEARS[1],
    date: str = "data_da_contratacao",
) -> DataFrame:
    """Volume, count, mean and variance of contracted loans by type and year (the figure series)."""
    amount = F.col(CONTRACTED)
    return (
        _dated(loans, date, first_year, last_year)
        .groupBy("tipo_op", F.year(date).alias("ano"))
        .agg(
            na_sum(amount).alias("total_contratado"),
            na_sum(F.col(DISBURSED)).alias("total_desembolsado"),
            F.count(F.lit(1)).alias("n_operacoes"),
            F.avg(amount).alias("media_contratado"),
            F.var_samp(amount.cast("double")).alias("var_contratado"),
        )
    )


def found_names(df: DataFrame, column: str, most: int = 200) -> list[str]:
    """The values of a column of labels in code point order, found by a job; a missing one is NA.

    More than ``most`` values raise: their columns would make no table.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit("NA"))
    found = df.select(label.alias("label")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r.label for r in found)


def pivot_measures(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence[str] | None,
    measures: Sequence[str],
) -> DataFrame:
    """Long to wide: one ``<measure>_<name>`` column per measure and name.

    ``names`` are all values that ``names_from`` may have; another one fails the query. Without
    them the data name them first (``found_names``, which runs a job on ``df``).
    """
    if names is None:
        names = found_names(df, names_from)
        df = df.withColumn(names_from, F.coalesce(F.col(names_from).cast("string"), F.lit("NA")))
        if not names:
            return df.select(*keys).distinct()
    unknown = F.raise_error(F.concat(
        F.lit(f"{names_from} has a value that is not listed: "),
        F.coalesce(F.col(names_from).cast("string"), F.lit("NULL"))))
    known = F.when(F.col(names_from).isin(*names), F.col(names_from)).otherwise(unknown)
    wide = df.withColumn(names_from, known).groupBy(*keys).pivot(names_from, list(names)).agg(
        *[F.first(m).alias(m) for m in measures]
    )
    # A pivot of one measure names its columns by the names alone.
    columns = [F.col(f"`{n}_{m}`" if len(measures) > 1 else f"`{n}`").alias(f"{m}_{n}")
               for m in measures for n in names]
    return wide.select(*keys, *columns)


def loan_table_wide(
    volume: DataFrame,
    types: Sequence[str] | None = (AUTOMATIC, NON_AUTOMATIC),
    measures: Sequence[str] = ("total_contratado", "media_contratado", "n_operacoes"),
) -> DataFrame:
    """Report table: one row per year, formatted text per type and measure, first type first.

    With ``types=None`` the table has a column for every type of the data, the automatic ones first;
    ``volume`` is read twice then.
    """
    wide = pivot_measures(volume, ["ano"], "tipo_op", types, measures)
    texts = wide.select(
        "ano", *[magnitude(F.col(f"`{c}`")).alias(c) for c in wide.columns if "_" in c]
    )
    first = types[0] if types else AUTOMATIC
    return move_columns(texts, [c for c in texts.columns if c.endswith(f"_{first}")], after="ano")
