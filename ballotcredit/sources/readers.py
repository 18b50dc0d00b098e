"""CSV scans with stated types, per-year files, and warehouse snapshots.

CSV files are split between tasks; convert them once with ``snapshot`` and work on the Parquet
copy, where filters and column selection reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotcredit.constants import FEDERAL_DEPUTY, LAST_REVENUE_YEAR
from ballotcredit.functions.text import parse_decimal
from ballotcredit.sources import schemas
from ballotcredit.sources.records import file_name, quoted_records

# Value of ``multi_line`` that reads all splits of a file at once.
SPLITS = "splits"
# Texts that mean "missing" in the files.
MISSING = ("", "NA")


def _typed(c: Column, to: str, decimal_mark: str, grouping_mark: str) -> Column:
    text = F.when(~F.trim(c).isin(*MISSING), F.trim(c))
    if to == "string":
        return text
    if to == "date":
        return F.coalesce(
            F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy")
        )
    return parse_decimal(text, decimal_mark, grouping_mark, to)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: Mapping[str, str],
    *,
    sep: str = ",",
    decimal_mark: str = ".",
    grouping_mark: str = "",
    encoding: str = "UTF-8",
    doubled_quotes: bool = True,
    row_order: str | None = None,
    multi_line: bool | str = False,
    check_quotes: bool = True,
) -> DataFrame:
    """Columns of ``schema`` from a CSV file with a header, selected by name.

    All cells are scanned as text and converted per column, so nothing is inferred and a bad
    cell is NULL. A column the header lacks raises. ``row_order`` names a column for the position
    of the row in its file (a long, sortable over all files of the scan), for "first row" rules.

    Cells with line breaks need ``multi_line``: "splits" finds the records in all splits of a file
    at once (``records.quoted_records`` says in which files it can), True reads each file in one
    task. Without it a line with an odd number of quotes raises (a job that reads the lines), unless
    ``check_quotes`` is off: such a row would otherwise be cut in two without notice.
    """
    if multi_line not in (False, True, SPLITS):
        raise ValueError(f"multi_line is False, True or {SPLITS!r}")
    options = {
        "sep": sep, "escape": '"' if doubled_quotes else "",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "multiLine": str(bool(multi_line)).lower(),
    }
    raw = spark.read.options(header=True, encoding=encoding, **options).csv(path)
    position = _position(raw) if row_order and multi_line != SPLITS else None
    if multi_line == SPLITS:
        cells, position = _split_cells(
            spark, path, raw, sep, encoding, doubled_quotes, options, row_order is not None)
        raw = cells
    if check_quotes and not multi_line:
        require_balanced_quotes(spark, path)
    missing = [c for c in schema if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    columns = [
        _typed(F.col(f"`{c}`"), to, decimal_mark, grouping_mark).alias(c)
        for c, to in schema.items()
    ]
    if row_order:
        columns.append(position.alias(row_order))
    return raw.select(*columns)


def _split_cells(
    spark: SparkSession, path: str | list[str], header: DataFrame, sep: str, encoding: str,
    doubled_quotes: bool, options: Mapping[str, str], ordered: bool,
) -> tuple[DataFrame, Column]:
    """The cells of all records, by the columns of ``header``, and the column of their position."""
    record = F.col("record")
    if not doubled_quotes:  # the parser takes two quotes alone for a text, not for an empty cell
        empty = f'(^|{re.escape(sep)})""(?={re.escape(sep)}|$)'
        record = F.regexp_replace(record, empty, "$1")
    place = F.lit(0).cast("long")
    if ordered:
        place = _file_places(header, F.xxhash64, F.col("file"))
    rows = quoted_records(spark, path, sep, encoding, doubled_quotes).where(
        "block > 0 OR row > 0").select(
        F.from_csv(record, header.schema.toDDL(), options).alias("cells"),
        (F.shiftleft(place, 44) + F.col("block") + F.col("row")).alias("at"))
    at = "at"
    while at in header.columns:
        at += "_"
    return rows.select("cells.*", F.col("at").alias(at)), F.col(at)


def require_balanced_quotes(spark: SparkSession, path: str | list[str]) -> None:
    """Raise if a line holds an odd number of quotes: a quoted cell goes on in the next line.

    Reads the lines once as text, before they are parsed, and runs a job.
    """
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
        raise ValueError(f"{path}: a quoted cell is open at the end of its line, use multi_line")


def _position(raw: DataFrame) -> Column:
    """Position of a row: its file's place by path, then the split's offset plus the row in it.

    A row takes a byte at least, so positions of a split stay below the next split's offset; a
    task that reads several splits reads no more than one that another follows.
    """
    place = _file_places(raw, lambda name: name, file_name(F.col("_metadata.file_path")))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(place, 44) + F.col("_metadata.file_block_start") + row


def _file_places(raw: DataFrame, key: Callable[[Column], Column], file: Column) -> Column:
    """Place of a row's file among the files of a scan, in order of their paths.

    ``file`` is the ``key`` of ``records.file_name``. A file that the scan does not list fails.
    """
    files = sorted(raw.inputFiles())
    if len(files) == 1:
        return F.lit(0).cast("long")
    if len(files) >= 1 << 15:
        raise ValueError("too many files for row positions")
    pairs = [x for i, name in enumerate(files) for x in (key(file_name(F.lit(name))), F.lit(i))]
    place = F.element_at(F.create_map(*pairs), file)
    return F.coalesce(place, F.raise_error(F.lit("a row of a file that is not listed"))).cast("long")


def read_by_year(paths: Mapping[int, str], read: Callable[[str], DataFrame]) -> DataFrame:
    """Files of one layout per election as one table with the election in ``ano``."""
    years = [read(path).withColumn("ano", F.lit(year)) for year, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), years)


def read_demographics(spark: SparkSession, path: str, multi_line: bool | str = False) -> DataFrame:
    return read_delimited(spark, path, schemas.DEMOGRAPHICS, multi_line=multi_line)


def read_voting(spark: SparkSession, path: str, multi_line: bool | str = False) -> DataFrame:
    return read_delimited(spark, path, schemas.VOTING, multi_line=multi_line)


def read_revenue(
    spark: SparkSession,
    path: str,
    office: str = FEDERAL_DEPUTY,
    last_year: int = LAST_REVENUE_YEAR,
    row_order: str | None = None,
    multi_line: bool | str = False,
) -> DataFrame:
    """Donations of one office up to ``last_year``."""
    revenue = read_delimited(
        spark, path, schemas.REVENUE, row_order=row_order, multi_line=multi_line)
    return revenue.filter((F.col("cargo") == office) & (F.col("ano") <= last_year))


def read_loans(
    spark: SparkSession,
    path: str,
    schema: Mapping[str, str],
    *,
    grouping_mark: str = ".",
    row_order: str | None = None,
    multi_line: bool | str = False,
) -> DataFrame:
    """A loan table: semicolons, decimal comma, grouping dots (or none)."""
    return read_delimited(
        spark, path, schema, sep=";", decimal_mark=",", grouping_mark=grouping_mark,
        doubled_quotes=False, row_order=row_order, multi_line=multi_line,
    )


def read_disbursements(
    spark: SparkSession, path: str, schema: Mapping[str, str], multi_line: bool | str = False
) -> DataFrame:
    """The monthly disbursements: a loan table whose numbers have no grouping marks."""
    return read_loans(spark, path, schema, grouping_mark="", multi_line=multi_line)


def read_coalitions(
    spark: SparkSession, paths: Mapping[int, str], multi_line: bool | str = False
) -> DataFrame:
    """Coalition files (Latin-1, semicolons), one per election."""
    return read_by_year(paths, lambda path: read_delimited(
        spark, path, schemas.COALITION, sep=";", decimal_mark=",", grouping_mark=".",
        encoding="ISO-8859-1", doubled_quotes=False, multi_line=multi_line,
    ))


def read_municipal_votes(
    spark: SparkSession, paths: Mapping[int, str], row_order: str | None = None,
    multi_line: bool | str = False,
) -> DataFrame:
    return read_by_year(paths, lambda path: read_delimited(
        spark, path, schemas.VOTES_BY_MUNICIPALITY, row_order=row_order, multi_line=multi_line))


def read_valid_votes(
    spark: SparkSession, paths: Mapping[int, str], multi_line: bool | str = False
) -> DataFrame:
    """Valid votes per municipality with plain column names: ano, uf, nm_municipio, qt_votos_mun."""
    table = read_by_year(paths, lambda path: read_delimited(
        spark, path, schemas.VALID_VOTES, multi_line=multi_line))
    return table.withColumnsRenamed(schemas.VALID_VOTES_NAMES)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet folder when the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.read.table(name)
