"""The whole study from a folder of input files to panels and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotcredit.constants import ELECTIONS
from ballotcredit.functions.text import parse_tax_id
from ballotcredit.operators import rd
from ballotcredit.operators.candidates import candidate_frame
from ballotcredit.operators.loans import loan_table_wide, loan_volume_by_type_year, loans_union
from ballotcredit.operators.panel import panel_subsamples
from ballotcredit.plans.channels import FIRM, MUNICIPALITY, firm_panel, municipality_panel
from ballotcredit.sources import readers, schemas, sinks

# Names of the input files.
FILES = {
    "demographics": "demographics.csv",
    "voting": "voting.csv",
    "revenue": "revenue.csv",
    "automatic": "operacoes-financiamento-operacoes-indiretas-automaticas.csv",
    "non_automatic": "operacoes-financiamento-operacoes-nao-automaticas.csv",
    "coalition": "cand_mais_votado-brasil_deputado_federal_{year}.csv",
    "votes": "votacao_candidato_mun_{year}.csv",
    "valid_votes": "votos_por_mun_{year}.csv",
}
SAMPLES = ("all", "pt", "pt_colig")
# Column with a row's position in its file: "first row" means first in the file.
POSITION = "posicao"


@dataclass(frozen=True)
class Inputs:
    """The input tables; the tax ids of donations and non-automatic loans are parsed."""

    demographics: DataFrame
    voting: DataFrame
    revenue: DataFrame
    non_automatic: DataFrame
    automatic: DataFrame
    coalition: DataFrame
    votes: DataFrame
    valid_votes: DataFrame

    def candidates(self) -> DataFrame:
        return candidate_frame(self.demographics, self.voting)

    def loans(self) -> DataFrame:
        ordered = POSITION in self.non_automatic.columns and POSITION in self.automatic.columns
        return loans_union(self.non_automatic, self.automatic, POSITION if ordered else None)

    def snapshot(self, folder: str) -> Inputs:
        """Each table written once as Parquet, by election where it has one, and read back."""
        stored = {}
        for field in fields(self):
            table, path = getattr(self, field.name), f"{folder}/{field.name}"
            if "ano" in table.columns:
                sinks.snapshot(table, path)
            else:
                table.write.mode("overwrite").parquet(path)
            stored[field.name] = table.sparkSession.read.schema(table.schema).parquet(path)
        return Inputs(**stored)


def _parsed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, parse_tax_id(F.col(column)))


def read_inputs(
    spark: SparkSession, folder: str, elections: Sequence[int] = ELECTIONS,
    multi_line: bool | str = False,
) -> Inputs:
    """All input tables of a folder of files in their original formats, with row positions."""

    def path(name: str) -> str:
        return f"{folder}/{FILES[name]}"

    def paths(name: str) -> dict[int, str]:
        return {year: path(name).format(year=year) for year in elections}

    return Inputs(
        demographics=readers.read_demographics(spark, path("demographics"), multi_line),
        voting=readers.read_voting(spark, path("voting"), multi_line),
        revenue=_parsed(
            readers.read_revenue(
                spark, path("revenue"), row_order=POSITION, multi_line=multi_line),
            "cpf_cnpj_doador"),
        non_automatic=_parsed(readers.read_loans(
            spark, path("non_automatic"), schemas.NON_AUTOMATIC_LOANS, row_order=POSITION,
            multi_line=multi_line), "cnpj"),
        automatic=readers.read_loans(
            spark, path("automatic"), schemas.AUTOMATIC_LOANS, row_order=POSITION,
            multi_line=multi_line),
        coalition=readers.read_coalitions(spark, paths("coalition"), multi_line),
        votes=readers.read_municipal_votes(spark, paths("votes"), POSITION, multi_line),
        valid_votes=readers.read_valid_votes(spark, paths("valid_votes"), multi_line),
    )


def snapshot_tables(spark: SparkSession, tables: Mapping[str, str], folder: str) -> None:
    """Copy warehouse tables (name of the copy to table name) to Parquet folders by year."""
    for name, source in tables.items():
        sinks.snapshot(readers.read_table(spark, source), f"{folder}/{name}")


def _channel_options(options: Mapping) -> dict[str, dict]:
    """Each option for the channels that know it; a name that none knows raises."""
    known = {
        channel: {n for n, p in signature(plan).parameters.items() if p.kind is p.KEYWORD_ONLY}
        for channel, plan in ((MUNICIPALITY, municipality_panel), (FIRM, firm_panel))
    }
    unknown = set(options) - set().union(*known.values())
    if unknown:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    return {c: {k: v for k, v in options.items() if k in names} for c, names in known.items()}


def panels(inputs: Inputs, **options) -> dict[str, DataFrame]:
    """The pooled panel of each channel; an option goes to the channels that know it."""
    chosen = _channel_options(options)
    orders = {MUNICIPALITY: {"loan_order": POSITION, "vote_order": POSITION},
              FIRM: {"loan_order": POSITION, "donation_order": POSITION}}
    candidates = inputs.candidates()
    return {
        MUNICIPALITY: municipality_panel(
            candidates, inputs.votes, inputs.loans(), inputs.coalition,
            **orders[MUNICIPALITY] | chosen[MUNICIPALITY]),
        FIRM: firm_panel(
            candidates, inputs.revenue, inputs.non_automatic, inputs.coalition,
            **orders[FIRM] | chosen[FIRM]),
    }


def run_study(
    spark: SparkSession, folder: str, output: str, *, multi_line: bool | str = False, **options
) -> None:
    """Write both channels' panels with the party subsamples, the volume series and its report.

    The files are parsed once, into Parquet tables below the work folder; all plans read those.
    """
    _channel_options(options)
    files = read_inputs(spark, folder, options.get("elections", ELECTIONS), multi_line)
    inputs = files.snapshot(sinks.work_folder(spark))
    for channel, panel in panels(inputs, **options).items():
        sampled = panel_subsamples(panel, SAMPLES, party=options.get("party", "PT"))
        sinks.write_panel(sampled, f"{output}/panels", channel)
    volume = sinks.written(loan_volume_by_type_year(inputs.loans()))
    sinks.write_csv(volume, f"{output}/volume_by_type_year")
    sinks.write_report(loan_table_wide(volume), f"{output}/loan_table")


def result_table(
    panel: DataFrame,
    outcome: str,
    columns: Mapping[str, Sequence[tuple[int, float]]],
    bandwidth_label: str = "Banda",
) -> DataFrame:
    """Printed result table of a written panel: samples by (degree, bandwidth) columns."""
    specs = rd.grid_specs(columns)
    sampled = panel_subsamples(panel, tuple(columns))
    width = max(len(pairs) for pairs in columns.values())
    return rd.rd_table_layout(
        rd.rd_result_grid(sampled, outcome, specs), width, bandwidth_label
    )
