"""From raw documents to a training mix in five stages, each on all rows the one before it kept.

Toxic documents go, frequent lines go, one document of each group of near duplicates stays,
documents that hold benchmark items go, and what is left is mixed by source. All stages but the
last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotcredit.llm.decontam import find_leaks
from ballotcredit.llm.lines import line_dedup
from ballotcredit.llm.mixing import mix_sources
from ballotcredit.llm.neardup import near_duplicates
from ballotcredit.llm.toxicity import score_toxicity, train
from ballotcredit.sources.sinks import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted on the labels scores under one half."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, machine, name="toxicity_score")
    return scored.where("toxicity_score < 0.5").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; an emptied one stays."""
    kept = line_dedup(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    gone = near_duplicates(docs, words=5, percent=75).where("NOT kept").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their size, target and taken words."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

# The machine of the first stage and the seeded blocks of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        docs = written(result) if name != STAGES[-1][0] else result
    return docs
