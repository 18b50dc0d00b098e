"""Pooled panel and its subsamples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import BANDWIDTH, ELECTED_LABELS, PARTY
from ballotcredit.functions.keys import compound_key, label


def pooled_panel(*panels: DataFrame) -> DataFrame:
    """Union of panels of equal layout with the cluster key and the state factor."""
    pooled = reduce(lambda a, b: a.unionByName(b), panels)
    return pooled.withColumn(
        "factor_cluster", compound_key(F.col("ano"), F.col("sigla_uf"), F.col("colig"))
    ).withColumn("factor_uf", F.col("sigla_uf"))


def sample_condition(sample: str, bandwidth: float = BANDWIDTH, party: str = PARTY) -> Column:
    """Row condition of a sample: ``all``, ``reg`` (inside the bandwidth, boundary included),
    ``pt``, ``pt_colig``, each optionally followed by ``_<year>``."""
    name, _, year = sample.rpartition("_")
    if not year.isdigit():
        name, year = sample, ""
    conditions = {
        "all": F.lit(True),
        "reg": F.col("abs_vote_margin") <= bandwidth,
        "pt": F.col("sigla_partido") == party,
        "pt_colig": F.col("is_colig_pt") == 1,
    }
    if name not in conditions:
        raise ValueError(f"unknown sample {sample!r}")
    return conditions[name] & (F.col("ano") == int(year)) if year else conditions[name]


def panel_subsamples(
    panel: DataFrame,
    samples: Sequence[str],
    bandwidth: float = BANDWIDTH,
    party: str = PARTY,
) -> DataFrame:
    """The panel once per sample a row belongs to, named in ``sample``; one pass over the panel."""
    names = F.array(
        *[F.when(sample_condition(s, bandwidth, party), F.lit(s)) for s in samples]
    )
    return (
        panel.withColumn("elected_label", label(F.col("elected"), ELECTED_LABELS))
        .withColumn("sample", F.explode(names))
        .filter(F.col("sample").isNotNull())
    )


def inspection_order(panel: DataFrame) -> DataFrame:
    """The panel sorted by election, list and votes, for reading."""
    return panel.orderBy("ano", "colig", "votos")
