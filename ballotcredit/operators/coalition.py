"""Coalition of a party per state, and membership in one party's coalition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.constants import PARTY
from ballotcredit.functions.numeric import if_else
from ballotcredit.operators.joins import key_join
from ballotcredit.operators.rows import distinct_on


def coalition_map(coalition: DataFrame) -> DataFrame:
    """Distinct (ano, sg_uf, sg_partido, colig); a party may have several rows or NULL."""
    named = coalition.withColumnRenamed("ds_composicao_coligacao", "colig")
    return distinct_on(named, ["ano", "sg_uf", "sg_partido", "colig"])


def party_coalitions(coalitions: DataFrame, party: str = PARTY) -> DataFrame:
    """The coalitions of ``party`` per election and state: (ano, sg_uf, colig_pt)."""
    return (
        coalitions.filter((F.col("sg_partido") == party) & F.col("colig").isNotNull())
        .select("ano", "sg_uf", F.col("colig").alias("colig_pt"))
        .distinct()
    )


def with_coalition(
    df: DataFrame,
    coalition: DataFrame,
    party: str = PARTY,
    *,
    fill_before_flag: bool = True,
    salts: int = 1,
) -> DataFrame:
    """Add ``colig``, ``colig_pt`` and ``is_colig_pt`` to candidates.

    A party outside any coalition is its own list. Whether that name is filled in before the flag
    is taken decides if the flag of such a party is 0 (municipality channel) or NULL (firm
    channel); in a state without a coalition of ``party`` it is NULL either way.
    """
    coalitions = coalition_map(coalition)
    joined = key_join(
        df, coalitions,
        {"ano": "ano", "sigla_uf": "sg_uf", "sigla_partido": "sg_partido"},
        match_nulls=("sigla_uf", "sigla_partido"), spread_by=("id_candidato_bd",), salts=salts,
    )
    joined = key_join(
        joined, party_coalitions(coalitions, party), {"ano": "ano", "sigla_uf": "sg_uf"},
        match_nulls=("sigla_uf",), spread_by=("id_candidato_bd",), salts=salts,
    )
    filled = F.coalesce(F.col("colig"), F.col("sigla_partido"))
    own = filled if fill_before_flag else F.col("colig")
    return joined.withColumn(
        "is_colig_pt", if_else(own == F.col("colig_pt"), F.lit(1), F.lit(0))
    ).withColumn("colig", filled)
