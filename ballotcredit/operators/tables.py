"""Tables made from parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def parameter_table(spark: SparkSession, schema: dict[str, str], rows: Sequence[tuple]) -> DataFrame:
    """A table of literal rows, marked for broadcast: its size is set by the caller's parameters."""
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in schema.items())
    return F.broadcast(
        spark.sql(f"SELECT {typed} FROM VALUES {values} AS rows({', '.join(schema)})")
    )
