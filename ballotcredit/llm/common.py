"""Column names, columns and words shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.sources.sinks import written

# The white space of a text, code points 9 to 13 and 32.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it (letter case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names, letter case aside: results take their place."""
    gone = {n.lower() for n in names}
    return df.select([column(df, c) for c in df.columns if c.lower() not in gone])


def raw_texts(values: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, missing ones empty. Bytes lower-case A-Z alone and split at white space."""
    return [b"" if t is None else t for t in values.cast(pa.binary()).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# Fixed value: Spark's setting that deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_clean(df: DataFrame) -> DataFrame:
    """``written``, with the shuffle files of the write deleted at its end: the table has the rows,
    and the files would stay until the driver's JVM collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)
