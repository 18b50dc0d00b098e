"""Column functions for categorical keys and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballotcredit.constants import ELECTED_LABELS


def compound_key(*parts: Column) -> Column:
    """Parts joined with a dot; NULL when any part is NULL."""
    pieces = [parts[0].cast("string")]
    for part in parts[1:]:
        pieces += [F.lit("."), part.cast("string")]
    return F.concat(*pieces)


def label(c: Column, labels: Mapping = ELECTED_LABELS) -> Column:
    """Text label of a code; a code without a label gives NULL."""
    text = None
    for code, name in labels.items():
        text = F.when(c == code, name) if text is None else text.when(c == code, name)
    return text
