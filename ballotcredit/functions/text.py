"""Column functions that clean names, identifiers and locale-formatted numbers.

All of them are built-in JVM expressions, so they stay inside the scan stage.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballotcredit.constants import PLACE_ALIASES

# Letters that fold to more than one ASCII letter.
MULTI_LETTER = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ",
}
# Letters and quotes without a canonical decomposition that fold to one ASCII character.
SINGLE_LETTER = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ŋ": "n", "Ŋ": "N",
    "‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "–": "-", "—": "-", " ": " ",
}
COMBINING_MARKS = "".join(chr(cp) for cp in range(0x0300, 0x0370))


def _decomposable_letters() -> dict[str, str]:
    """Accented Latin letters whose canonical decomposition starts with an ASCII letter."""
    table = {}
    for cp in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base.isascii() and base.isalpha():
            table[chr(cp)] = base
    return table


_FOLD = {**_decomposable_letters(), **SINGLE_LETTER}
_FOLD_FROM = "".join(_FOLD) + COMBINING_MARKS  # translate() deletes what has no counterpart
_FOLD_TO = "".join(_FOLD.values())


def fold_accents(c: Column) -> Column:
    """Latin text to ASCII: ``São João`` becomes ``Sao Joao``."""
    replaced = c
    for letter, ascii_letters in MULTI_LETTER.items():
        replaced = F.replace(replaced, F.lit(letter), F.lit(ascii_letters))
    # Few texts hold such a letter; the others are passed over once.
    several = F.when(c.rlike(f"[{''.join(MULTI_LETTER)}]"), replaced).otherwise(c)
    folded = F.translate(several, _FOLD_FROM, _FOLD_TO)
    # One byte per character means plain ASCII: nothing to fold.
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def letters_and_digits(c: Column) -> Column:
    """Drop everything but Unicode letters and digits."""
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{IsDigit}]+", "")


def strip_punctuation(c: Column) -> Column:
    """Drop Unicode punctuation; symbols such as ``+`` and ``$`` stay."""
    return F.regexp_replace(c, r"\p{P}+", "")


def normalize_name(c: Column) -> Column:
    """Comparable place name: folded to ASCII, upper case, letters and digits only."""
    return letters_and_digits(F.upper(fold_accents(c)))


def fix_spelling(c: Column, aliases: dict[str, str] = PLACE_ALIASES) -> Column:
    """Replace whole values listed in ``aliases``; NULL stays NULL."""
    fixed = c
    for wrong, right in aliases.items():
        fixed = F.when(c == wrong, F.lit(right)).otherwise(fixed)
    return fixed


def birth_place(c: Column) -> Column:
    """Birth municipality: folded, upper case, spelling fixed, letters and digits only."""
    return letters_and_digits(fix_spelling(F.upper(fold_accents(c))))


def parse_tax_id(c: Column) -> Column:
    """Tax id as a number (leading zeros are lost); text that is no number gives NULL."""
    return strip_punctuation(c).try_cast("bigint")


def tax_id_digits(c: Column) -> Column:
    """How many digits the id was written with; tells a person's id from a company's."""
    return F.length(F.regexp_replace(c, r"\P{IsDigit}", ""))


def parse_decimal(
    c: Column, decimal_mark: str = ",", grouping_mark: str = ".", to: str = "decimal(18,2)"
) -> Column:
    """Locale-formatted number such as ``1.234,56``; text that is no number gives NULL."""
    plain = F.replace(c, F.lit(grouping_mark), F.lit("")) if grouping_mark else c
    if decimal_mark != ".":
        plain = F.replace(plain, F.lit(decimal_mark), F.lit("."))
    return F.trim(plain).try_cast(to)
