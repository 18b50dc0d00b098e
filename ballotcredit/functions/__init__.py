"""Column functions."""

from ballotcredit.functions.keys import compound_key, label
from ballotcredit.functions.numeric import (
    if_else,
    log_one_plus,
    magnitude,
    na_sum,
    nan_to_null,
    safe_ratio,
    stars,
    zero_if_missing,
)
from ballotcredit.functions.text import (
    birth_place,
    fix_spelling,
    fold_accents,
    letters_and_digits,
    normalize_name,
    parse_decimal,
    parse_tax_id,
    strip_punctuation,
    tax_id_digits,
)

__all__ = [
    "birth_place", "compound_key", "fix_spelling", "fold_accents", "if_else",
    "label", "letters_and_digits", "log_one_plus", "magnitude", "na_sum", "nan_to_null",
    "normalize_name", "parse_decimal", "parse_tax_id", "safe_ratio", "stars",
    "strip_punctuation", "tax_id_digits", "zero_if_missing",
]
