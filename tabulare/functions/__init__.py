"""Column-level helpers. Everything here returns a ``Column`` evaluated in the JVM."""

from tabulare.functions.numeric import bigint_half_even, bigint_half_up, exact_sum, pct, safe_ratio
from tabulare.functions.codes import label, label_or_code, flag_eq, flag_in, flag_any
from tabulare.functions.text import (
    fold, slug, slug_heading, parse_decimal_comma, parse_int_strict,
    token_flag, first_match, has_non_ascii,
)

__all__ = [
    "bigint_half_even", "bigint_half_up", "exact_sum", "pct", "safe_ratio",
    "label", "label_or_code", "flag_eq", "flag_in", "flag_any",
    "fold", "slug", "slug_heading", "parse_decimal_comma", "parse_int_strict",
    "token_flag", "first_match", "has_non_ascii",
]
