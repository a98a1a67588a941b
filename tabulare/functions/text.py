"""Text helpers (X1, X2, X5–X8, X11, X12) as Spark ``Column`` expressions.

Everything stays in the JVM. Spark SQL has no Unicode NFKD normalization, and
names must equal what NFKD + ASCII-ignore gives: that is a table over single
characters, made once from the Unicode data.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulare.functions.codes import TRUE_TOKENS

# Fixed value: the pattern must cut headings exactly as the survey layouts need.
# A heading ends at ": " or where a category list starts (" 1- ", " 12 – ").
HEADING_END = r":\s*|\s+\d+\s*[-–]\s*"
_NOT_ALNUM = r"[^a-z0-9]+"
# Strings Python's float() accepts (decimal point already normalized to ".").
_FLOAT_TEXT = (r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)"
               r"([eE][+-]?\d+(_\d+)*)?\s*$")
_FLOAT_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
# Strings Python's int() accepts.
_INT_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
NON_ASCII = r"[^\x00-\x7F]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------
# Driver-side versions, for layout metadata (a few hundred names at most)
# --------------------------------------------------------------------------
def fold_ascii_py(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def slug_py(text, heading: bool = False) -> str:
    """Snake-case name of a layout description; '' for NULL/blank.

    ``heading=True`` (census rule) keeps only the part before the first
    ``: `` / ``n-`` marker and lower-cases before folding accents; the PNADC
    rule folds first and keeps the whole text.
    """
    if not isinstance(text, str) or text.strip() == "":
        return ""
    if heading:
        text = re.split(HEADING_END, text, maxsplit=1)[0].strip()
        text = fold_ascii_py(text.lower())
    else:
        text = fold_ascii_py(text).lower()
    return re.sub(_NOT_ALNUM, "_", text).strip("_")


# --------------------------------------------------------------------------
# Column versions
# --------------------------------------------------------------------------
@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What NFKD leaves of every character in ASCII: one character (as two aligned strings) or several.

    NFKD maps each code point by itself, but for the order of marks, of which
    none is ASCII; so this table and the rule that every other non-ASCII
    character goes are the whole normalization.
    """
    one, several = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "\ud800" <= c <= "\udfff":          # halves of pairs are no characters
            continue
        left = fold_ascii_py(c)
        if left:
            (one if len(left) == 1 else several)[c] = left
    return "".join(one), "".join(one.values()), several


def fold(text) -> Column:
    """NFKD, then drop every non-ASCII code point (accents go, letters stay).

    All in the JVM: a table made from the Unicode data of this Python, applied
    by ``translate``; the few characters that become several (ligatures,
    fractions, units) by a map, in strings that have any. ASCII text is left as it is.
    """
    t = _c(text)
    chars, letters, several = _folds()
    plain = F.translate(t, chars, letters)
    table = F.str_to_map(F.lit("\x01".join(map("\x02".join, several.items()))), F.lit("\x01"), F.lit("\x02"))      # folded to a constant
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    plain = F.when(plain.rlike("[" + "".join(several) + "]"), spelled).otherwise(plain)
    return F.when(t.rlike(NON_ASCII), F.regexp_replace(plain, NON_ASCII, "")).otherwise(t)


def _finish_slug(folded_lower: Column) -> Column:
    out = F.regexp_replace(folded_lower, _NOT_ALNUM, "_")
    out = F.regexp_replace(out, r"^_+|_+$", "")
    return F.coalesce(out, F.lit(""))


def slug_heading(text) -> Column:
    """X1 (census): heading cut, lower, fold, non-alphanumerics → ``_``."""
    head = F.split(_c(text), HEADING_END, 2).getItem(0)
    return _finish_slug(fold(F.lower(head)))


def slug(text) -> Column:
    """X2 (PNADC): as X1 without the heading cut; folds before lower-casing."""
    return _finish_slug(F.lower(fold(_c(text))))


# Each parser is SQL text over an expression's text; the Column forms wrap it.
def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decimal_comma_sql(v: str) -> str:
    """``"85,5"`` → 85.5; text Python's ``float`` rejects → NULL.

    ``try_cast`` alone is too lenient (it reads ``"5d"`` as 5.0), hence the guard.
    """
    dotted = f"regexp_replace({v}, ',', '.')"
    return (f"CASE WHEN {v} IS NULL OR {v} = '' THEN CAST(NULL AS DOUBLE) "
            f"WHEN {dotted} RLIKE {_sql_str(_FLOAT_TEXT)} OR {dotted} RLIKE {_sql_str(_FLOAT_SPECIAL)} "
            f"THEN try_cast(regexp_replace({dotted}, '_', '') AS DOUBLE) END")


def int_strict_sql(v: str, to: str = "int") -> str:
    """Integer text → int; ``"3.0"``, ``"3 rooms"`` → NULL."""
    return (f"CASE WHEN {v} IS NULL OR {v} = '' THEN CAST(NULL AS {to}) "
            f"WHEN {v} RLIKE {_sql_str(_INT_TEXT)} THEN try_cast(regexp_replace({v}, '_', '') AS {to}) END")


def token_flag_sql(v: str, tokens=TRUE_TOKENS) -> str:
    """NULL/empty → NULL, else membership in the (case-sensitive) token set."""
    toks = ", ".join(_sql_str(x) for x in tokens)
    return f"CASE WHEN {v} IS NULL OR {v} = '' THEN CAST(NULL AS BOOLEAN) ELSE {v} IN ({toks}) END"


def parse_decimal_comma(text: str) -> Column:
    """``decimal_comma_sql`` of a column given by name (or SQL text)."""
    return F.expr(decimal_comma_sql(text))


def parse_int_strict(text: str, to: str = "int") -> Column:
    return F.expr(int_strict_sql(text, to))


def token_flag(text: str, tokens=TRUE_TOKENS) -> Column:
    return F.expr(token_flag_sql(text, tokens))


def first_match(text, pattern: str, ignore_case: bool = True) -> Column:
    """X11: first match of ``pattern`` in the text, NULL if none."""
    rx = ("(?i)" if ignore_case else "") + pattern
    return F.regexp_substr(_c(text), F.lit(rx))


def has_non_ascii(text) -> Column:
    """Any code point outside 0x00–0x7F."""
    return _c(text).rlike(NON_ASCII)
