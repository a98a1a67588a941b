"""Number rules.

* A weighted sum reported as an integer rounds half to even, once. Weights are
  summed exactly, as decimals with the 13 places survey weights are published
  with, so neither the parallel summation order nor an earlier rounding
  decides on which side of a half the total lands.
* Where the analysis rounds explicitly first (``ROUND(x)``), it is half away
  from zero: ``round`` then cast.
* Division by zero gives NULL rather than an ANSI error (``try_divide``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _held(value: Column, kind: str, what: str) -> Column:
    """``value`` as ``kind``; a value it cannot hold fails the job, in any ANSI mode."""
    cast = value.try_cast(kind)
    return F.when(value.isNotNull() & cast.isNull(), F.raise_error(F.concat(
        F.lit(f"{what} does not fit {kind}: "), value.cast("string"))).cast(kind)).otherwise(cast)


def exact_weight(weight) -> Column:
    """A weight as the decimal it is written as, with 13 places; one it cannot hold (infinity, 1e26) is an error."""
    return _held(_c(weight), "decimal(38,13)", "weight")


def exact_limbs(weight, kind: T.DataType) -> list[Column]:
    """A weight as three longs whose sums are exact: units, and 7 and 6 of its 13 places.

    A double that is written with at most 8 places and 15 digits is k / 10^8
    for a whole k below 10^15, and is the only such decimal near it: its parts
    come from k in machine words. Any other weight is cut as a decimal. The
    places sum 10^11 rows before a long could overflow.
    """
    w = _c(weight)
    dec = exact_weight(w)
    units = _held(F.floor(dec), "bigint", "weight")
    places = (F.pmod(dec, F.lit(Decimal(1))) * F.lit(10 ** 13)).cast("bigint")      # a difference would lose places
    written = [units, F.floor(places / 10 ** 6), places % 10 ** 6]
    if not isinstance(kind, T.DoubleType):
        return written
    k = F.rint(w * F.lit(1e8))
    fits = (F.abs(k) < F.lit(1e15)) & (k / F.lit(1e8) == w)
    whole = F.floor(k / F.lit(1e8))            # exact: k has less than 16 digits
    part = k.cast("bigint") - whole * 10 ** 8
    return [F.when(fits, short).otherwise(long) for short, long in zip([whole, F.floor(part / 10), part % 10 * 10 ** 5], written)]


def limb_sum(units, high, low) -> Column:
    """Exact sum of weights given as ``exact_limbs`` (aggregate), with 13 places."""
    parts = zip((units, high, low), (Decimal(1), Decimal("0.0000001"), Decimal("0.0000000000001")))
    terms = [(F.sum(_c(c)).cast("decimal(19,0)") * F.lit(unit)).cast("decimal(34,13)") for c, unit in parts]
    return (terms[0] + terms[1] + terms[2]).cast("decimal(38,13)")


def exact_sum(weight, df: DataFrame | None = None) -> Column:
    """Exact sum of weights (aggregate); with the ``df`` it is taken over, in machine words where the weights allow."""
    if df is None:
        return F.sum(exact_weight(weight))
    return limb_sum(*exact_limbs(weight, df.select(_c(weight)).schema[0].dataType))


def bigint_half_even(x) -> Column:
    """Integer estimate, ties to even, rounded once (see module note)."""
    return F.bround(_c(x), 0).cast("bigint")


def bigint_half_up(x) -> Column:
    """X14 (explicit ``ROUND`` first): ties away from zero."""
    return F.round(_c(x), 0).cast("bigint")


def safe_ratio(num, den) -> Column:
    return F.try_divide(_c(num), _c(den))


def pct(part, whole, digits: int = 1) -> Column:
    """``round(100 * part / whole, digits)``; NULL when ``whole`` is 0 or NULL."""
    return F.round(F.try_divide(F.lit(100.0) * _c(part).cast("double"), _c(whole).cast("double")), digits)
