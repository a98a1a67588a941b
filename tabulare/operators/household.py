"""Household grain.

Person rows carry their household's fields; these operators check and
collapse that to one row per household.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_even, exact_weight


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sort(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def household_key(*parts) -> Column:
    """Parts joined by ``_``; numbers as plain text (no zero padding).

    NULL-propagating like SQL ``||`` (``concat``, not ``concat_ws``).
    """
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit("_"))
        pieces.append(_c(p).cast("string"))
    return F.concat(*pieces)


def count_distinct_households(df: DataFrame, key, alias: str = "n_domicilios") -> DataFrame:
    """Exact distinct count (two-phase aggregate, shuffles on the key)."""
    return df.agg(F.count_distinct(_c(key)).alias(alias))


def household_bitmaps(df: DataFrame, by: str, number) -> DataFrame:
    """A9 mergeable: ``by, bucket, households``, the household numbers of each state as bitmaps.

    ``number`` is a non-negative long, best dense (its range of 32,768 is one
    bitmap of 4 KB). Bitmaps of states, loads or days merge exactly with
    ``count_bitmaps``, without the persons.
    """
    k = _c(number)
    return df.where(k.isNotNull()).groupBy(by, F.bitmap_bucket_number(k).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("households"))


def count_bitmaps(bitmaps: DataFrame, by: str | None = None, alias: str = "n_domicilios") -> DataFrame:
    """Exact distinct count from ``household_bitmaps``, per ``by`` or over all: a household of two states counts once."""
    keys = [by] if by else []
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("households")).alias("_n"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(alias))


def weight_consistency(df: DataFrame, key, weight) -> DataFrame:
    """A10: households whose weight is not constant across their persons.

    ``COUNT(DISTINCT w) > 1`` equals ``min(w) <> max(w)`` (both ignore NULLs);
    the second is a plain partial aggregate with no distinct expansion.
    """
    per_key = df.groupBy(_c(key).alias("_k")).agg(
        (F.min(_c(weight)) != F.max(_c(weight))).alias("_varies"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_domicilios"),
        F.count(F.when(F.col("_varies"), 1)).alias("n_peso_divergente"),
    )


def collapse(df: DataFrame, key, columns: Sequence[str], key_alias: str | None = None) -> DataFrame:
    """One row per household, each column's first non-NULL value.

    Meant for columns constant within the household (check with A10 first).
    ``any_value`` is a partial aggregate, so a huge household is reduced on
    the map side before the shuffle.
    """
    k = _c(key) if key_alias is None else _c(key).alias(key_alias)
    return df.groupBy(k).agg(*[F.any_value(F.col(c), True).alias(c) for c in columns])


def first_row(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``DISTINCT ON (key) … ORDER BY key, order…`` — the whole first row.

    ``order`` entries are sort expressions or column names; a name means
    ascending with NULLs last (the SQL engines' default, not Spark's). The
    order must be total within the key for a deterministic result.
    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task sends at most one row per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spec = Window.partitionBy(*keys).orderBy(*_sort(order))
    return (df.withColumn("_rn", F.row_number().over(spec))
            .where(F.col("_rn") == 1).drop("_rn"))


def first_n(df: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """L5 per group: the first ``n`` rows of every key (map-side group limit)."""
    spec = Window.partitionBy(key).orderBy(*_sort(order))
    return (df.withColumn("_rn", F.row_number().over(spec))
            .where(F.col("_rn") <= n).drop("_rn"))


def grain_totals(persons: DataFrame, key, weight) -> DataFrame:
    """The same weight summed per household and per person, side by side, in one pass.

    A household counts once with its persons' (constant) weight; ``any_value``
    and the person sum are partial aggregates of the same grouping.
    """
    w = exact_weight(weight)
    per_home = persons.groupBy(_c(key).alias("_k")).agg(F.any_value(w, True).alias("_home"), F.sum(w).alias("_people"))
    return per_home.agg(bigint_half_even(F.sum("_home")).alias("domicilios_estimados"),
                        bigint_half_even(F.sum("_people")).alias("pessoas_estimadas"))
