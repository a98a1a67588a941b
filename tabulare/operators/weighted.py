"""Weighted population estimates.

A weight is an expansion factor, so ``sum(weight)`` estimates a population.
Shares of the grand total use a scalar subquery over the already grouped
result (one value, evaluated once and shipped to every task) instead of
``sum(sum(w)) OVER ()``, which would move every group into one partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_even, exact_limbs, exact_sum, limb_sum, pct


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weighted_total(df: DataFrame, weight, alias: str = "total") -> DataFrame:
    """A1: one row, the weighted total rounded half-even to BIGINT."""
    return df.agg(bigint_half_even(exact_sum(weight, df)).alias(alias))


def weighted_distribution(df: DataFrame, value, weight, include_nulls: bool = False,
                          value_alias: str = "valor", total_alias: str = "total",
                          pct_alias: str = "pct", digits: int = 1,
                          ordered: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """A2/A3 + W1 + F1: per value, weighted total and percent of the grand total.

    ``include_nulls=False`` treats NULL as non-response (left out of the
    denominator); ``True`` keeps NULL as one group (not applicable = "no").
    ``by`` computes a separate distribution (own denominator) per group.
    """
    src = df if include_nulls else df.where(_c(value).isNotNull())
    keys = [F.col(b) for b in by]
    grouped = src.groupBy(*keys, _c(value).alias(value_alias)).agg(exact_sum(weight, src).alias("_w"))
    if by:
        # totals per group, joined back: no group's values ever meet in one task
        totals = grouped.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(F.sum("_w").alias("_t"))
        same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
        grouped, grand = grouped.join(totals, same), F.col("_t")
    else:
        grand = grouped.agg(F.sum("_w")).scalar()
    out = grouped.select(
        *keys, value_alias,
        bigint_half_even("_w").alias(total_alias),
        pct("_w", grand, digits).alias(pct_alias),
        "_w",
    )
    if ordered:  # L1: largest first; the value breaks ties so the order is total
        out = out.orderBy(*keys, F.col("_w").desc(), F.col(value_alias).asc_nulls_last())
    return out.drop("_w")


def top_categories(df: DataFrame, value, weight, k: int = 6, **kw) -> DataFrame:
    """L4: the ``k`` largest groups of a weighted distribution."""
    return weighted_distribution(df, value, weight, ordered=True, **kw).limit(k)


_PARTS = ["_units", "_high", "_low"]


def _long(df: DataFrame, attributes: Sequence[str], weight, attr_alias: str, value_alias: str) -> DataFrame:
    """One row per row and attribute, with the weight's parts (taken once per row, not once per attribute)."""
    parts = exact_limbs(weight, df.select(_c(weight)).schema[0].dataType)
    wide = df.select(*[c.alias(n) for c, n in zip(parts, _PARTS)], *[_c(a).cast("string").alias(a) for a in attributes])
    return wide.unpivot(_PARTS, list(attributes), attr_alias, value_alias)


def weighted_modes(df: DataFrame, attributes: Sequence[str], weight,
                   include_nulls: bool = False, attr_alias: str = "atributo",
                   value_alias: str = "valor", total_alias: str = "total",
                   pct_alias: str = "pct", digits: int = 1) -> DataFrame:
    """A4 + L3: for every attribute, its weighted most frequent value.

    One pass for all attributes: unpivot to (attribute, value), aggregate once,
    then pick the top value per attribute with ``min(struct(-total, value))`` —
    an ordinary partial aggregate, so a high-cardinality or skewed attribute
    never has to sit in one task. Ties go to the smaller value text.
    """
    long = _long(df, attributes, weight, attr_alias, value_alias)
    if not include_nulls:
        long = long.where(F.col(value_alias).isNotNull())
    per_value = long.groupBy(attr_alias, value_alias).agg(limb_sum(*_PARTS).alias("_w"))
    best = per_value.groupBy(attr_alias).agg(
        F.min(F.struct((-F.col("_w")).alias("neg"), F.col(value_alias).alias("v"))).alias("_best"),
        F.sum("_w").alias("_t"),
    )
    return best.select(
        attr_alias,
        F.col("_best.v").alias(value_alias),
        bigint_half_even(-F.col("_best.neg")).alias(total_alias),
        pct(-F.col("_best.neg"), "_t", digits).alias(pct_alias),
    )


def weighted_distributions(df: DataFrame, attributes: Sequence[str], weight,
                           top: int | None = None, include_nulls: bool = False,
                           attr_alias: str = "atributo", value_alias: str = "valor",
                           total_alias: str = "total", pct_alias: str = "pct",
                           digits: int = 1) -> DataFrame:
    """A2 + L4 for several attributes in one pass (long format).

    Unpivot to (attribute, value), aggregate once, divide by each attribute's
    total (a table with one row per attribute, so its broadcast is bounded by
    the attribute list), and keep the ``top`` largest values per attribute
    with ``row_number() <= top`` (limited on the map side before the shuffle).
    """
    long = _long(df, attributes, weight, attr_alias, value_alias)
    if not include_nulls:
        long = long.where(F.col(value_alias).isNotNull())
    per_value = long.groupBy(attr_alias, value_alias).agg(limb_sum(*_PARTS).alias("_w"))
    totals = per_value.groupBy(attr_alias).agg(F.sum("_w").alias("_t"))
    # one row per listed attribute: bounded by construction, no count needed
    out = per_value.join(F.broadcast(totals), attr_alias).select(
        attr_alias, value_alias, "_w",
        bigint_half_even("_w").alias(total_alias),
        pct("_w", "_t", digits).alias(pct_alias))
    if top is not None:
        spec = Window.partitionBy(attr_alias).orderBy(F.col("_w").desc(),
                                                      F.col(value_alias).asc_nulls_last())
        out = out.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") <= top).drop("_rn")
    return out.drop("_w")


def filtered_ratio(weight, numerator: Column, denominator: Column, digits: int = 1) -> Column:
    """A5 + F5 as an aggregate ``Column``: ``100·Σw[num] / Σw[den]``.

    A NULL condition counts as false (``FILTER (WHERE …)`` semantics).
    """
    w = _c(weight)
    return pct(F.sum(F.when(numerator, w)), F.sum(F.when(denominator, w)), digits)


def share_true(weight, flag) -> Column:
    """``pct_sim``: weighted percent TRUE among rows where the flag is known."""
    f = _c(flag)
    return filtered_ratio(weight, f == F.lit(True), f.isNotNull())


def flag_shares(df: DataFrame, weight, flags: Mapping[str, Column] | Sequence[str],
                name_alias: str = "atributo", yes_alias: str = "pct_sim",
                no_alias: str = "pct_nao") -> DataFrame:
    """Percent TRUE and its complement for a list of boolean flags.

    One aggregate over all flags (one scan), then unpivot the one-row result.
    """
    if not isinstance(flags, Mapping):
        flags = {f: F.col(f) for f in flags}
    wide = df.agg(*[share_true(weight, c).alias(n) for n, c in flags.items()])
    long = wide.unpivot([], list(flags), name_alias, yes_alias)
    return long.select(name_alias, yes_alias,
                       F.round(F.lit(100.0) - F.col(yes_alias), 1).alias(no_alias))


def count_by(df: DataFrame, *keys, alias: str = "n") -> DataFrame:
    """Row count per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))
