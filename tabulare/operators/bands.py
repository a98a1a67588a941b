"""Income bands and affordability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_up, safe_ratio
from tabulare.operators.weighted import weighted_distribution

# Band bounds in multiples of the unit value (minimum wage) and
# the band labels; labels sort in band order.
BOUNDS = (1, 2, 3, 5, 10)
BAND_LABELS = ("0) sem informacao", "1) ate 1 SM", "2) 1-2 SM", "3) 2-3 SM",
               "4) 3-5 SM", "5) 5-10 SM", "6) 10+ SM")
UNIT_2025 = 1518.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(income, unit: float = UNIT_2025, bounds: Sequence[float] = BOUNDS,
         labels: Sequence[str] = BAND_LABELS) -> Column:
    """NULL → band 0; then ``income < b·unit`` for each bound; else the top band."""
    x = _c(income)
    expr = F.when(x.isNull(), F.lit(labels[0]))
    for b, lab in zip(bounds, labels[1:]):
        expr = expr.when(x < F.lit(float(b) * unit), F.lit(lab))
    return expr.otherwise(F.lit(labels[len(bounds) + 1]))


def band_distribution(df: DataFrame, income, weight, unit: float = UNIT_2025,
                      band_alias: str = "faixa", total_alias: str = "domicilios",
                      pct_alias: str = "pct") -> DataFrame:
    """Weighted share of households per band, in band order."""
    d = weighted_distribution(df.select(band(income, unit).alias(band_alias), _c(weight).alias("_w")),
                              band_alias, "_w", include_nulls=True, value_alias=band_alias,
                              total_alias=total_alias, pct_alias=pct_alias, ordered=False)
    return d.orderBy(band_alias)


def cumulative_pct(bands: DataFrame, band_col: str = "faixa", pct_col: str = "pct",
                   alias: str = "pct_acumulado") -> DataFrame:
    """Running sum of the already rounded percents, rounded again.

    Unpartitioned window, which is fine here: the input has at most
    ``len(BAND_LABELS)`` rows by construction.
    """
    spec = Window.orderBy(band_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bands.withColumn(alias, F.round(F.sum(pct_col).over(spec), 1))


def affordability(df: DataFrame, income, weight, price: float, unit: float = UNIT_2025,
                  band_alias: str = "faixa") -> DataFrame:
    """A15/A16 + F6: weighted mean income per band and the price as a percent of it."""
    src = df.where(_c(income).isNotNull()).select(
        band(income, unit).alias(band_alias), _c(income).alias("_x"), _c(weight).alias("_w"))
    g = src.groupBy(band_alias).agg(F.sum(F.col("_x") * F.col("_w")).alias("_xw"),
                                    F.sum("_w").alias("_sw"))
    mean = safe_ratio("_xw", "_sw")
    return g.select(
        band_alias,
        bigint_half_up(mean).alias("renda_media_mensal"),
        F.round(safe_ratio(F.lit(100.0 * price), mean), 0).alias("preco_pct_de_1_mes"),
    ).orderBy(band_alias)
