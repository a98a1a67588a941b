"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_even, exact_sum
from tabulare.functions.text import has_non_ascii


def _all():
    # The unpivoted profile has exactly one row per input column (bounded by
    # the schema), so a whole-frame window is safe here.
    return Window.partitionBy(F.lit(0))


def null_profile(df: DataFrame, digits: int = 4) -> DataFrame:
    """Percent NULL per column, with the mean and max over columns,
    the column's type, and the row and column counts — from one scan."""
    cols = df.columns
    dtypes = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = wide.unpivot(["_n"], cols, "coluna", "_frac")
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    per_col = long.select("coluna", types[F.col("coluna")].alias("tipo"),
                          (F.col("_frac") * 100).alias("_p"), F.col("_n").alias("n_linhas"))
    return per_col.select(
        "coluna", "tipo",
        F.round("_p", digits).alias("pct_nulos"),
        F.round(F.avg("_p").over(_all()), digits).alias("pct_nulos_media"),
        F.round(F.max("_p").over(_all()), digits).alias("pct_nulos_max"),
        "n_linhas",
        F.lit(len(cols)).cast("bigint").alias("n_colunas"),
    )


def dtype_histogram(df: DataFrame) -> dict[str, int]:
    """Column count per type (schema metadata only)."""
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return out


def benchmark_deviation(df: DataFrame, weight, benchmark: float, tolerance_pct: float = 5.0) -> DataFrame:
    """Weighted total vs an external figure; percent deviation and pass flag."""
    total = exact_sum(weight, df)
    dev = F.abs(total.cast("double") - F.lit(float(benchmark))) / F.lit(float(benchmark)) * 100
    return df.agg(
        bigint_half_even(total).alias("total_estimado"),
        F.lit(float(benchmark)).alias("referencia"),
        F.round(dev, 1).alias("desvio_pct"),
        (dev < F.lit(tolerance_pct)).alias("dentro_tolerancia"),
    )


def encoding_check(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column, whether any value has a non-ASCII code point."""
    cols = list(columns) if columns is not None else [c for c, t in df.dtypes if t == "string"]
    wide = df.agg(*[F.count(F.when(has_non_ascii(F.col(c)), 1)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "coluna", "n_nao_ascii")
    return long.select("coluna", (F.col("n_nao_ascii") > 0).alias("tem_nao_ascii"), "n_nao_ascii")
