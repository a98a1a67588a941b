"""Row filters with the reference's conventions.

On partition columns these become partition filters, so the pruned
directories are never listed or opened.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_source(df: DataFrame, fonte: str, column: str = "fonte") -> DataFrame:
    """rows of one source."""
    return df.where(F.col(column) == F.lit(fonte))


def filter_in(df: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """membership in a set; ``None`` or empty keeps every row."""
    vals = list(values) if values else []
    return df.where(F.col(column).isin(vals)) if vals else df


def filter_states(df: DataFrame, ufs: Iterable[str] | None, column: str = "uf") -> DataFrame:
    return filter_in(df, column, ufs)


def with_known_state(df: DataFrame, column: str = "uf") -> DataFrame:
    """drop rows without a usable state (NULL or empty)."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))
