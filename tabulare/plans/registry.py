"""Query registry: name → ``fn(spark, sf_dir) -> DataFrame`` and name → DuckDB SQL.

Every query reads the driver tables (or data Spark derives from them) in
full. Queries whose operator writes (stores, archives, fixed-width files)
write below the session's shared scratch folder and return what they read
back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def exact_sql(weight: str) -> str:
    """Exact weighted sum: every weight as the decimal it is written as."""
    return f"SUM(CAST(CAST({weight} AS VARCHAR) AS DECIMAL(38, 13)))"


def whole_sql(total: str) -> str:
    """An exact total rounded once, half to even."""
    return f"CAST(CAST({total} AS DOUBLE) AS BIGINT)"


def dist_sql(value: str, weight: str, source: str, include_nulls: bool = False,
             value_alias: str = "valor", total_alias: str = "total", pct_alias: str = "pct") -> str:
    where = "" if include_nulls else f"WHERE {value_alias} IS NOT NULL"
    return (f"SELECT {value_alias}, {whole_sql(exact_sql('w'))} AS {total_alias}, "
            f"ROUND(100.0 * SUM(w) / SUM(SUM(w)) OVER (), 1) AS {pct_alias} "
            f"FROM (SELECT {value} AS {value_alias}, {weight} AS w FROM {source}) t "
            f"{where} GROUP BY {value_alias}")


# import the query modules so they register themselves
from tabulare.plans import q_analysis, q_harmonize, q_ingest, q_store, flagship  # noqa: E402,F401
