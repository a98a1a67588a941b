"""The flagship query: harmonized union → household grain → distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulare.operators import household, weighted
from tabulare.plans.q_harmonize import MORADOR_SQL, morador
from tabulare.plans.registry import register

# The household's representative is its first person by these columns. The
# order is total for the columns kept (two persons equal on all of them give
# the same output), and ordering by nothing else lets the other columns be
# pruned before the shuffle.
_ORDER = ("peso", "idade", "sexo", "cor_raca", "agua")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted share of households by water supply, per source."""
    people = morador(spark, sf_dir).select("fonte", "id_domicilio", *_ORDER)
    homes = household.first_row(people, ["fonte", "id_domicilio"], list(_ORDER))   # ASC NULLS LAST
    return weighted.weighted_distribution(homes, "agua", "peso", by=["fonte"])


_HOMES_SQL = ("(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fonte, id_domicilio ORDER BY "
              + ", ".join(f"{c} ASC NULLS LAST" for c in _ORDER)
              + f") AS rn FROM {MORADOR_SQL} m) x WHERE rn = 1) h")
register("household_water_distribution",
         "SELECT fonte, agua AS valor, CAST(CAST(SUM(CAST(CAST(peso AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS total, "
         "ROUND(100.0 * SUM(peso) / SUM(SUM(peso)) OVER (PARTITION BY fonte), 1) AS pct "
         f"FROM {_HOMES_SQL} WHERE agua IS NOT NULL GROUP BY fonte, agua")(flagship)
