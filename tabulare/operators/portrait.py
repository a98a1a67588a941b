"""The household portrait: most common characteristics of a household (one source).

The notebook version runs one ``DISTINCT ON`` view plus one query per
attribute. Here it is one plan: rows of the source → one representative
person per household → weighted distributions of every attribute from a
single aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabulare.operators.filters import filter_source
from tabulare.operators.household import first_row
from tabulare.operators.weighted import weighted_distributions

# attributes described per household (labels already harmonized)
PORTRAIT_ATTRIBUTES = ("situacao", "n_moradores", "n_comodos", "n_dormitorios", "n_banheiros",
                       "agua", "esgoto", "energia", "combustivel_cozinha")


def household_portrait(morador: DataFrame, fonte: str,
                       attributes: Sequence[str] = PORTRAIT_ATTRIBUTES, weight: str = "peso",
                       top: int | None = None) -> DataFrame:
    """Long format (atributo, valor, total, pct), NULLs left out per attribute.

    A household is represented by its first person ordered by the weight and
    then every kept column, a total order for the output (the notebook's
    ``DISTINCT ON`` leaves the choice to the engine).
    """
    cols = [weight, *attributes]
    people = filter_source(morador, fonte).select("id_domicilio", *cols)
    homes = first_row(people, "id_domicilio", cols)      # ascending, NULLs last
    return weighted_distributions(homes, list(attributes), weight, top=top)
