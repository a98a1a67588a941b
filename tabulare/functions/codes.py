"""Code → label tables of the two surveys and the ``Column`` builders for them.

The tables are fixed values: they must equal the published survey codes, so
they are written out plainly, in code order.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (survey code tables). Do not edit: results depend on them.
# ---------------------------------------------------------------------------
SITUACAO = {1: "urbana", 2: "rural"}
SEXO = {1: "masculino", 2: "feminino"}
COR_RACA = {1: "branca", 2: "preta", 3: "amarela", 4: "parda", 5: "indigena", 9: "ignorada"}
AGUA_CENSO = {1: "rede_geral", 2: "poco_nascente", 3: "poco_nascente", 4: "carro_pipa",
              5: "chuva", 6: "chuva", 7: "rio_lago", 9: "poco_nascente", 10: "poco_nascente"}
AGUA_PNADC = {1: "rede_geral", 2: "poco_artesiano", 3: "poco_raso", 4: "fonte_nascente",
              5: "chuva"}
ESGOTO_CENSO = {1: "rede_geral", 2: "fossa_septica", 3: "fossa_rudimentar", 4: "vala",
                5: "rio_lago_mar"}
ESGOTO_PNADC = {1: "rede_geral", 2: "fossa_septica_ligada", 3: "fossa_septica_nao_ligada",
                4: "fossa_rudimentar", 5: "vala", 6: "rio_lago_mar"}
ENERGIA_CENSO = {1: "sim", 2: "sim", 3: "nao"}
ENERGIA_PNADC = {1: "sim", 2: "nao"}
COMBUSTIVEL = {1: "gas_botijao", 2: "gas_encanado", 3: "lenha_carvao", 4: "energia_eletrica",
               5: "outro"}
# display labels of the urban/rural code in the household analysis
SITUACAO_ROTULO = {1: "Urbana", 2: "Rural"}
NEGOCIO = {"Venda": "venda", "Aluguel": "aluguel", "Temporada": "temporada"}
# default label of the many-to-one tables (water, sewage); NULL codes get it too
OUTRO = "outro"
# state number -> abbreviation (27 states); unknown numbers are dropped
UF_CODES = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}
UFS = tuple(sorted(UF_CODES.values()))
# truthy tokens of a listing amenity (case-sensitive)
TRUE_TOKENS = ("Sim", "Yes", "true", "1")
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def label_sql(code: str, mapping: Mapping, default: str | None = None) -> str:
    """The SQL text of ``label`` for a column given by name."""
    by_label: dict[str, list] = {}
    for k, v in mapping.items():
        by_label.setdefault(v, []).append(k)
    whens = " ".join(
        f"WHEN {code} IN ({', '.join(_sql_literal(k) for k in keys)}) THEN {_sql_literal(lab)}"
        for lab, keys in by_label.items())
    tail = f" ELSE {_sql_literal(default)}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def label(code: str, mapping: Mapping, default: str | None = None) -> Column:
    """``CASE code WHEN k THEN v ... [ELSE default] END``.

    Codes sharing a label become one ``IN`` branch. With a default, a NULL code
    also gets the default (SQL ``ELSE`` semantics), as the water/sewage tables do.
    ``code`` is a column name or SQL text.
    """
    return F.expr(label_sql(code, mapping, default))


def label_or_code(code: str, mapping: Mapping) -> Column:
    """The label when known, else the code as text (NULL stays NULL)."""
    return F.expr(f"coalesce({label_sql(code, mapping)}, CAST({code} AS STRING))")


def flag_eq(code, value=1) -> Column:
    """``code = value`` with SQL three-valued logic (NULL -> NULL)."""
    return _c(code) == F.lit(value)


def flag_in(code, values: Iterable) -> Column:
    return _c(code).isin(list(values))


def flag_any(*conds: Column) -> Column:
    """``a OR b`` — TRUE if any is TRUE, NULL if none TRUE and one NULL."""
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
