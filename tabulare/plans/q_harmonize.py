"""Harmonized ``morador`` queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulare.functions import codes
from tabulare.operators import harmonize as H
from tabulare.operators import filters, weighted
from tabulare.operators.portrait import PORTRAIT_ATTRIBUTES, household_portrait
from tabulare.functions.numeric import bigint_half_even, exact_sum
from tabulare.plans.registry import register
from tabulare.plans.standins import (
    HOUSEHOLD_FIELDS, HOUSEHOLD_KEYS, HOUSEHOLD_STATE_FIELDS, LOOKUP_REGIONS_EXCLUDED,
    ORDERS_WITH_STATE_SQL, PERSON_FIELDS, PNADC_FIELDS, case_sql, households, persons,
    pnadc_persons, select_sql, table,
)
from tabulare.schemas import MORADOR_COLUMNS

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def morador(spark, d, full_schema: bool = False):
    census = H.census_to_morador(persons(spark, d), households(spark, d, with_state=True))
    pnadc = H.pnadc_to_morador(pnadc_persons(spark, d), 2025)
    return H.harmonize(census, pnadc, full_schema=full_schema)


# -- oracle: the same load written as SQL --------------------------------------
_CENSUS_SQL = f"""
SELECT 'IBGE' AS provedor, 'census_2010' AS fonte, 2010 AS ano, d.uf AS uf, p.peso_amostral AS peso,
  {case_sql('d.situacao_do_domicilio', codes.SITUACAO)} AS situacao,
  d.uf || '_' || CAST(d.area_de_ponderacao AS VARCHAR) || '_' || CAST(d.controle AS VARCHAR) AS id_domicilio,
  d.comodos_numero AS n_comodos, d.comodos_como_dormitorio_numero AS n_dormitorios,
  d.quantas_pessoas_moravam_neste_domicilio_em_31_de_julho_de_2010 AS n_moradores,
  d.banheiros_de_uso_exclusivo_numero AS n_banheiros, d.valor_do_aluguel_em_reais AS valor_aluguel,
  d.rendimento_mensal_domiciliar_em_julho_de_2010 AS rendimento_domiciliar,
  d.rendimento_domiciliar_per_capita_em_julho_de_2010 AS rendimento_per_capita,
  {case_sql('d.abastecimento_de_agua_forma', codes.AGUA_CENSO, codes.OUTRO)} AS agua,
  {case_sql('d.esgotamento_sanitario_tipo', codes.ESGOTO_CENSO, codes.OUTRO)} AS esgoto,
  {case_sql('d.energia_eletrica_existencia', codes.ENERGIA_CENSO)} AS energia,
  d.geladeira_existencia = 1 AS geladeira, d.maquina_de_lavar_roupa_existencia = 1 AS maquina_lavar,
  d.microcomputador_com_acesso_a_internet_existencia = 1 AS internet,
  (d.automovel_para_uso_particular_existencia = 1 OR d.motocicleta_para_uso_particular_existencia = 1)
    AS auto_moto,
  d.codigo_do_municipio AS municipio,
  {case_sql('p.sexo', codes.SEXO)} AS sexo, p.variavel_auxiliar_da_idade_calculada_em_anos AS idade,
  {case_sql('p.cor_ou_raca', codes.COR_RACA)} AS cor_raca, NULL AS combustivel_cozinha
FROM (SELECT {select_sql(PERSON_FIELDS)} FROM lineitem) p
JOIN (SELECT {select_sql({**HOUSEHOLD_KEYS, **HOUSEHOLD_FIELDS, **HOUSEHOLD_STATE_FIELDS})}
      FROM {ORDERS_WITH_STATE_SQL}) d
  ON p.area_de_ponderacao = d.area_de_ponderacao AND p.controle = d.controle"""

_PNADC_SQL = f"""
SELECT 'IBGE' AS provedor, 'pnadc_2025' AS fonte, 2025 AS ano, uf, peso_com_calibracao AS peso,
  {case_sql('tipo_de_situacao_da_regiao', codes.SITUACAO)} AS situacao,
  CAST(upa AS VARCHAR) || '_' || CAST(numero_de_selecao_do_domicilio AS VARCHAR) || '_'
    || CAST(painel AS VARCHAR) AS id_domicilio,
  numero_de_comodos AS n_comodos, numero_de_dormitorios AS n_dormitorios,
  numero_de_pessoas_no_domicilio AS n_moradores, numero_de_banheiros_exclusivos_dos_moradores AS n_banheiros,
  valor_do_aluguel_mensal AS valor_aluguel, rendimento_habitual_domiciliar_mensal AS rendimento_domiciliar,
  rendimento_habitual_domiciliar_per_capita_mensal AS rendimento_per_capita,
  {case_sql('principal_forma_de_abastecimento_de_agua', codes.AGUA_PNADC, codes.OUTRO)} AS agua,
  {case_sql('destino_do_esgoto_do_banheiro', codes.ESGOTO_PNADC, codes.OUTRO)} AS esgoto,
  {case_sql('origem_da_energia_eletrica', codes.ENERGIA_PNADC)} AS energia,
  domicilio_possui_geladeira IN (1, 2) AS geladeira,
  domicilio_possui_maquina_de_lavar_roupa = 1 AS maquina_lavar,
  acessa_a_internet = 1 AS internet, possui_automovel_ou_motocicleta_de_uso_pessoal = 1 AS auto_moto,
  NULL AS municipio, {case_sql('sexo', codes.SEXO)} AS sexo, idade_na_data_de_referencia AS idade,
  {case_sql('cor_ou_raca', codes.COR_RACA)} AS cor_raca,
  {case_sql('combustivel_mais_utilizado_na_preparacao_dos_alimentos', codes.COMBUSTIVEL)}
    AS combustivel_cozinha
FROM (SELECT {select_sql(PNADC_FIELDS)} FROM events) e"""


def _typed(columns) -> str:
    out = []
    for name, t, _ in MORADOR_COLUMNS:
        sql_t = _SQL_TYPES[t.simpleString()]
        out.append(f"CAST({name if name in columns else 'NULL'} AS {sql_t}) AS {name}")
    return ", ".join(out)


MORADOR_SQL = (f"(SELECT {_typed(H.LOADED_COLUMNS)} FROM ({_CENSUS_SQL} UNION ALL {_PNADC_SQL}) u)")
_LOADED_SQL = ", ".join(H.LOADED_COLUMNS)

register("harmonized_union", f"SELECT {_LOADED_SQL} FROM {MORADOR_SQL} m")(
    lambda spark, d: morador(spark, d))

register("conform_schema", f"SELECT * FROM {MORADOR_SQL} m")(
    lambda spark, d: morador(spark, d, full_schema=True))

register("count_by_source", f"SELECT fonte, COUNT(*) AS n FROM {MORADOR_SQL} m GROUP BY fonte")(
    lambda spark, d: weighted.count_by(morador(spark, d), "fonte"))

register("filter_source",
         f"SELECT uf, COUNT(*) AS n FROM {MORADOR_SQL} m WHERE fonte = 'pnadc_2025' GROUP BY uf")(
    lambda spark, d: weighted.count_by(filters.filter_source(morador(spark, d), "pnadc_2025"), "uf"))

_STATES = ("NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_11")
_SOURCES = ("census_2010", "pnadc_2025")
register("filter_states",
         f"SELECT fonte, uf, COUNT(*) AS n FROM {MORADOR_SQL} m WHERE uf IN "
         f"({', '.join(repr(s) for s in _STATES)}) AND fonte IN ({', '.join(repr(s) for s in _SOURCES)}) "
         "GROUP BY fonte, uf")(
    lambda spark, d: weighted.count_by(
        filters.filter_in(filters.filter_states(morador(spark, d), _STATES), "fonte", _SOURCES),
        "fonte", "uf"))

# ---------------------------------------------------------------- household portrait (one source)
_PORTRAIT_COLS = ("peso",) + PORTRAIT_ATTRIBUTES
_PORTRAIT_HOMES = ("(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id_domicilio ORDER BY "
                   + ", ".join(f"{c} ASC NULLS LAST" for c in _PORTRAIT_COLS)
                   + f") AS rn FROM {MORADOR_SQL} m WHERE fonte = 'pnadc_2025') x WHERE rn = 1)")
register("household_portrait",
         f"WITH h AS {_PORTRAIT_HOMES}, longo AS ("
         + " UNION ALL ".join(f"SELECT '{a}' AS atributo, CAST({a} AS VARCHAR) AS valor, peso AS w FROM h"
                              for a in PORTRAIT_ATTRIBUTES)
         + "), g AS (SELECT atributo, valor, SUM(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 13))) AS s FROM longo WHERE valor IS NOT NULL GROUP BY 1, 2) "
         "SELECT atributo, valor, CAST(CAST(s AS DOUBLE) AS BIGINT) AS total, "
         "ROUND(100.0 * CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY atributo) AS DOUBLE), 1) AS pct FROM g")(
    lambda spark, d: household_portrait(morador(spark, d), "pnadc_2025"))

# ---------------------------------------------------------------- J1 on its own
@register("person_household_join",
         f"SELECT d.situacao_do_domicilio AS situacao_do_domicilio, COUNT(*) AS n_pessoas, "
         "CAST(CAST(SUM(CAST(CAST(p.peso_amostral AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS peso_total "
         f"FROM (SELECT {select_sql(PERSON_FIELDS)} FROM lineitem) p "
         f"JOIN (SELECT {select_sql({**HOUSEHOLD_KEYS, **HOUSEHOLD_FIELDS})} FROM orders) d "
         "ON p.area_de_ponderacao = d.area_de_ponderacao AND p.controle = d.controle "
         "GROUP BY d.situacao_do_domicilio")
def _person_household_join(spark, d):
    keys = ["area_de_ponderacao", "controle"]
    # Only counts and weight sums leave the join, so persons are first reduced to
    # one row per household key (a partial aggregate, before any shuffle); the
    # join then carries households, not persons. Fan-out on a duplicated
    # household key multiplies the per-key count and sum exactly as it would
    # the person rows.
    people = persons(spark, d)
    per_home = people.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), exact_sum("peso_amostral", people).alias("_w"))
    joined = per_home.hint("merge").join(households(spark, d).select(*keys, "situacao_do_domicilio"), keys)
    return joined.groupBy("situacao_do_domicilio").agg(
        F.sum("_n").alias("n_pessoas"), bigint_half_even(F.sum("_w")).alias("peso_total"))

# ---------------------------------------------------------------- J2, P19, F4
# the state numbers customers carry: nation key + 11 spans 11..35, of which 20 are states
_UF_NUMBER = "c_nationkey + 11"


@register("uf_code_lookup",
          f"SELECT uf, COUNT(*) AS n_linhas FROM customer JOIN (VALUES "
          + ", ".join(f"({k}, '{v}')" for k, v in sorted(codes.UF_CODES.items()))
          + f") AS ufs(uf_codigo, uf) ON {_UF_NUMBER} = uf_codigo GROUP BY uf")
def _uf_code_lookup(spark, d):
    customers = table(spark, d, "customer").select(F.expr(_UF_NUMBER).alias("uf_num"))
    kept = H.lookup_state(customers, "uf_num", H.uf_dimension(spark))     # unknown numbers drop out
    return weighted.count_by(kept, "uf", alias="n_linhas")


@register("code_lookup_join",
         "SELECT n_name AS uf, COUNT(*) AS n_linhas FROM customer JOIN "
         "(SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey "
         f"WHERE r_name NOT IN ({', '.join(repr(r) for r in LOOKUP_REGIONS_EXCLUDED)})) dim "
         "ON c_nationkey = n_nationkey GROUP BY n_name")
def _code_lookup_join(spark, d):
    # the lookup table covers the states of four regions: the rest drop out
    dim = (table(spark, d, "nation")
           .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .where(~F.col("r_name").isin(list(LOOKUP_REGIONS_EXCLUDED))).select("n_nationkey", "n_name"))
    kept = H.lookup_state(table(spark, d, "customer"), "c_nationkey", dim, "n_nationkey")
    return weighted.count_by(kept.select(F.col("n_name").alias("uf")), "uf", alias="n_linhas")
