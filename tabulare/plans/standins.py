"""Survey-shaped inputs derived from the driver's TPC-H-like tables.

Stand-ins (SURVEY §7.3): household file = ``orders`` (+ ``customer``/``nation``
for the state), person file = ``lineitem``, a PNADC-like flat person file =
``events``. Each derived column is a small SQL expression, evaluated by Spark
through ``F.expr`` and pasted verbatim into the DuckDB oracle, so the inputs
of both sides are the same by construction; the survey operators themselves
are implemented separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulare.session import files_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is inferred once per file version and then
    passed to the reader, which skips the footer-reading job on later reads."""
    path = table_path(sf_dir, name)
    key = (path, files_key(spark, path))
    if key not in _SCHEMAS:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def select_sql(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


# -- census household file (orders); state and income need customer ⋈ nation --
HOUSEHOLD_KEYS = {
    "area_de_ponderacao": "o_orderkey % 7",
    "controle": "o_orderkey",
}
HOUSEHOLD_FIELDS = {
    "situacao_do_domicilio": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END",
    "comodos_numero": "CAST(o_custkey % 9 + 1 AS INT)",
    "comodos_como_dormitorio_numero": "CAST(o_custkey % 4 + 1 AS INT)",
    "quantas_pessoas_moravam_neste_domicilio_em_31_de_julho_de_2010": "CAST(o_orderkey % 6 + 1 AS INT)",
    "banheiros_de_uso_exclusivo_numero": "CAST(o_orderkey % 4 AS INT)",
    "valor_do_aluguel_em_reais":
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice / 100 END",
    "abastecimento_de_agua_forma": "CAST(o_orderkey % 12 AS INT)",
    "esgotamento_sanitario_tipo": "CASE WHEN o_orderkey % 10 < 7 THEN CAST(o_orderkey % 10 AS INT) END",
    "energia_eletrica_existencia": "CAST(o_custkey % 4 AS INT)",
    "geladeira_existencia": "CAST(o_orderkey % 3 AS INT)",
    "maquina_de_lavar_roupa_existencia": "CAST(o_orderkey % 2 + 1 AS INT)",
    "microcomputador_com_acesso_a_internet_existencia":
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 2 + 1 AS INT) END",
    "automovel_para_uso_particular_existencia":
        "CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey % 5 AS INT) END",
    "motocicleta_para_uso_particular_existencia": "CAST(o_orderkey % 2 + 1 AS INT)",
}
HOUSEHOLD_STATE_FIELDS = {
    "uf": "n_name",
    "rendimento_mensal_domiciliar_em_julho_de_2010": "CASE WHEN c_acctbal >= 0 THEN c_acctbal END",
    "rendimento_domiciliar_per_capita_em_julho_de_2010":
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal / (o_orderkey % 6 + 1) END",
    "codigo_do_municipio": "CAST(c_nationkey * 1000 + o_custkey % 1000 AS INT)",
}
ORDERS_WITH_STATE_SQL = ("orders JOIN customer ON o_custkey = c_custkey "
                         "JOIN nation ON c_nationkey = n_nationkey")

# -- census person file (lineitem) --
PERSON_FIELDS = {
    "area_de_ponderacao": "l_orderkey % 7",
    "controle": "l_orderkey",
    "peso_amostral": "l_quantity",
    "sexo": "CAST(l_linenumber % 3 AS INT)",
    "variavel_auxiliar_da_idade_calculada_em_anos": "CAST(l_partkey % 90 AS INT)",
    "cor_ou_raca": "CAST(l_suppkey % 10 AS INT)",
}

# -- PNADC-like person file with household fields (events; household = user) --
PNADC_FIELDS = {
    "uf": "concat('NATION_', CAST(user_id % 25 AS STRING))",
    "peso_com_calibracao": "value",
    "tipo_de_situacao_da_regiao": "CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END",
    "upa": "user_id",
    "numero_de_selecao_do_domicilio": "user_id % 13",
    "painel": "user_id % 4",
    "numero_de_comodos": "CAST(user_id % 8 + 1 AS INT)",
    "numero_de_dormitorios": "CAST(user_id % 3 + 1 AS INT)",
    "numero_de_pessoas_no_domicilio": "CAST(user_id % 5 + 1 AS INT)",
    "numero_de_banheiros_exclusivos_dos_moradores": "CAST(user_id % 3 AS INT)",
    "valor_do_aluguel_mensal": "CASE WHEN user_id % 3 = 0 THEN value * 4 END",
    "rendimento_habitual_domiciliar_mensal": "value * 20",
    "rendimento_habitual_domiciliar_per_capita_mensal": "value * 20 / (user_id % 5 + 1)",
    "principal_forma_de_abastecimento_de_agua": "CAST(event_id % 7 AS INT)",
    "destino_do_esgoto_do_banheiro": "CAST(event_id % 8 AS INT)",
    "origem_da_energia_eletrica": "CAST(user_id % 3 AS INT)",
    "domicilio_possui_geladeira": "CAST(user_id % 4 AS INT)",
    "domicilio_possui_maquina_de_lavar_roupa": "CAST(user_id % 2 + 1 AS INT)",
    "acessa_a_internet": "CASE WHEN event_type <> 'error' THEN CAST(user_id % 2 + 1 AS INT) END",
    "possui_automovel_ou_motocicleta_de_uso_pessoal": "CAST(user_id % 3 AS INT)",
    "sexo": "CAST(user_id % 2 + 1 AS INT)",
    "idade_na_data_de_referencia": "CAST(user_id % 80 AS INT)",
    "cor_ou_raca": "CAST(user_id % 6 + 1 AS INT)",
    "combustivel_mais_utilizado_na_preparacao_dos_alimentos": "CAST(event_id % 6 AS INT)",
}

# -- other derived columns --
# priority with non-response: pending orders have no answer
PRIORITY_WITH_NULLS = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END"
# a small code with NULLs (parts of size over 45 were "not asked")
PART_CODE_12 = "CASE WHEN p_size > 45 THEN NULL ELSE p_size % 12 END"
PART_CODE_4 = "CASE WHEN p_size > 45 THEN NULL ELSE p_size % 4 END"
# customer as a household: income (negative balance = no information) and weight
CUSTOMER_INCOME = "CASE WHEN c_acctbal >= 0 THEN c_acctbal END"
CUSTOMER_WEIGHT = "CAST(c_custkey % 5 + 1 AS DOUBLE)"
# lineitem flags with "not applicable" NULLs
LINE_FLAGS = {
    "devolvido": "CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END",
    "finalizado": "l_linestatus = 'F'",
    "com_desconto": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount > 0 END",
    "imposto_alto": "l_tax >= 0.04",
}
# state regions covered by the state lookup table
LOOKUP_REGIONS_EXCLUDED = ("MIDDLE EAST",)


def households(spark: SparkSession, sf_dir: str, with_state: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    exprs = {**HOUSEHOLD_KEYS, **HOUSEHOLD_FIELDS}
    if with_state:
        c = table(spark, sf_dir, "customer")
        n = table(spark, sf_dir, "nation")
        o = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        exprs.update(HOUSEHOLD_STATE_FIELDS)
    return derive(o, exprs)


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "lineitem"), PERSON_FIELDS)


def pnadc_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), PNADC_FIELDS)


def orders_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey))


def orders_per_customer_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order count and total price per customer, with the customer's state.

    For queries that only need per-state sums: orders are aggregated per
    customer (partially, before the shuffle) so the customer join moves one
    row per customer instead of one per order.
    """
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_pedidos"), F.sum("o_totalprice").alias("valor_pedidos"))
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (per_customer.join(c, per_customer.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey))


# -- SQL renderings of the survey code tables for the oracle --
def case_sql(col: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {col} = {k!r} THEN '{v}'" if isinstance(k, str)
                     else f"WHEN {col} = {k} THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {whens}{tail} END"


__all__ = ["table", "table_path", "derive", "select_sql", "case_sql", "households", "persons",
           "pnadc_persons", "orders_with_state"]
