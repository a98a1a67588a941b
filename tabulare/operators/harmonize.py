"""Harmonization of the two surveys into the person-grain ``morador`` table
(P6–P11, J1, J2, U1, K9).

Each source is one lazy projection onto the common columns; the sources are
combined by ``unionByName`` and conformed to the target schema. The census
person ⋈ household join runs once for all states (state is a join key), not
once per state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulare.functions import codes
from tabulare.functions.codes import flag_any, flag_eq, flag_in, label
from tabulare.operators.household import household_key
from tabulare.schemas import MORADOR, conform

# The 26 columns the loads fill, in insert order.
LOADED_COLUMNS = (
    "provedor", "fonte", "ano", "uf", "peso", "situacao", "id_domicilio",
    "n_comodos", "n_dormitorios", "n_moradores", "n_banheiros", "valor_aluguel",
    "rendimento_domiciliar", "rendimento_per_capita",
    "agua", "esgoto", "energia", "geladeira", "maquina_lavar", "internet", "auto_moto",
    "municipio", "sexo", "idade", "cor_raca", "combustivel_cozinha",
)

CENSUS_JOIN_KEYS = ("area_de_ponderacao", "controle")


def census_to_morador(pessoas: DataFrame, domicilios: DataFrame, uf: str | None = None,
                      keys: Sequence[str] = CENSUS_JOIN_KEYS) -> DataFrame:
    """Census 2010: person file ⋈ household file → ``morador`` columns.

    J1: inner equi-join on the household key (plus ``uf`` when both sides carry
    it); orphans drop out and the weight comes from the person side. ``uf`` is
    a literal when reading a single state, else the household's ``uf`` column.
    """
    keys = list(keys)
    if uf is None and "uf" in pessoas.columns and "uf" in domicilios.columns:
        keys = ["uf"] + keys
    # Both sides are full survey files with no size bound, so no broadcast on an
    # estimate: a sort-merge join, which needs no shuffle at all when both
    # files are stored bucketed by the keys (sinks.store.save_bucketed).
    p, d = pessoas.hint("merge").alias("p"), domicilios.alias("d")
    j = p.join(d, [F.col(f"p.{k}") == F.col(f"d.{k}") for k in keys], "inner")
    uf_col = F.lit(uf) if uf is not None else F.col("d.uf")
    dc = lambda n: F.col(f"d.{n}")
    pc = lambda n: F.col(f"p.{n}")
    dn = lambda n: f"d.{n}"  # noqa: E731  (names, for the label expressions)
    pn = lambda n: f"p.{n}"
    return j.select(
        F.lit("IBGE").alias("provedor"),
        F.lit("census_2010").alias("fonte"),
        F.lit(2010).alias("ano"),
        uf_col.alias("uf"),
        pc("peso_amostral").alias("peso"),
        label(dn("situacao_do_domicilio"), codes.SITUACAO).alias("situacao"),
        household_key(uf_col, dc("area_de_ponderacao"), dc("controle")).alias("id_domicilio"),
        dc("comodos_numero").alias("n_comodos"),
        dc("comodos_como_dormitorio_numero").alias("n_dormitorios"),
        dc("quantas_pessoas_moravam_neste_domicilio_em_31_de_julho_de_2010").alias("n_moradores"),
        dc("banheiros_de_uso_exclusivo_numero").alias("n_banheiros"),
        dc("valor_do_aluguel_em_reais").alias("valor_aluguel"),
        dc("rendimento_mensal_domiciliar_em_julho_de_2010").alias("rendimento_domiciliar"),
        dc("rendimento_domiciliar_per_capita_em_julho_de_2010").alias("rendimento_per_capita"),
        label(dn("abastecimento_de_agua_forma"), codes.AGUA_CENSO, codes.OUTRO).alias("agua"),
        label(dn("esgotamento_sanitario_tipo"), codes.ESGOTO_CENSO, codes.OUTRO).alias("esgoto"),
        label(dn("energia_eletrica_existencia"), codes.ENERGIA_CENSO).alias("energia"),
        flag_eq(dc("geladeira_existencia")).alias("geladeira"),
        flag_eq(dc("maquina_de_lavar_roupa_existencia")).alias("maquina_lavar"),
        flag_eq(dc("microcomputador_com_acesso_a_internet_existencia")).alias("internet"),
        flag_any(flag_eq(dc("automovel_para_uso_particular_existencia")),
                 flag_eq(dc("motocicleta_para_uso_particular_existencia"))).alias("auto_moto"),
        dc("codigo_do_municipio").alias("municipio"),
        label(pn("sexo"), codes.SEXO).alias("sexo"),
        pc("variavel_auxiliar_da_idade_calculada_em_anos").alias("idade"),
        label(pn("cor_ou_raca"), codes.COR_RACA).alias("cor_raca"),
        F.lit(None).cast("string").alias("combustivel_cozinha"),
    )


def pnadc_to_morador(moradores: DataFrame, year: int = 2025) -> DataFrame:
    """PNADC visit 1: person rows already carry the household fields."""
    c = F.col
    return moradores.select(
        F.lit("IBGE").alias("provedor"),
        F.lit(f"pnadc_{year}").alias("fonte"),
        F.lit(year).alias("ano"),
        c("uf"),
        c("peso_com_calibracao").alias("peso"),
        label("tipo_de_situacao_da_regiao", codes.SITUACAO).alias("situacao"),
        household_key(c("upa"), c("numero_de_selecao_do_domicilio"), c("painel")).alias("id_domicilio"),
        c("numero_de_comodos").alias("n_comodos"),
        c("numero_de_dormitorios").alias("n_dormitorios"),
        c("numero_de_pessoas_no_domicilio").alias("n_moradores"),
        c("numero_de_banheiros_exclusivos_dos_moradores").alias("n_banheiros"),
        c("valor_do_aluguel_mensal").alias("valor_aluguel"),
        c("rendimento_habitual_domiciliar_mensal").alias("rendimento_domiciliar"),
        c("rendimento_habitual_domiciliar_per_capita_mensal").alias("rendimento_per_capita"),
        label("principal_forma_de_abastecimento_de_agua", codes.AGUA_PNADC, codes.OUTRO).alias("agua"),
        label("destino_do_esgoto_do_banheiro", codes.ESGOTO_PNADC, codes.OUTRO).alias("esgoto"),
        label("origem_da_energia_eletrica", codes.ENERGIA_PNADC).alias("energia"),
        flag_in(c("domicilio_possui_geladeira"), (1, 2)).alias("geladeira"),
        flag_eq(c("domicilio_possui_maquina_de_lavar_roupa")).alias("maquina_lavar"),
        flag_eq(c("acessa_a_internet")).alias("internet"),
        flag_eq(c("possui_automovel_ou_motocicleta_de_uso_pessoal")).alias("auto_moto"),
        F.lit(None).cast("int").alias("municipio"),
        label("sexo", codes.SEXO).alias("sexo"),
        c("idade_na_data_de_referencia").alias("idade"),
        label("cor_ou_raca", codes.COR_RACA).alias("cor_raca"),
        label("combustivel_mais_utilizado_na_preparacao_dos_alimentos",
              codes.COMBUSTIVEL).alias("combustivel_cozinha"),
    )


def harmonize(*sources: DataFrame, full_schema: bool = False, not_null: str = "fail") -> DataFrame:
    """Bag union by column name, conformed to the common columns.

    ``full_schema=True`` conforms to all 35 ``morador`` columns (the 9 that no
    source fills stay NULL).
    """
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    schema = MORADOR if full_schema else T.StructType(
        [f for f in MORADOR.fields if f.name in LOADED_COLUMNS])
    return conform(out, schema, not_null=not_null)


def uf_dimension(spark: SparkSession) -> DataFrame:
    """The 27-row state-number → abbreviation table."""
    return spark.createDataFrame(sorted(codes.UF_CODES.items()), "uf_codigo int, uf string")


def lookup_state(df: DataFrame, code_col: str, dim: DataFrame, dim_key: str = "uf_codigo") -> DataFrame:
    """Inner join to a code table; unknown codes drop out.

    The planner picks the join by the table's size in bytes.
    """
    return df.join(dim, F.col(code_col) == dim[dim_key], "inner").drop(dim[dim_key])
