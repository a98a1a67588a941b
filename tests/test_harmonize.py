"""Harmonized load into ``morador`` — golden values of the reference's load test."""

import pytest

from tabulare.operators import harmonize as H
from tabulare.schemas import MORADOR
from tabulare.sinks import store


@pytest.fixture()
def sources(spark):
    dom = spark.createDataFrame([dict(
        uf="SP", situacao_do_domicilio=1, area_de_ponderacao=1, controle=100, comodos_numero=5,
        comodos_como_dormitorio_numero=2,
        quantas_pessoas_moravam_neste_domicilio_em_31_de_julho_de_2010=2,
        banheiros_de_uso_exclusivo_numero=1, valor_do_aluguel_em_reais=0.0,
        rendimento_mensal_domiciliar_em_julho_de_2010=3000.0,
        rendimento_domiciliar_per_capita_em_julho_de_2010=1500.0, codigo_do_municipio=355030,
        abastecimento_de_agua_forma=1, esgotamento_sanitario_tipo=1, energia_eletrica_existencia=1,
        geladeira_existencia=1, maquina_de_lavar_roupa_existencia=2,
        microcomputador_com_acesso_a_internet_existencia=1,
        automovel_para_uso_particular_existencia=1, motocicleta_para_uso_particular_existencia=2)])
    pes = spark.createDataFrame([
        dict(uf="SP", peso_amostral=10.0, area_de_ponderacao=1, controle=100, sexo=1,
             variavel_auxiliar_da_idade_calculada_em_anos=30, cor_ou_raca=4),
        dict(uf="SP", peso_amostral=10.0, area_de_ponderacao=1, controle=100, sexo=2,
             variavel_auxiliar_da_idade_calculada_em_anos=28, cor_ou_raca=1)])
    pn = spark.createDataFrame([dict(
        uf="SP", peso_com_calibracao=12.0, tipo_de_situacao_da_regiao=1, upa=350000001,
        numero_de_selecao_do_domicilio=1, painel=5, numero_de_comodos=6, numero_de_dormitorios=2,
        numero_de_pessoas_no_domicilio=3, numero_de_banheiros_exclusivos_dos_moradores=2,
        valor_do_aluguel_mensal=0.0, rendimento_habitual_domiciliar_mensal=6000.0,
        rendimento_habitual_domiciliar_per_capita_mensal=2000.0, sexo=2, idade_na_data_de_referencia=40,
        cor_ou_raca=2, principal_forma_de_abastecimento_de_agua=2, destino_do_esgoto_do_banheiro=3,
        origem_da_energia_eletrica=1, domicilio_possui_geladeira=2,
        domicilio_possui_maquina_de_lavar_roupa=2, acessa_a_internet=1,
        possui_automovel_ou_motocicleta_de_uso_pessoal=2,
        combustivel_mais_utilizado_na_preparacao_dos_alimentos=1)])
    return H.census_to_morador(pes, dom), H.pnadc_to_morador(pn, 2025)


def test_counts_per_source(sources):
    m = H.harmonize(*sources)
    assert {r.fonte: r["count"] for r in m.groupBy("fonte").count().collect()} == {
        "census_2010": 2, "pnadc_2025": 1}


def test_pnadc_values(sources):
    r = H.harmonize(*sources).where("fonte = 'pnadc_2025'").first()
    assert (r.situacao, r.sexo, r.cor_raca, r.id_domicilio) == ("urbana", "feminino", "preta", "350000001_1_5")
    assert r.municipio is None
    assert (r.agua, r.esgoto, r.energia) == ("poco_artesiano", "fossa_septica_nao_ligada", "sim")
    assert (r.geladeira, r.maquina_lavar, r.internet, r.auto_moto) == (True, False, True, False)
    assert r.combustivel_cozinha == "gas_botijao"


def test_census_infra_columns(sources):
    rows = (H.harmonize(*sources).where("fonte = 'census_2010'")
            .select("agua", "esgoto", "energia", "geladeira", "maquina_lavar", "internet", "auto_moto")
            .distinct().collect())
    assert [tuple(r) for r in rows] == [("rede_geral", "rede_geral", "sim", True, False, True, True)]
    ids = {r.id_domicilio for r in H.harmonize(*sources).where("fonte = 'census_2010'").collect()}
    assert ids == {"SP_1_100"}


def test_full_schema_and_not_null(spark, sources):
    full = H.harmonize(*sources, full_schema=True)
    assert [f.name for f in full.schema.fields] == MORADOR.fieldNames()
    assert full.where("lixo IS NOT NULL OR celular IS NOT NULL").count() == 0
    flagged = H.harmonize(sources[1].withColumn("peso", sources[1].peso * None), not_null="flag",
                          full_schema=True)
    assert flagged.first()["_rejeitada"] is True
    with pytest.raises(Exception):
        H.harmonize(sources[1].withColumn("peso", sources[1].peso * None)).collect()


def test_reload_twice_is_idempotent(spark, sources, tmpdir_path):
    root = tmpdir_path + "/morador"
    m = H.harmonize(*sources)
    for _ in range(2):
        for fonte in ("census_2010", "pnadc_2025"):
            store.replace_source(m.where(m.fonte == fonte), root, fonte)
    assert spark.read.parquet(root).count() == 3
    store.replace_source(m.where("false"), root, "pnadc_2025")   # an empty new load clears the source
    assert {r.fonte for r in spark.read.parquet(root).select("fonte").distinct().collect()} == {"census_2010"}


def test_bucketed_census_files_join_without_shuffle(spark, tmpdir_path):
    from tabulare.plans.standins import households, persons

    sf = "/root/testdata/sf0.001"
    keys = ["area_de_ponderacao", "controle"]
    store.save_bucketed(persons(spark, sf), "pes_b", keys, 4, tmpdir_path + "/pes")
    store.save_bucketed(households(spark, sf, with_state=True), "dom_b", keys, 4, tmpdir_path + "/dom")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = H.census_to_morador(spark.table("pes_b"), spark.table("dom_b"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        direct = H.census_to_morador(persons(spark, sf), households(spark, sf, with_state=True))
        assert joined.count() == direct.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
