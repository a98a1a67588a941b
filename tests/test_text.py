"""X1, X2, X5–X8, X11, X12 — slug cases follow the reference's heading tests."""

import pytest
from pyspark.sql import functions as F

from tabulare.functions import text


HEADINGS = [
    ("SITUAÇÃO DO DOMICÍLIO: 1- Urbana 2- Rural", "situacao_do_domicilio"),
    ("ÁREA DE PONDERAÇÃO", "area_de_ponderacao"),
    ("CÓDIGO DO MUNICÍPIO", "codigo_do_municipio"),
    ("ESPÉCIE DE UNIDADE 1 - Particular 2 - Coletiva", "especie_de_unidade"),
    ("ABASTECIMENTO DE ÁGUA, FORMA: 01- Rede geral", "abastecimento_de_agua_forma"),
    ("VALOR DO ALUGUEL (EM REAIS)", "valor_do_aluguel_em_reais"),
    ("  espaços   extras  ", "espacos_extras"),
    ("", ""),
    ("   ", ""),
    (None, ""),
]


@pytest.mark.parametrize("heading,expected", HEADINGS)
def test_slug_heading_driver(heading, expected):
    assert text.slug_py(heading, heading=True) == expected


def test_slug_pnadc_keeps_whole_text():
    assert text.slug_py("Número de seleção do domicílio", heading=False) == "numero_de_selecao_do_domicilio"
    assert text.slug_py("Tipo: 1- A", heading=False) == "tipo_1_a"
    assert text.slug_py(None) == ""


def test_slug_columns_match_driver_version(spark):
    rows = [(h,) for h, _ in HEADINGS]
    df = spark.createDataFrame(rows, "h string")
    got = df.select(text.slug_heading("h").alias("a"), text.slug("h").alias("b")).collect()
    assert [r.a for r in got] == [e for _, e in HEADINGS]
    assert [r.b for r in got] == [text.slug_py(h) for h, _ in HEADINGS]


def test_decimal_comma(spark):
    vals = ["85,5", "120 m²", "5d", "", None, "1_000,5", " 42 ", "3.25", "1.234,5", "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(text.parse_decimal_comma("v")).collect()]
    assert got[:8] == [85.5, None, None, None, None, 1000.5, 42.0, 3.25]
    assert got[8] is None
    assert got[9] != got[9]  # NaN, as Python float("nan")


def test_int_strict(spark):
    vals = ["3", "3.0", " 4 ", "abc", "", None, "+7", "1_0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(text.parse_int_strict("v")).collect()] == [3, None, 4, None, None, None, 7, 10]


def test_token_flag(spark):
    vals = ["Sim", "Não", "", None, "sim", "Yes", "true", "1", "0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(text.token_flag("v")).collect()] == [
        True, False, None, None, False, True, True, True, False]


def test_first_match_and_non_ascii(spark):
    df = spark.createDataFrame([("x PNADC_2025_visita1_20250101.zip y pnadc_2025_visita1_2.ZIP",), ("none",)],
                               "t string")
    got = df.select(text.first_match("t", r"PNADC_2025_visita1_\d+\.zip").alias("m"),
                    text.has_non_ascii("t").alias("n")).collect()
    assert got[0].m == "PNADC_2025_visita1_20250101.zip" and got[1].m is None
    assert [r.n for r in got] == [False, False]
    assert spark.range(1).select(text.has_non_ascii(F.lit("ação"))).first()[0] is True


def test_folding_equals_nfkd_for_every_character(spark):
    """Every code point, between letters and beside combining marks."""
    chars = [c for c in map(chr, range(1, 0x110000)) if not "\ud800" <= c <= "\udfff"]
    strings = ["|".join(f"a{c}z" for c in chars[i:i + 64]) for i in range(0, len(chars), 64)]
    strings += ["ȩ́x", "ﬃ½ and ℃", "ﷺ", "한국어", "", "plain", None, "\U0001d504\U0001d505 Ⅷ"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = df.select("s", text.fold("s").alias("f")).collect()
    assert all(r.f == (None if r.s is None else text.fold_ascii_py(r.s)) for r in got)


def test_slug_plans_hold_no_python(spark):
    df = spark.createDataFrame([("Número",)], "h string").select(text.slug_heading("h"), text.slug("h"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
