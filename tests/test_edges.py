"""Edge cases: empty and all-NULL inputs, zero totals, overflow."""


from tabulare.functions import text
from tabulare.functions.codes import AGUA_CENSO, OUTRO, label
from tabulare.operators import bands, household, quality, weighted


def test_empty_and_all_null_inputs(spark):
    empty = spark.createDataFrame([], "v string, w double")
    assert weighted.weighted_distribution(empty, "v", "w").count() == 0
    assert weighted.weighted_total(empty, "w").first()[0] is None
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "v string, w double")
    assert weighted.weighted_distribution(nulls, "v", "w").count() == 0          # non-response only
    d = weighted.weighted_distribution(nulls, "v", "w", include_nulls=True).collect()
    assert [(r.valor, r.total, r.pct) for r in d] == [(None, 3, 100.0)]
    assert weighted.weighted_modes(nulls, ["v"], "w").count() == 0


def test_zero_weights_give_null_shares(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "v string, w double")
    assert {r.pct for r in weighted.weighted_distribution(df, "v", "w").collect()} == {None}
    aff = bands.affordability(spark.createDataFrame([(0.0, 1.0)], "renda double, peso double"),
                              "renda", "peso", price=100.0).first()
    assert aff.renda_media_mensal == 0 and aff.preco_pct_de_1_mes is None


def test_labels_default_covers_null_and_unknown_codes(spark):
    df = spark.createDataFrame([(1,), (8,), (None,)], "c int")
    got = [r[0] for r in df.select(label("c", AGUA_CENSO, OUTRO)).collect()]
    assert got == ["rede_geral", OUTRO, OUTRO]



def test_strict_int_overflow_is_null(spark):
    df = spark.createDataFrame([("99999999999",), ("-7",)], "v string")
    assert [r[0] for r in df.select(text.parse_int_strict("v")).collect()] == [None, -7]


def test_household_key_and_consistency_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (2, None)], "h int, w double")
    assert tuple(household.weight_consistency(df, "h", "w").first()) == (2, 0)   # NULLs ignored
    assert quality.null_profile(df).where("coluna = 'w'").first().pct_nulos == 75.0
