"""Weighted estimates, household grain, bands and quality checks."""

import pytest
from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_even, bigint_half_up
from tabulare.operators import bands, household, quality, weighted


@pytest.fixture()
def homes(spark):
    rows = [("a", 1, 10.0), ("b", 1, 30.0), ("c", 2, 20.0), ("d", None, 40.0), ("e", 3, 0.5)]
    return spark.createDataFrame(rows, "id string, agua int, peso double")


def test_distribution_null_policies(homes):
    d = {r.valor: (r.total, r.pct) for r in weighted.weighted_distribution(homes, "agua", "peso").collect()}
    assert d == {1: (40, 66.1), 2: (20, 33.1), 3: (0, 0.8)}
    d2 = {r.valor: r.pct for r in
          weighted.weighted_distribution(homes, "agua", "peso", include_nulls=True).collect()}
    assert d2 == {1: 39.8, None: 39.8, 2: 19.9, 3: 0.5}
    first = weighted.weighted_distribution(homes, "agua", "peso").first()
    assert first.valor == 1                                  # ordered by total, descending


def test_distribution_by_group(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 3.0), ("y", "a", 2.0)], "g string, v string, w double")
    got = {(r.g, r.valor): r.pct for r in weighted.weighted_distribution(df, "v", "w", by=["g"]).collect()}
    assert got == {("x", "a"): 25.0, ("x", "b"): 75.0, ("y", "a"): 100.0}


def test_percents_sum_to_100(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("v"), (F.col("id") % 13 + 0.25).alias("w"))
    total = sum(r.pct for r in weighted.weighted_distribution(df, "v", "w").collect())
    assert abs(total - 100) <= 0.05 * 7


def test_half_even_total(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (2.4999999999,), (11.4951,), (10.5049,)], "x double")
    assert [r[0] for r in df.select(bigint_half_even("x")).collect()] == [2, 4, -2, 2, 11, 11]
    # summed exactly, rounded once: also with the 13 places of survey weights
    for ws, want in (([11.4951], 11), ([10.5049], 11), ([2.5], 2), ([0.1] * 25, 2), ([6.6880960032228, 0.8119039967772], 8)):
        w = spark.createDataFrame([(x,) for x in ws], "w double")
        assert weighted.weighted_total(w, "w").first()[0] == want, ws
    assert [r[0] for r in df.limit(4).select(bigint_half_up("x")).collect()] == [3, 4, -3, 2]
    assert weighted.weighted_total(df.limit(4), "x").first()[0] == 6


def test_modes(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", 5.0), (2, "y", 1.0), (None, "y", 9.0)],
                               "a int, b string, w double")
    got = {r.atributo: (r.valor, r.pct) for r in weighted.weighted_modes(df, ["a", "b"], "w").collect()}
    assert got == {"a": ("2", 85.7), "b": ("y", 62.5)}


def test_ratio_and_shares(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 3.0), (None, 5.0)], "f boolean, w double")
    r = df.agg(weighted.share_true("w", "f").alias("p")).first()
    assert r.p == 25.0
    none = df.where("f IS NULL")
    assert none.agg(weighted.share_true("w", "f")).first()[0] is None   # 0/0 → NULL
    s = {x.atributo: (x.pct_sim, x.pct_nao) for x in weighted.flag_shares(df, "w", ["f"]).collect()}
    assert s == {"f": (25.0, 75.0)}


def test_household_operators(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0, "a", None), (1, 2, 10.0, None, 7), (2, 1, 5.0, "b", 3), (2, 2, 6.0, "b", 3)],
        "h int, p int, w double, x string, y int")
    c = {r.h: (r.x, r.y) for r in household.collapse(df, "h", ["x", "y"]).collect()}
    assert c == {1: ("a", 7), 2: ("b", 3)}
    assert tuple(household.weight_consistency(df, "h", "w").first()) == (2, 1)
    f = {r.h: r.p for r in household.first_row(df, "h", [F.col("p").desc()]).collect()}
    assert f == {1: 2, 2: 2}
    top = household.first_n(df, "h", ["p"], 1).orderBy("h").collect()
    assert [(r.h, r.p) for r in top] == [(1, 1), (2, 1)]
    assert household.count_distinct_households(df, "h").first()[0] == 2
    g = household.grain_totals(df, "h", "w").first()
    assert tuple(g) in ((15, 31), (16, 31))


def test_household_key(spark):
    df = spark.createDataFrame([("SP", "05", 100), ("SP", None, 1)], "uf string, area string, c int")
    got = [r[0] for r in df.select(household.household_key("uf", F.col("area").cast("int"), "c")).collect()]
    assert got == ["SP_5_100", None]                        # no zero padding; NULL propagates


def test_bands(spark):
    unit = bands.UNIT_2025
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (unit, 1.0), (2 * unit - 0.01, 1.0),
                                (4 * unit, 1.0), (9.99 * unit, 1.0), (10 * unit, 2.0)], "renda double, peso double")
    labels = [r[0] for r in df.select(bands.band("renda")).collect()]
    assert labels == ["0) sem informacao", "1) ate 1 SM", "2) 1-2 SM", "2) 1-2 SM", "4) 3-5 SM",
                      "5) 5-10 SM", "6) 10+ SM"]
    dist = bands.cumulative_pct(bands.band_distribution(df, "renda", "peso")).collect()
    assert [r.faixa for r in dist] == sorted(r.faixa for r in dist)
    assert dist[-1].pct_acumulado == pytest.approx(100.0, abs=0.2)
    aff = {r.faixa: (r.renda_media_mensal, r.preco_pct_de_1_mes)
           for r in bands.affordability(df, "renda", "peso", price=3000.0).collect()}
    assert "0) sem informacao" not in aff
    assert aff["6) 10+ SM"] == (15180, 20.0)
    assert aff["1) ate 1 SM"] == (0, None)                  # mean income 0 → no percent


def test_quality(spark):
    df = spark.createDataFrame([(1, "ação", None), (2, "abc", 1.5)], "a long, b string, c double")
    prof = {r.coluna: r for r in quality.null_profile(df).collect()}
    assert prof["c"].pct_nulos == 50.0 and prof["a"].pct_nulos == 0.0
    assert prof["a"].pct_nulos_max == 50.0 and prof["a"].n_linhas == 2 and prof["a"].n_colunas == 3
    assert prof["b"].tipo == "string"
    assert quality.dtype_histogram(df) == {"bigint": 1, "string": 1, "double": 1}
    enc = {r.coluna: r.tem_nao_ascii for r in quality.encoding_check(df).collect()}
    assert enc == {"b": True}
    b = quality.benchmark_deviation(spark.createDataFrame([(100.0,), (95.0,)], "w double"), "w", 199.0).first()
    assert b.total_estimado == 195 and b.dentro_tolerancia is True and b.desvio_pct == 2.0


def test_distributions_for_several_attributes(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0), (None, "y", 4.0)],
                               "p string, q string, w double")
    got = {(r.atributo, r.valor): (r.total, r.pct)
           for r in weighted.weighted_distributions(df, ["p", "q"], "w").collect()}
    assert got == {("p", "a"): (3, 50.0), ("p", "b"): (3, 50.0),
                   ("q", "x"): (1, 10.0), ("q", "y"): (9, 90.0)}
    top1 = {(r.atributo, r.valor) for r in weighted.weighted_distributions(df, ["p", "q"], "w", top=1).collect()}
    assert top1 == {("p", "a"), ("q", "y")}                  # tie on p broken by the smaller value


def test_first_row_orders_nulls_last_and_keeps_whole_rows(spark):
    df = spark.createDataFrame([(1, None, "a", 1.0), (1, 2, "b", 2.0), (1, 3, "a", 3.0), (2, None, "z", 4.0)],
                               "k int, o int, s string, v double")
    got = {r.k: (r.o, r.s, r.v) for r in household.first_row(df, "k", ["o"]).collect()}
    assert got == {1: (2, "b", 2.0), 2: (None, "z", 4.0)}   # a named column sorts NULLs last
    assert household.first_row(df, "k", ["o"]).columns == df.columns


# ---------------------------------------------------------------- exact sums
def test_limb_sums_equal_decimal_sums(spark):
    import random
    from decimal import ROUND_HALF_UP, Context

    from tabulare.functions.numeric import exact_sum

    rng = random.Random(3)
    values = [rng.choice([1, -1]) * round(rng.random() * 10 ** rng.randint(-6, 9), rng.randint(0, 13)) for _ in range(4000)]
    values += [0.1, 0.5, -0.5, 1e-13, 123456789.123456789, 1e15, 9007199254740993.0, -1e-8, 99999999.99999999, None, 3.0, 1e12 + 0.5]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "g int, w double")
    want, c = {}, Context(prec=60, rounding=ROUND_HALF_UP)
    for i, v in enumerate(values):
        if v is not None:
            want[i % 7] = c.add(want.get(i % 7, c.create_decimal(0)), c.quantize(c.create_decimal(repr(v)), c.create_decimal("1e-13")))
    for kind in ("double", "decimal(38,13)"):
        d = df.selectExpr("g", f"CAST(w AS {kind}) AS w")
        assert {r.g: r.s for r in d.groupBy("g").agg(exact_sum("w", d).alias("s")).collect()} == want
    ints = spark.createDataFrame([(2 ** 62,), (-5,), (None,)], "w long")
    assert ints.agg(exact_sum("w", ints).alias("s")).first().s == 2 ** 62 - 5
    none = df.where("w IS NULL")
    assert none.agg(exact_sum("w", none).alias("s")).first().s is None


@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan"), 1e26])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_weight_that_does_not_fit_fails_the_job(spark, bad, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("a", 1.5), ("a", bad)], "v string, w double")
        for q in (weighted.weighted_total(df, "w"), weighted.weighted_modes(df, ["v"], "w"), weighted.weighted_distribution(df, "v", "w")):
            with pytest.raises(Exception, match="does not fit"):
                q.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
