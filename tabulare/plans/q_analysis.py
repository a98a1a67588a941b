"""Weighted analysis, household grain, bands and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulare.functions import codes
from tabulare.functions.codes import label, label_or_code, flag_in, flag_eq, flag_any
from tabulare.functions.text import first_match
from tabulare.operators import bands, household, quality, weighted
from tabulare.plans.registry import dist_sql, register
from tabulare.session import scratch_path
from tabulare.plans.standins import (
    CUSTOMER_INCOME, CUSTOMER_WEIGHT, LINE_FLAGS, ORDERS_WITH_STATE_SQL, PART_CODE_12,
    PART_CODE_4, PRIORITY_WITH_NULLS, case_sql, orders_per_customer_with_state, orders_with_state, table,
)

# ---------------------------------------------------------------- A1, A2, A3, L1, L4
register("weighted_total", "SELECT CAST(CAST(SUM(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS total FROM orders")(
    lambda spark, d: weighted.weighted_total(table(spark, d, "orders"), "o_totalprice"))


def _priority(spark, d):
    return table(spark, d, "orders").select(F.expr(PRIORITY_WITH_NULLS).alias("prioridade"),
                                            "o_totalprice")


register("weighted_distribution", dist_sql(PRIORITY_WITH_NULLS, "o_totalprice", "orders"))(
    lambda spark, d: weighted.weighted_distribution(_priority(spark, d), "prioridade", "o_totalprice"))

register("weighted_distribution_with_nulls",
         dist_sql(PRIORITY_WITH_NULLS, "o_totalprice", "orders", include_nulls=True))(
    lambda spark, d: weighted.weighted_distribution(_priority(spark, d), "prioridade", "o_totalprice",
                                                    include_nulls=True))

# F8: one value looked up in a finished distribution (shares stay those of the whole)
register("post_aggregate_lookup",
         f"SELECT * FROM ({dist_sql(PRIORITY_WITH_NULLS, 'o_totalprice', 'orders')}) t WHERE valor = '1-URGENT'")(
    lambda spark, d: weighted.weighted_distribution(_priority(spark, d), "prioridade", "o_totalprice", ordered=False)
    .where(F.col("valor") == "1-URGENT"))

register("top_categories",
         "SELECT valor, CAST(CAST(SUM(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS total, "
         "ROUND(100.0 * SUM(w) / SUM(SUM(w)) OVER (), 1) AS pct "
         f"FROM (SELECT n_name AS valor, o_totalprice AS w FROM {ORDERS_WITH_STATE_SQL}) t "
         "GROUP BY valor ORDER BY SUM(w) DESC, valor LIMIT 6")(
    lambda spark, d: weighted.top_categories(orders_per_customer_with_state(spark, d), "n_name",
                                             "valor_pedidos", k=6))

# ---------------------------------------------------------------- A4, L3
_MODE_ATTRS = ("l_returnflag", "l_linestatus", "l_linenumber")
register("weighted_modes",
         "WITH longo AS (" + " UNION ALL ".join(
             f"SELECT '{a}' AS atributo, CAST({a} AS VARCHAR) AS valor, l_quantity AS w FROM lineitem"
             for a in _MODE_ATTRS) + "), "
         "g AS (SELECT atributo, valor, SUM(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 13))) AS s FROM longo WHERE valor IS NOT NULL GROUP BY 1, 2), "
         "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY atributo ORDER BY s DESC, valor) AS rn, "
         "SUM(s) OVER (PARTITION BY atributo) AS t FROM g) "
         "SELECT atributo, valor, CAST(CAST(s AS DOUBLE) AS BIGINT) AS total, ROUND(100.0 * CAST(s AS DOUBLE) / CAST(t AS DOUBLE), 1) AS pct "
         "FROM r WHERE rn = 1")(
    lambda spark, d: weighted.weighted_modes(table(spark, d, "lineitem"), _MODE_ATTRS, "l_quantity"))

# ---------------------------------------------------------------- A2 + L4, several attributes at once
_DIST_ATTRS = ("o_orderpriority", "o_orderstatus", "o_custkey")
register("distributions_by_attribute",
         "WITH longo AS (" + " UNION ALL ".join(
             f"SELECT '{a}' AS atributo, CAST({a} AS VARCHAR) AS valor, o_totalprice AS w FROM orders"
             for a in _DIST_ATTRS) + "), "
         "g AS (SELECT atributo, valor, SUM(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 13))) AS s FROM longo WHERE valor IS NOT NULL GROUP BY 1, 2), "
         "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY atributo ORDER BY s DESC, valor) AS rn, "
         "SUM(s) OVER (PARTITION BY atributo) AS t FROM g) "
         "SELECT atributo, valor, CAST(CAST(s AS DOUBLE) AS BIGINT) AS total, ROUND(100.0 * CAST(s AS DOUBLE) / CAST(t AS DOUBLE), 1) AS pct "
         "FROM r WHERE rn <= 6")(
    lambda spark, d: weighted.weighted_distributions(table(spark, d, "orders"), _DIST_ATTRS,
                                                     "o_totalprice", top=6))

# ---------------------------------------------------------------- A5, F5, A6
_FILTERED_RATIO_SQL = (
    "SELECT ROUND(100.0 * SUM(l_quantity) FILTER (WHERE l_returnflag = 'R') "
    "/ NULLIF(SUM(l_quantity) FILTER (WHERE l_returnflag <> 'N'), 0), 1) AS pct_devolvido, "
    "ROUND(100.0 * SUM(l_quantity) FILTER (WHERE NULLIF(l_discount, 0) >= 0.05) "
    "/ NULLIF(SUM(l_quantity) FILTER (WHERE NULLIF(l_discount, 0) IS NOT NULL), 0), 1) "
    "AS pct_desconto_alto FROM lineitem")


@register("filtered_ratio", _FILTERED_RATIO_SQL)
def _filtered_ratio(spark, d):
    discount = F.nullif("l_discount", F.lit(0.0))          # 0 = not applicable
    return table(spark, d, "lineitem").agg(
        weighted.filtered_ratio("l_quantity", F.col("l_returnflag") == "R",
                                F.col("l_returnflag") != "N").alias("pct_devolvido"),
        weighted.filtered_ratio("l_quantity", discount >= 0.05, discount.isNotNull()).alias("pct_desconto_alto"))


register("flag_shares",
         " UNION ALL ".join(
             f"SELECT '{n}' AS atributo, p AS pct_sim, ROUND(100 - p, 1) AS pct_nao FROM ("
             f"SELECT ROUND(100.0 * SUM(l_quantity) FILTER (WHERE ({e}) IS TRUE) / "
             f"NULLIF(SUM(l_quantity) FILTER (WHERE ({e}) IS NOT NULL), 0), 1) AS p FROM lineitem)"
             for n, e in LINE_FLAGS.items()))(
    lambda spark, d: weighted.flag_shares(table(spark, d, "lineitem"), "l_quantity",
                                          {n: F.expr(e) for n, e in LINE_FLAGS.items()}))

# ---------------------------------------------------------------- A8, L6
register("count_by_state",
         f"SELECT n_name AS uf, 'domicilios' AS file_type, COUNT(*) AS n_linhas "
         f"FROM {ORDERS_WITH_STATE_SQL} GROUP BY n_name")(
    lambda spark, d: orders_per_customer_with_state(spark, d)
    .groupBy(F.col("n_name").alias("uf"), F.lit("domicilios").alias("file_type"))
    .agg(F.sum("n_pedidos").alias("n_linhas")).orderBy("uf"))

# ---------------------------------------------------------------- A9, A10, A13
register("count_distinct_households",
         "SELECT COUNT(DISTINCT l_orderkey) AS n_domicilios, COUNT(*) AS n_pessoas FROM lineitem")(
    lambda spark, d: table(spark, d, "lineitem").agg(
        F.count_distinct("l_orderkey").alias("n_domicilios"), F.count(F.lit(1)).alias("n_pessoas")))

# a state's bitmaps are kept once and merged to the country: an order has lines of several statuses
def _households_mergeable(spark, d):
    kept = scratch_path(spark, "household-bitmaps")
    household.household_bitmaps(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey").write.parquet(kept)
    bitmaps = spark.read.parquet(kept)
    total = household.count_bitmaps(bitmaps).select(F.lit("total").alias("uf"), "n_domicilios")
    return household.count_bitmaps(bitmaps, "l_returnflag").withColumnRenamed("l_returnflag", "uf").unionByName(total)


register("households_mergeable",
         "SELECT l_returnflag AS uf, COUNT(DISTINCT l_orderkey) AS n_domicilios FROM lineitem GROUP BY 1 "
         "UNION ALL SELECT 'total', COUNT(DISTINCT l_orderkey) FROM lineitem")(_households_mergeable)

register("weight_consistency",
         "SELECT COUNT(*) AS n_domicilios, COUNT(*) FILTER (WHERE nd > 1) AS n_peso_divergente "
         "FROM (SELECT user_id, COUNT(DISTINCT value) AS nd FROM events GROUP BY user_id) t")(
    lambda spark, d: household.weight_consistency(table(spark, d, "events"), "user_id", "value"))

register("distinct_rows",
         "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")(
    lambda spark, d: table(spark, d, "lineitem").select("l_returnflag", "l_linestatus",
                                                         "l_linenumber").distinct())

# ---------------------------------------------------------------- A11, A12, W3, J3
_FLAT_SQL = ("(SELECT l_orderkey AS id_domicilio, o_totalprice AS renda, "
             "CAST(o_custkey % 5 + 1 AS DOUBLE) AS peso, o_orderpriority AS prioridade "
             "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")


def _flat_persons(spark, d):
    """Person rows with household fields flattened in (lineitem ⋈ orders).

    Two full files, no size bound on either: sort-merge join, not a broadcast
    chosen on an estimate.
    """
    li, o = table(spark, d, "lineitem").hint("merge"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("id_domicilio"), F.col("o_totalprice").alias("renda"),
        F.expr("CAST(o_custkey % 5 + 1 AS DOUBLE)").alias("peso"),
        F.col("o_orderpriority").alias("prioridade"))


register("household_collapse",
         "SELECT id_domicilio, any_value(renda) AS renda, any_value(peso) AS peso, "
         f"any_value(prioridade) AS prioridade FROM {_FLAT_SQL} f GROUP BY id_domicilio")(
    lambda spark, d: household.collapse(_flat_persons(spark, d), "id_domicilio",
                                        ["renda", "peso", "prioridade"]))

@register("grain_totals",
          "SELECT CAST(CAST(SUM(CAST(CAST(peso AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS domicilios_estimados, "
          f"(SELECT CAST(CAST(SUM(CAST(CAST(peso AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) FROM {_FLAT_SQL} p) AS pessoas_estimadas "
          f"FROM (SELECT id_domicilio, any_value(peso) AS peso FROM {_FLAT_SQL} f GROUP BY 1) h")
def _grain_totals(spark, d):
    return household.grain_totals(_flat_persons(spark, d), "id_domicilio", "peso")

_LINE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_FIRST_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
register("household_first_row",
         "SELECT " + ", ".join(_LINE_COLS) + ", strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM ("
         "SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY "
         + ", ".join(f"{c} ASC NULLS LAST" for c in _FIRST_ORDER) + ") AS rn FROM lineitem) t WHERE rn = 1")(
    lambda spark, d: household.first_row(
        table(spark, d, "lineitem"), "l_orderkey", list(_FIRST_ORDER)).select(
        *_LINE_COLS, F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")))

# ---------------------------------------------------------------- P14, A14, W2, A15, A16, F6
_BAND_SQL = ("CASE WHEN renda IS NULL THEN '0) sem informacao' "
             + " ".join(f"WHEN renda < {b}*1518.0 THEN '{lab}'"
                        for b, lab in zip(bands.BOUNDS, bands.BAND_LABELS[1:]))
             + " ELSE '6) 10+ SM' END")
_CUSTOMER_HH = f"(SELECT {CUSTOMER_INCOME} AS renda, {CUSTOMER_WEIGHT} AS peso FROM customer)"


def _customer_households(spark, d):
    return table(spark, d, "customer").select(F.expr(CUSTOMER_INCOME).alias("renda"),
                                              F.expr(CUSTOMER_WEIGHT).alias("peso"))


_BANDS_ORACLE = ("SELECT faixa, CAST(CAST(SUM(CAST(CAST(peso AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS domicilios, "
                 "ROUND(100.0 * SUM(peso) / SUM(SUM(peso)) OVER (), 1) AS pct "
                 f"FROM (SELECT peso, {_BAND_SQL} AS faixa FROM {_CUSTOMER_HH} c) t GROUP BY faixa")
register("income_bands", _BANDS_ORACLE)(
    lambda spark, d: bands.band_distribution(_customer_households(spark, d), "renda", "peso"))

register("income_bands_cumulative",
         "SELECT *, ROUND(SUM(pct) OVER (ORDER BY faixa ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)"
         f" AS pct_acumulado FROM ({_BANDS_ORACLE}) b")(
    lambda spark, d: bands.cumulative_pct(
        bands.band_distribution(_customer_households(spark, d), "renda", "peso")))

register("affordability",
         "SELECT faixa, CAST(ROUND(SUM(renda * peso) / SUM(peso)) AS BIGINT) AS renda_media_mensal, "
         "ROUND(100 * 3000.0 / NULLIF(SUM(renda * peso) / SUM(peso), 0), 0) AS preco_pct_de_1_mes "
         f"FROM (SELECT peso, renda, {_BAND_SQL} AS faixa FROM {_CUSTOMER_HH} c WHERE renda IS NOT NULL) t "
         "GROUP BY faixa")(
    lambda spark, d: bands.affordability(_customer_households(spark, d), "renda", "peso", price=3000.0))

# ---------------------------------------------------------------- P6, P7, P12, P13, P8
register("code_labels",
         f"SELECT codigo, {case_sql('codigo', codes.COR_RACA)} AS rotulo, COUNT(*) AS n "
         f"FROM (SELECT {PART_CODE_12} AS codigo FROM part) t GROUP BY codigo")(
    lambda spark, d: table(spark, d, "part").select(F.expr(PART_CODE_12).alias("codigo")).select(
        "codigo", label("codigo", codes.COR_RACA).alias("rotulo")).groupBy("codigo", "rotulo").agg(
        F.count(F.lit(1)).alias("n")))

register("code_labels_default",
         f"SELECT codigo, {case_sql('codigo', codes.AGUA_CENSO, codes.OUTRO)} AS rotulo, COUNT(*) AS n "
         f"FROM (SELECT {PART_CODE_12} AS codigo FROM part) t GROUP BY codigo")(
    lambda spark, d: table(spark, d, "part").select(F.expr(PART_CODE_12).alias("codigo")).select(
        "codigo", label("codigo", codes.AGUA_CENSO, codes.OUTRO).alias("rotulo")).groupBy(
        "codigo", "rotulo").agg(F.count(F.lit(1)).alias("n")))

register("label_fallback",
         dist_sql(f"COALESCE({case_sql('codigo', codes.SITUACAO_ROTULO)}, CAST(codigo AS VARCHAR))",
                  "p_retailprice", f"(SELECT {PART_CODE_4} AS codigo, p_retailprice FROM part) p"))(
    lambda spark, d: weighted.weighted_distribution(
        table(spark, d, "part").select(
            label_or_code(f"({PART_CODE_4})", codes.SITUACAO_ROTULO).alias("v"), "p_retailprice"),
        "v", "p_retailprice"))

_INTERNET = {1: "Sim", 2: "Nao (tem PC, sem internet)"}
register("null_as_category",
         dist_sql(f"{case_sql('codigo', _INTERNET, 'Nao (sem computador)')}",
                  "p_retailprice", f"(SELECT {PART_CODE_4} AS codigo, p_retailprice FROM part) p",
                  include_nulls=True))(
    lambda spark, d: weighted.weighted_distribution(
        table(spark, d, "part").select(
            label(f"({PART_CODE_4})", _INTERNET, "Nao (sem computador)").alias("v"), "p_retailprice"),
        "v", "p_retailprice", include_nulls=True))

_A = "NULLIF(l_linenumber, 7)"
_B = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END"
register("boolean_flags",
         f"SELECT {_A} IN (1, 2) AS geladeira, {_A} = 1 AS maquina_lavar, "
         f"({_A} = 1 OR ({_B}) = 1) AS auto_moto, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3")(
    lambda spark, d: table(spark, d, "lineitem").select(
        flag_in(F.expr(_A), (1, 2)).alias("geladeira"), flag_eq(F.expr(_A)).alias("maquina_lavar"),
        flag_any(flag_eq(F.expr(_A)), flag_eq(F.expr(_B))).alias("auto_moto")).groupBy(
        "geladeira", "maquina_lavar", "auto_moto").agg(F.count(F.lit(1)).alias("n")))

# ---------------------------------------------------------------- P9, X3
register("household_key",
         "SELECT o_orderkey, n_name || '_' || CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END "
         f"AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS id_domicilio FROM {ORDERS_WITH_STATE_SQL}")(
    lambda spark, d: orders_with_state(spark, d).select(
        "o_orderkey", household.household_key(
            "n_name", F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END"),
            "o_orderkey").alias("id_domicilio")))

# ---------------------------------------------------------------- L5
register("preview_per_state",
         "SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER "
         "(PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) t WHERE rn <= 3")(
    lambda spark, d: household.first_n(table(spark, d, "customer"), "c_nationkey", ["c_custkey"], 3)
    .select("c_nationkey", "c_custkey", "c_name", "c_acctbal"))

# ---------------------------------------------------------------- A17-A20, X11, X12
_PROFILE_COLS = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                 ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int"))
register("null_profile",
         "WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
         "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), p AS ("
         + " UNION ALL ".join(
             f"SELECT '{c}' AS coluna, '{t}' AS tipo, 100.0 * AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"
             f" AS p, COUNT(*) AS n_linhas FROM j" for c, t in _PROFILE_COLS)
         + ") SELECT coluna, tipo, ROUND(p, 4) AS pct_nulos, ROUND(AVG(p) OVER (), 4) AS pct_nulos_media, "
         f"ROUND(MAX(p) OVER (), 4) AS pct_nulos_max, n_linhas, CAST({len(_PROFILE_COLS)} AS BIGINT) "
         "AS n_colunas FROM p")(
    lambda spark, d: quality.null_profile(
        table(spark, d, "documents").alias("d").join(table(spark, d, "labels").alias("l"),
                                                      F.col("d.doc_id") == F.col("l.doc_id"), "left")
        .select("d.doc_id", "d.text", "d.lang", "d.source", "d.n_chars", "l.quality", "l.toxic")))

register("encoding_check",
         " UNION ALL ".join(
             f"SELECT '{c}' AS coluna, COUNT(*) FILTER (WHERE regexp_matches({c}, '[^\\x00-\\x7F]')) > 0 "
             f"AS tem_nao_ascii, COUNT(*) FILTER (WHERE regexp_matches({c}, '[^\\x00-\\x7F]')) AS n_nao_ascii "
             "FROM documents" for c in ("text", "lang", "source")))(
    lambda spark, d: quality.encoding_check(table(spark, d, "documents"), ["text", "lang", "source"]))

BENCHMARK_HOUSEHOLDS = 4500.0
register("benchmark_deviation",
         "SELECT CAST(CAST(SUM(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS total_estimado, 4500.0::DOUBLE AS referencia, "
         "ROUND(ABS(SUM(w) - 4500.0) / 4500.0 * 100, 1) AS desvio_pct, "
         "ABS(SUM(w) - 4500.0) / 4500.0 * 100 < 5.0 AS dentro_tolerancia "
         f"FROM (SELECT {CUSTOMER_WEIGHT} AS w FROM customer) c")(
    lambda spark, d: quality.benchmark_deviation(
        table(spark, d, "customer").select(F.expr(CUSTOMER_WEIGHT).alias("w")), "w", BENCHMARK_HOUSEHOLDS))

_PAGE_PATTERN = r"<!--[ \t\n\r\f]*ad[ \t\n\r\f]+[0-9]+[ \t\n\r\f]*-->"   # explicit classes: same in Java and RE2
register("regex_find_first",
         f"SELECT page_id, NULLIF(regexp_extract(html, '(?i){_PAGE_PATTERN}', 0), '') AS primeiro FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", first_match("html", _PAGE_PATTERN)
                                                      .alias("primeiro")))
