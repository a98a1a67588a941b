"""Storage queries.

Each writes below the shared scratch folder and returns what it reads back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulare.functions.numeric import bigint_half_even, exact_sum
from tabulare.plans.q_harmonize import MORADOR_SQL, morador
from tabulare.plans.registry import exact_sql, register, whole_sql
from tabulare.plans.standins import ORDERS_WITH_STATE_SQL, households, orders_with_state, persons, pnadc_persons, table
from tabulare.session import scratch_path
from tabulare.sinks import store
from tabulare.sources.surveys import load_morador
from tabulare.sources.catalog import missing_partitions, partition_catalog, rows_per_state, stored_partitions

_ORDERS_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_ORDERS_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
               "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")


def _orders_out(df):
    return df.select(*_ORDERS_COLS, F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


# ---------------------------------------------------------------- S6, S7, U2
register("parquet_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                       "o_orderpriority"))


def _glob_scan(spark, d):
    root = scratch_path(spark, "lineitem-by-year")
    store.write_partitioned(table(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate")),
                            root, by=("ship_year",))
    # every year directory through one glob; basePath keeps the partition column
    back = spark.read.option("basePath", root).parquet(f"{root}/ship_year=*")
    return back.select("l_orderkey", "l_linenumber", "l_quantity",
                       F.col("ship_year").cast("bigint").alias("ship_year"))


register("parquet_glob_scan",
         "SELECT l_orderkey, l_linenumber, l_quantity, CAST(year(l_shipdate) AS BIGINT) AS ship_year FROM lineitem")(
    _glob_scan)

# ---------------------------------------------------------------- K1
def _roundtrip(spark, d):
    path = scratch_path(spark, "orders-roundtrip")
    store.write_parquet(table(spark, d, "orders"), path)
    return _orders_out(spark.read.parquet(path))


register("parquet_roundtrip", _ORDERS_SQL)(_roundtrip)

# ---------------------------------------------------------------- K2, A21
def _partitioned(spark, d):
    root = scratch_path(spark, "orders-by-uf")
    store.write_partitioned(orders_with_state(spark, d).select(F.col("n_name").alias("uf"), *_ORDERS_COLS),
                            root, by=("uf",))
    return spark.read.parquet(root).groupBy("uf").agg(F.count(F.lit(1)).alias("n_linhas"))


register("partitioned_write",
         f"SELECT n_name AS uf, COUNT(*) AS n_linhas FROM {ORDERS_WITH_STATE_SQL} GROUP BY n_name")(_partitioned)

# ---------------------------------------------------------------- K4
def _if_absent(spark, d):
    path = scratch_path(spark, "orders-once")
    orders = table(spark, d, "orders")
    store.write_if_absent(orders, path)
    store.write_if_absent(orders.where(F.col("o_orderstatus") == "F"), path)   # skipped: output exists
    return _orders_out(spark.read.parquet(path))


register("write_if_absent", _ORDERS_SQL)(_if_absent)

# ---------------------------------------------------------------- K5, K8
def _table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def _save_table(spark, d):
    name = _table_name("pedidos")
    store.save_table(table(spark, d, "orders"), name, scratch_path(spark, name))
    assert store.table_exists(spark, name)
    return _orders_out(spark.table(name))


register("save_table", _ORDERS_SQL)(_save_table)

# ---------------------------------------------------------------- K6
def _save_if_changed(spark, d):
    name = _table_name("pedidos_sync")
    path = scratch_path(spark, name)
    orders = table(spark, d, "orders")
    # an interrupted earlier load left part of the rows
    store.save_table(orders.where(F.col("o_orderstatus") == "F"), name, path)
    first = store.save_if_changed(spark, orders, name, path)
    second = store.save_if_changed(spark, orders, name, path)
    return _orders_out(spark.table(name)).withColumns(
        {"acao_1": F.lit(first), "acao_2": F.lit(second)})


register("save_if_changed",
         _ORDERS_SQL.replace(" FROM orders", ", 'recarregada' AS acao_1, 'inalterada' AS acao_2 FROM orders"))(
    _save_if_changed)

def _save_if_other_content(spark, d):
    name = _table_name("pedidos_conteudo")
    path = scratch_path(spark, name)
    orders = table(spark, d, "orders")
    # as many rows, one of them with another price
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).scalar(), F.lit(0.5))
                                .otherwise(F.col("o_totalprice")))
    store.save_if_changed(spark, changed, name, path, content=True)
    by_count = store.save_if_changed(spark, orders, name, path)
    first, second = (store.save_if_changed(spark, orders, name, path, content=True) for _ in range(2))
    return _orders_out(spark.table(name)).withColumns({"por_contagem": F.lit(by_count), "acao_1": F.lit(first), "acao_2": F.lit(second)})


register("save_if_other_content",
         _ORDERS_SQL.replace(" FROM orders", ", 'inalterada' AS por_contagem, 'recarregada' AS acao_1, 'inalterada' AS acao_2 FROM orders"))(
    _save_if_other_content)

# ---------------------------------------------------------------- L5 from one file per state
def _preview_first_files(spark, d):
    root = scratch_path(spark, "preview")
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").write.partitionBy("c_nationkey").parquet(root)
    return store.preview(spark, root, "c_nationkey", 3)


register("preview_first_files",
         "SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM (SELECT *, ROW_NUMBER() OVER "
         "(PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) t WHERE rn <= 3")(_preview_first_files)

# ---------------------------------------------------------------- K10
def _replace_by_source(spark, d):
    root = scratch_path(spark, "morador")
    # used three times below: computed once, cut from its lineage by a reliable
    # checkpoint in the shared folder (spark.checkpoint.dir)
    m = morador(spark, d).checkpoint()
    store.write_partitioned(m, root, by=("fonte",))
    # new loads: census now only urban rows, PNADC now empty
    store.replace_source(m.where((F.col("fonte") == "census_2010") & (F.col("situacao") == "urbana")),
                         root, "census_2010")
    store.replace_source(m.where(F.lit(False)), root, "pnadc_2025")
    return spark.read.parquet(root).groupBy("fonte").agg(
        F.count(F.lit(1)).alias("n"), bigint_half_even(exact_sum("peso")).alias("peso_total"))


register("replace_by_source",
         f"SELECT fonte, COUNT(*) AS n, CAST(CAST(SUM(CAST(CAST(peso AS VARCHAR) AS DECIMAL(38, 13))) AS DOUBLE) AS BIGINT) AS peso_total FROM {MORADOR_SQL} m "
         "WHERE fonte = 'census_2010' AND situacao = 'urbana' GROUP BY fonte")(_replace_by_source)

# ---------------------------------------------------------------- the morador load as one call
def _morador_load(spark, d):
    root = scratch_path(spark, "morador-load")
    load = lambda **kw: load_morador(root, **kw)
    load(persons=persons(spark, d), households=households(spark, d, with_state=True))
    load(pnadc=pnadc_persons(spark, d).where(F.col("uf") == "NATION_1"))       # an incomplete earlier load
    return load(pnadc=pnadc_persons(spark, d))                                 # replaced; the census stays


register("morador_load", f"SELECT fonte, COUNT(*) AS n_linhas FROM {MORADOR_SQL} m GROUP BY fonte")(_morador_load)


# ---------------------------------------------------------------- K4, A21: ingest state by state
_FIRST_STATES, _MORE_STATES = ("NATION_1", "NATION_2"), ("NATION_1", "NATION_3", "NATION_5")


def _ingest_by_state(spark, d):
    root = scratch_path(spark, "by-state")
    rows = orders_with_state(spark, d).select(F.col("n_name").alias("uf"), "o_orderkey", "o_totalprice")
    store.write_states(rows, root, _FIRST_STATES)
    # a second call for other states: NATION_1 is stored already and stays as it is, NATION_2 is out of scope
    changed = rows.withColumn("o_totalprice", F.lit(0.0))
    store.write_states(changed.where("uf = 'NATION_1'").unionByName(rows.where("uf <> 'NATION_1'")), root, _MORE_STATES)
    return spark.read.parquet(root).groupBy("uf").agg(F.count(F.lit(1)).alias("n_linhas"),
                                                      bigint_half_even(exact_sum("o_totalprice")).alias("total"))


register("ingest_by_state",
         f"SELECT n_name AS uf, COUNT(*) AS n_linhas, {whole_sql(exact_sql('o_totalprice'))} AS total FROM {ORDERS_WITH_STATE_SQL} "
         f"WHERE n_name IN ({', '.join(repr(s) for s in sorted({*_FIRST_STATES, *_MORE_STATES}))}) GROUP BY n_name")(_ingest_by_state)

# ---------------------------------------------------------------- S12, J5, U4
_PERSON_REGIONS = ("AMERICA", "EUROPE")


def _store_by_state(spark, d, person_regions=None, household_regions=None) -> str:
    root = scratch_path(spark, "store-by-uf")
    hh = orders_with_state(spark, d)
    if household_regions is not None:
        r = table(spark, d, "region").where(F.col("r_name").isin(list(household_regions)))
        hh = hh.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    hh = hh.select(F.col("n_name").alias("uf"), F.lit("domicilios").alias("file_type"),
                   "o_orderkey", "o_totalprice")
    li = table(spark, d, "lineitem")
    pp = orders_with_state(spark, d)
    if person_regions is not None:
        r = table(spark, d, "region").where(F.col("r_name").isin(list(person_regions)))
        pp = pp.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    pp = li.hint("merge").join(pp, li.l_orderkey == pp.o_orderkey).select(
        F.col("n_name").alias("uf"), F.lit("pessoas").alias("file_type"), "o_orderkey",
        F.col("l_quantity").alias("o_totalprice"))
    store.write_partitioned(hh.unionByName(pp), root, by=("uf", "file_type"))
    return root


def _catalog(spark, d):
    root = _store_by_state(spark, d)
    return partition_catalog(spark, root)


register("partition_catalog",
         f"SELECT n_name AS uf, 'domicilios' AS file_type, COUNT(*) AS n_linhas FROM {ORDERS_WITH_STATE_SQL} "
         "GROUP BY n_name UNION ALL "
         f"SELECT n_name AS uf, 'pessoas' AS file_type, COUNT(*) AS n_linhas FROM lineitem JOIN "
         f"{ORDERS_WITH_STATE_SQL} ON l_orderkey = o_orderkey GROUP BY n_name")(_catalog)


_HOUSEHOLD_REGIONS = ("AFRICA", "AMERICA", "ASIA")


def _rows_per_state(spark, d):
    # household files only for some regions: the others fall back to their person file
    root = _store_by_state(spark, d, household_regions=_HOUSEHOLD_REGIONS)
    return rows_per_state(partition_catalog(spark, root), ("domicilios", "pessoas"))


register("rows_per_state",
         f"SELECT n_name AS uf, 'domicilios' AS file_type, COUNT(*) AS n_linhas FROM {ORDERS_WITH_STATE_SQL} "
         "JOIN region ON n_regionkey = r_regionkey WHERE r_name IN "
         f"({', '.join(repr(r) for r in _HOUSEHOLD_REGIONS)}) GROUP BY n_name UNION ALL "
         "SELECT n_name AS uf, 'pessoas' AS file_type, COUNT(*) AS n_linhas FROM lineitem JOIN "
         f"{ORDERS_WITH_STATE_SQL} ON l_orderkey = o_orderkey JOIN region ON n_regionkey = r_regionkey "
         f"WHERE r_name NOT IN ({', '.join(repr(r) for r in _HOUSEHOLD_REGIONS)}) GROUP BY n_name")(_rows_per_state)


def _missing(spark, d):
    root = _store_by_state(spark, d, _PERSON_REGIONS)
    present = stored_partitions(spark, root)                  # folder names only
    expected = table(spark, d, "nation").select(
        F.col("n_name").alias("uf"), F.explode(F.array(F.lit("domicilios"), F.lit("pessoas"))).alias("file_type"))
    return missing_partitions(expected, present)


register("missing_partitions",
         "SELECT n_name AS uf, t.file_type FROM nation, (VALUES ('domicilios'), ('pessoas')) AS t(file_type) "
         "EXCEPT SELECT DISTINCT n_name AS uf, 'domicilios' AS file_type "
         f"FROM {ORDERS_WITH_STATE_SQL} "
         "EXCEPT SELECT DISTINCT n_name AS uf, 'pessoas' AS file_type "
         f"FROM lineitem JOIN {ORDERS_WITH_STATE_SQL} ON l_orderkey = o_orderkey "
         "JOIN region ON n_regionkey = r_regionkey WHERE r_name IN "
         f"({', '.join(repr(r) for r in _PERSON_REGIONS)})")(_missing)
