"""Plan-shape checks: the properties the design relies on at scale."""

from pyspark.sql import functions as F

from tabulare.operators import harmonize as H
from tabulare.operators import household, weighted
from tabulare.plans.standins import households, persons, table
from tabulare.sinks import store
from tabulare.sources.catalog import partition_catalog, stored_partitions
from tabulare.sources.fwf import parse_fwf
from tabulare.sources.layout import packaged_layout

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distribution_pre_aggregates_and_has_no_global_window(spark):
    df = table(spark, SF, "orders")
    d = weighted.weighted_distribution(df, "o_orderpriority", "o_totalprice")
    d.collect()
    plan = _plan(d)
    assert "partial_sum" in plan
    assert "Window" not in plan                      # grand total is a scalar subquery
    assert "ReusedExchange" in plan                  # ... that reuses the aggregate's shuffle


def test_modes_and_consistency_are_partial_aggregates(spark):
    li = table(spark, SF, "lineitem")
    m = _plan(weighted.weighted_modes(li, ["l_returnflag", "l_linestatus"], "l_quantity"))
    assert "partial_min" in m and "Window" not in m
    c = _plan(household.weight_consistency(table(spark, SF, "events"), "user_id", "value"))
    assert "partial_min" in c and "partial_max" in c and "count(distinct" not in c.lower()
    a = _plan(household.collapse(li, "l_orderkey", ["l_returnflag"]))
    assert "partial_any_value" in a or "partial_first" in a


def test_first_row_limits_each_key_before_the_shuffle(spark):
    li = table(spark, SF, "lineitem")
    plan = _plan(household.first_row(li, "l_orderkey", ["l_linenumber"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    plan_n = _plan(household.first_n(table(spark, SF, "customer"), "c_nationkey", ["c_custkey"], 3))
    assert "Partial" in plan_n


def test_person_household_join_is_never_a_broadcast_of_the_person_file(spark):
    j = H.census_to_morador(persons(spark, SF), households(spark, SF, with_state=True))
    plan = _plan(j)
    assert "SortMergeJoin" in plan
    # the only broadcast is the 25-row nation dimension
    assert plan.count("BroadcastExchange") <= 2


def test_scans_read_only_needed_columns_and_push_filters(spark):
    df = table(spark, SF, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = _plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_partition_filters_prune_directories(spark, tmpdir_path):
    root = tmpdir_path + "/s"
    df = spark.createDataFrame([("AC", "d", 1), ("RO", "d", 2)], "uf string, file_type string, v int")
    store.write_partitioned(df, root, by=("uf", "file_type"))
    # names alone come from the folders: nothing is scanned
    assert "FileScan" not in _plan(stored_partitions(spark, root))
    plan = _plan(partition_catalog(spark, root, ufs=["AC"]))
    assert "PartitionFilters: [isnotnull(uf" in plan and "AC" in plan


def test_only_requested_fields_are_parsed(spark):
    L = packaged_layout("lineitem_census")
    lines = spark.createDataFrame([("0" * 57,)], "value string")
    plan = _plan(parse_fwf(lines, L, fields=["L0001", "L0004"]))
    assert plan.count("substring(") == 2


def test_partitioned_write_rebalances_by_partition_columns(spark):
    df = table(spark, SF, "orders").hint("rebalance", "o_orderstatus")
    assert "REBALANCE_PARTITIONS_BY_COL" in _plan(df)


def test_grain_totals_reads_the_persons_once(spark):
    plan = _plan(household.grain_totals(persons(spark, SF), "controle", "peso_amostral"))
    assert plan.count("FileScan") == 1 and "partial_any_value" in plan or "partial_first" in plan


def test_grouped_shares_have_no_window(spark):
    li = table(spark, SF, "lineitem")
    plan = _plan(weighted.weighted_distribution(li, "l_linenumber", "l_quantity", by=["l_returnflag"]))
    assert "Window" not in plan


def test_slugs_are_folded_after_grouping(spark):
    from tabulare.plans import QUERIES

    plan = _plan(QUERIES["slugify"](spark, SF))
    assert "Python" not in plan               # the folding table is applied in the JVM
    assert plan.index("keys=[slug") < plan.index("keys=[t#")            # raw text is grouped below (printed after) the slugs
