"""A household key holding a third of all person rows: split, not funnelled."""

from pyspark.sql import functions as F

from tabulare.operators import household, weighted


def test_hot_household_key(spark):
    n = 30_000
    persons = spark.range(n).select(
        F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("controle"),
        F.lit(1).alias("area_de_ponderacao"),
        (F.col("id") % 50 + 1).cast("double").alias("peso"),
        (F.col("id") % 7).alias("idade"))
    homes = spark.range(998).select(F.col("id").alias("controle"), F.lit(1).alias("area_de_ponderacao"),
                                    (F.col("id") % 3).alias("agua"))
    keys = ["area_de_ponderacao", "controle"]
    conf = {"spark.sql.adaptive.enabled": "true",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = persons.hint("merge").join(homes, keys)
        rows = joined.collect()                               # runs the adaptive plan to its final form
        total = (len(rows), sum(r.peso for r in rows))
        assert total[0] == n                                  # every person kept
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan                            # the hot key was split across tasks
        first = household.first_row(persons, "controle", ["peso", "idade"])
        assert first.count() == 998 and first.where("controle = 0").first().peso == 1.0
        dist = {r.valor: r.total for r in weighted.weighted_distribution(joined, "agua", "peso").collect()}
        assert sum(dist.values()) == int(total[1])
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
