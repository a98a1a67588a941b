"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulare.session import delete_path, scratch_path

# White space and words of every contract here: ASCII white space separates.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Executions in this block delete their shuffle files when they end, not when the driver's JVM
    happens to collect garbage. (A Spark before 4.1 does not know the setting and ignores it.)"""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage (a lost executor costs no recomputation beyond the
    running stage) and gives the planner real file sizes for join choices.
    The write's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete_path(t.sparkSession, folder)


def word_count(text: Column) -> Column:
    """Number of ASCII-white-space separated words; NULL text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def md5_key(value: Column, seed: str = "") -> Column:
    """60 hash-random bits of ``value`` (NULL hashes like the word ``null``) as a non-negative long."""
    text = F.concat(F.lit(seed), F.coalesce(value.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
