"""Which partitions are stored."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_partitions(spark: SparkSession, root: str, partition_cols: Sequence[str] = ("uf", "file_type")) -> DataFrame:
    """The stored partitions, from folder names alone; no data file is opened.

    Uncommitted output (``_temporary``, ``_staged``) is not listed.
    """
    pattern = "/".join([root.rstrip("/"), *(f"{c}=*" for c in partition_cols)])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    rows = []
    for st in found:
        parts = st.getPath().toString().split("/")[-len(partition_cols):]
        rows.append(tuple(unquote(x.split("=", 1)[1], encoding="latin-1") if "%" in x else x.split("=", 1)[1] for x in parts))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in partition_cols))


def partition_catalog(spark: SparkSession, root: str, partition_cols: Sequence[str] = ("uf", "file_type"),
                      ufs: Sequence[str] | None = None, file_types: Sequence[str] | None = None) -> DataFrame:
    """Stored partitions with their row counts.

    The filters on partition columns prune directories before any file is
    opened, and counting rows reads only Parquet footers; use
    ``stored_partitions`` where the names are enough.
    """
    df = spark.read.parquet(root)
    if ufs:
        df = df.where(F.col("uf").isin(list(ufs)))                 # F3
    if file_types:
        df = df.where(F.col("file_type").isin(list(file_types)))   # F7
    return df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("n_linhas"))


def rows_per_state(catalog: DataFrame, preference: Sequence[str] = ("domicilios", "moradores"),
                   state_col: str = "uf") -> DataFrame:
    """Rows per state from the first stored file type in ``preference``
    (the household file, else the PNADC person file); states with none of
    them are left out. ``catalog`` is ``partition_catalog``'s output.
    """
    rank = None
    for i, t in enumerate(preference):
        cond = F.col("file_type") == F.lit(t)
        rank = F.when(cond, F.lit(i)) if rank is None else rank.when(cond, F.lit(i))
    ranked = catalog.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = ranked.groupBy(state_col).agg(
        F.min_by(F.struct("file_type", "n_linhas"), "_rank").alias("_b"))
    return best.select(state_col, "_b.file_type", "_b.n_linhas").orderBy(state_col)   # L6


def missing_partitions(expected: DataFrame, present: DataFrame,
                       keys: Sequence[str] = ("uf", "file_type")) -> DataFrame:
    """Expected partitions that are not stored (anti join; ``present`` may repeat keys)."""
    return expected.select(*keys).join(present.select(*keys), list(keys), "left_anti")


def split_stem(stem_col) -> tuple:
    """``"SP_moradores"`` → (``"SP"``, ``"moradores"``); names without ``_`` → NULLs."""
    c = F.col(stem_col) if isinstance(stem_col, str) else stem_col
    parts = F.split(c, "_", 2)
    ok = F.size(parts) == 2
    return F.when(ok, parts.getItem(0)), F.when(ok, parts.getItem(1))
