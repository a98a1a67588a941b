"""Parquet storage and tables.

Publishing is atomic through Spark's file commit protocol (K3): output is
written under ``_temporary`` and moved into place at job commit, and readers
skip ``_``/``.``-prefixed paths, so a half-written output is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabulare.functions.text import has_non_ascii

_DIGEST = "tabulare.digest"                      # table property
_SWAP = "_swap-"                                 # records of source replacements under way
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"          # fixed value: the folder of rows without a partition value
# Characters that partition folder names carry percent-encoded.
_ESCAPED = set('"#%\'*/:=?\\\x7f{[]^') | {chr(c) for c in range(1, 0x20)}


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: Snappy-compressed Parquet."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("uf",),
                      mode: str = "overwrite") -> None:
    """K2: one directory per partition value (``uf=SP/``…).

    A ``rebalance`` on the partition columns routes each value's rows to few
    tasks (few files per directory), and AQE splits a value that holds an
    outsized share of the rows across several tasks instead of one.
    """
    (df.hint("rebalance", *by).write.mode(mode).option("compression", "snappy")
       .partitionBy(*by).parquet(path))


def write_if_absent(df: DataFrame, path: str) -> None:
    """K4: skip the step when its output already exists."""
    df.write.mode("ignore").option("compression", "snappy").parquet(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """K5: create or replace a table; ``path`` keeps its files on shared storage."""
    w = df.write.mode("overwrite").format("parquet")
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int,
                  path: str | None = None) -> None:
    """Save ``df`` as a table hash-bucketed (and sorted) by ``by``.

    Two tables bucketed by the same join keys into the same number of buckets
    join without shuffling either side: e.g. the census person and household
    files by ``uf, area_de_ponderacao, controle``, which every harmonized load
    joins on. Pick ``buckets`` so one bucket of the larger table is a
    comfortable task (a few hundred MB).
    """
    w = (df.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by))
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    """K8: is this table saved?"""
    return spark.catalog.tableExists(name)


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows as a multiset: their number, and the sum and exclusive or of two row hashes.

    The order of rows and columns does not matter; a NULL counts as one, in its
    column. One pass of partial sums, a row per task leaves it.
    """
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = [*cols, *[c.isNull() for c in cols]]
    one = df.select(F.xxhash64(F.lit(1), *row).alias("a"), F.xxhash64(F.lit(2), *row).alias("b"))
    got = one.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s"), F.bit_xor("b").alias("x")).first()
    return f"{got['n']}:{got['s']}:{got['x']}"


def save_if_changed(spark: SparkSession, source: DataFrame, name: str,
                    path: str | None = None, content: bool = False) -> str:
    """K6: (re)load ``name`` from ``source`` unless it already holds as many rows.

    Returns ``"criada"``, ``"inalterada"`` or ``"recarregada"``. The table's
    count reads only Parquet footers, and so does a ``source`` that is a bare
    Parquet scan; any other source is computed to be counted. A table with a different count (e.g. an
    interrupted earlier load) is overwritten as a whole; if that overwrite is
    itself interrupted, the next call sees the mismatch and repairs it again.

    ``content=True`` also compares the ``content_digest`` of the source with
    the one kept with the table, so that equal counts of other rows are
    reloaded. The digest is kept after the load: an interrupted load has none.
    """
    digest = content_digest(source) if content else None
    if not table_exists(spark, name):
        _load(spark, source, name, path, digest)
        return "criada"
    same = spark.table(name).count() == (int(digest.split(":")[0]) if digest else source.count())
    if digest and same:
        kept = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        same = kept.get(_DIGEST) == digest
    if same:
        return "inalterada"
    _load(spark, source, name, path, digest)
    return "recarregada"


def _load(spark: SparkSession, source: DataFrame, name: str, path: str | None, digest: str | None) -> None:
    save_table(source, name, path)
    if digest:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_DIGEST}' = '{digest}')")


def write_profiled(df: DataFrame, path: str, by: str, values: Sequence) -> DataFrame:
    """K2 with A17/A18/A20/A21 taken from the writing job itself: ``medida, nome, n_linhas, n_nulos, n_nao_ascii``.

    One row per column (``medida`` is ``coluna``: rows, NULLs, texts that are
    not ASCII) and one per value of ``by`` that occurs among ``values``. The
    counts are observed while the rows pass to the writer: the input is scanned once.
    """
    spark, seen = df.sparkSession, Observation()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = [c for c in df.columns if kinds[c] == "string"]
    measures = [F.count(F.lit(1)).alias("n")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"null-{c}") for c in df.columns]
    measures += [F.count_if(has_non_ascii(F.col(c))).alias(f"text-{c}") for c in texts]
    measures += [F.count_if(F.col(by) == F.lit(v)).alias(f"value{i}") for i, v in enumerate(values)]
    write_partitioned(df.observe(seen, *measures), path, by=(by,))
    got = seen.get
    rows = [("coluna", c, got["n"], got[f"null-{c}"], got.get(f"text-{c}", 0)) for c in df.columns]
    rows += [(by, str(v), got[f"value{i}"], None, None) for i, v in enumerate(values) if got[f"value{i}"]]
    return spark.createDataFrame(rows, "medida string, nome string, n_linhas long, n_nulos long, n_nao_ascii long")


def partition_folder(column: str, value: str) -> str:
    """``column=value`` as Spark names the folder of a partition."""
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_source(df: DataFrame, root: str, value: str, column: str = "fonte") -> None:
    """Replace every row of one source, also by an empty load.

    The new rows are written beside the old (in a folder readers skip) and
    swapped in by two renames once they are complete, so a failed load leaves
    the old rows, and ``df`` may itself read from ``root``. What the swap
    intends is recorded before the first rename: a call that dies between the
    two is finished by the next ``replace_source`` or ``recover`` on ``root``.
    One source has one writer at a time.
    """
    spark = df.sparkSession
    recover(spark, root)
    out = df.drop(column) if column in df.columns else df
    own = uuid.uuid4().hex
    out.write.option("compression", "snappy").parquet(f"{root}/_staged-{own}")
    record = f"{root}/{_SWAP}{own}"
    _write_text(spark, record, json.dumps({"target": partition_folder(column, value), "staged": f"_staged-{own}", "old": f"_old-{own}"}))
    _finish_swap(spark, root, record)


def recover(spark: SparkSession, root: str) -> list[str]:
    """Finish the source replacements that were interrupted under ``root``; the folders they replace.

    A recorded replacement is complete but for its renames, so it is always
    finished, never undone. Call it before reading a store whose writer may have died.
    """
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    records = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith(_SWAP))
    return [_finish_swap(spark, root, f"{root}/{r}") for r in records]


def _finish_swap(spark: SparkSession, root: str, record: str) -> str:
    """Bring a recorded swap to its end from any state it may have stopped in."""
    swap = json.loads(_read_text(spark, record))
    target, staged, old = (_fs(spark, f"{root}/{swap[k]}")[0] for k in ("target", "staged", "old"))
    fs = _fs(spark, root)[1]
    if fs.exists(staged):                       # not published yet
        if fs.exists(target):
            if fs.exists(old):
                raise OSError(f"two writers of {target}")
            if not fs.rename(target, old):
                raise OSError(f"cannot move {target}")
        if not fs.rename(staged, target):
            raise OSError(f"cannot publish {target}")
    fs.delete(old, True)
    fs.delete(_fs(spark, record)[0], False)
    return swap["target"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    part, fs = _fs(spark, f"{path.rsplit('/', 1)[0]}/_part-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, _fs(spark, path)[0]):
        raise OSError(f"cannot write {path}")


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stored_values(spark: SparkSession, root: str, column: str = "uf") -> set[str]:
    """Values of the first partition column stored under ``root``, from folder names alone."""
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return set()
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    found = (n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))
    return {_unescape(v) for v in found}


def _unescape(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, encoding="latin-1") if "%" in value else value


def write_states(df: DataFrame, path: str, states: Sequence[str] | None = None, by: str = "uf",
                 overwrite: bool = False) -> list[str]:
    """A21/K4 per state: write the states of ``df`` that are not stored yet; return them.

    Other states' folders are never touched. ``overwrite=True`` rewrites every
    state in scope (``states``, or those that ``df`` has) and clears a state in
    scope that has no rows any more.
    """
    spark = df.sparkSession
    stored = stored_values(spark, path, by)
    if states is not None:
        df = df.where(F.col(by).isin(list(states)))
    if overwrite:
        # one value per state: which states in scope have rows, so that the others can be cleared
        here = {r[0] for r in df.select(by).distinct().collect()}
    else:
        if states is not None and set(states) <= stored:
            return []
        if stored:
            df = df.where(~F.coalesce(F.col(by).cast("string"), F.lit(_NO_VALUE)).isin(sorted(stored)))
    (df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("compression", "snappy").partitionBy(by).parquet(path))
    if not overwrite:
        return sorted(stored_values(spark, path, by) - stored)
    for gone in (set(states or ()) - here) & stored:
        p, fs = _fs(spark, f"{path}/{partition_folder(by, gone)}")
        fs.delete(p, True)
    return sorted(here - {None})


def preview(spark: SparkSession, path: str, by: str, n: int) -> DataFrame:
    """``n`` rows of every stored value of ``by``, each from the first file of its folder.

    Files are chosen from folder listings, so a preview opens one file per
    value, whatever the store holds, and shows the first rows of it; a task
    stops at ``n`` rows (of a file in several splits only the first split has
    any, the others are passed over).
    """
    p, fs = _fs(spark, path)
    schema, parts = spark.read.parquet(path).schema, []
    for folder in sorted(fs.listStatus(p), key=lambda st: st.getPath().getName()):
        if folder.isDirectory() and folder.getPath().getName().startswith(f"{by}="):
            files = sorted(f.getPath().toString() for f in fs.listStatus(folder.getPath())
                           if f.isFile() and f.getPath().getName()[0] not in "_.")
            if files:
                one = spark.read.option("basePath", path).schema(schema).parquet(files[0])
                parts.append(one.where(F.col("_metadata.row_index") < n).limit(n))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
