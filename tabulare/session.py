"""Session construction and the shared scratch location.

Anything this library writes for its own use (stand-in files, lineage cuts)
goes below the folder the cluster names in ``spark.checkpoint.dir``; we only
choose one ourselves when the session has none (local runs and tests).
"""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tabulare", driver_memory: str | None = None) -> SparkSession:
    """A session with the settings this library assumes (AQE on, UTC, no UI).

    ``master``/``shuffle_partitions``/``driver_memory`` are only for local
    runs (in local mode the driver heap is the executors' heap, and only takes
    effect if the JVM is not running yet); on a cluster the launcher's settings
    win because ``getOrCreate`` reuses the active session.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "snappy")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``tabulare`` importable in the executors' Python workers.

    Functions that run Python inside tasks (the Arrow UDF, ``mapInPandas``)
    are pickled by reference to this package, so workers must import it. The
    package is zipped once per application on the driver and handed to
    ``SparkContext.addPyFile``, which distributes it to every executor (what
    ``--py-files`` does); executors never read the driver's disk themselves.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tabulare-pkg-"), "tabulare.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, files in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if not f.endswith(".pyc"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Root of the cluster-shared scratch folder (``spark.checkpoint.dir``).

    Set only when unset, and then to a fresh local folder (local mode only).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            # executors on other machines could not see a folder on this one
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tabulare-ckpt-")
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused folder name under this application's scratch root.

    The root is deleted when the driver's Python process ends (or earlier, by
    ``clear_scratch``): results are lazy, so no earlier point is known to be safe.
    """
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/tabulare/scratch-{sc.applicationId}"
    if root not in _SCRATCH_ROOTS:
        _SCRATCH_ROOTS.add(root)
        atexit.register(_drop_at_exit, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


_SCRATCH_ROOTS: set = set()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to scratch; results read from it end here."""
    root = f"{shared_dir(spark)}/tabulare/scratch-{spark.sparkContext.applicationId}"
    p, fs = _fs(spark, root)
    fs.delete(p, True)


def _drop_at_exit(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        p, fs = _fs(spark, root)
        fs.delete(p, True)
        return
    # the session was stopped before: its file systems are gone, and no later application could tell whose folder it is
    from pyarrow import fs as files

    local = local_fs_path(root)
    try:
        system, path = (files.LocalFileSystem(), local) if local is not None else files.FileSystem.from_uri(root)
    except (OSError, ValueError):            # a store that only Spark reads: left to whoever owns spark.checkpoint.dir
        return
    if system.get_file_info(path).type == files.FileType.Directory:
        system.delete_dir(path)


def local_fs_path(path: str) -> str | None:
    """Local filesystem path for a ``file:`` or bare path, else ``None``."""
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        return None
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def files_key(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of every file at ``path`` (a file or a folder): changes when the data does."""
    p, fs = _fs(spark, path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        st = it.next()
        found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return tuple(sorted(found))


def derived_input(spark: SparkSession, label: str, sources: list[str], build, version: str = "1") -> str:
    """Folder holding an input derived from ``sources``, built at most once.

    The folder name is keyed by the sources' files, so a changed table gets a
    new folder. ``build(path)`` writes a folder of its own, which is then
    renamed: two sessions building at once do not mix, and an interrupted
    build (no ``_SUCCESS``) is never read.
    """
    stamp = [(s, files_key(spark, s)) for s in sources]
    key = hashlib.sha1(repr((label, version, stamp)).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/tabulare/derived/{label}-{key}"
    if path_exists(spark, f"{path}/_SUCCESS"):
        return path
    own = f"{path}.{uuid.uuid4().hex[:12]}"
    build(own)
    p, fs = _fs(spark, path)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        fs.delete(p, True)                   # what an interrupted build left
        fs.mkdirs(p.getParent())
        fs.rename(_fs(spark, own)[0], p)
    else:
        fs.delete(_fs(spark, own)[0], True)  # another session was first
    return path
