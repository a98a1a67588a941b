"""Shared scratch folder and derived inputs."""

import os
import subprocess
import sys

import pytest

from tabulare.session import clear_scratch, derived_input, files_key, path_exists, scratch_path, shared_dir


def test_scratch_under_checkpoint_dir(spark):
    root = shared_dir(spark)
    assert root and scratch_path(spark, "x").startswith(root)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_derived_input_built_once_and_rebuilt_if_interrupted(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src.txt")
    with open(src, "w") as fh:
        fh.write("a\n")
    calls = []

    def build(path):
        calls.append(path)
        spark.createDataFrame([("x",)], "v string").write.mode("overwrite").text(path)

    p1 = derived_input(spark, "t", [src], build)
    p2 = derived_input(spark, "t", [src], build)
    assert p1 == p2 and len(calls) == 1
    os.remove(p1.replace("file:", "") + "/_SUCCESS")          # an interrupted build
    derived_input(spark, "t", [src], build)
    assert len(calls) == 2
    with open(src, "a") as fh:                                  # a changed source: new folder
        fh.write("b\n")
    assert derived_input(spark, "t", [src], build) != p1


def test_clear_scratch(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    clear_scratch(spark)
    assert not path_exists(spark, path)


@pytest.mark.parametrize("stop", [True, False])
def test_scratch_goes_with_the_process(tmpdir_path, stop):
    """Also after ``spark.stop()``; derived inputs stay for the next application."""
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tabulare.session import build_session, derived_input, scratch_path
spark = build_session("local[1]", 1)
spark.range(3).write.parquet(scratch_path(spark, "x"))
derived_input(spark, "d", [], lambda p: spark.range(3).write.parquet(p))
{"spark.stop()" if stop else ""}
"""
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file://{tmpdir_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300, env=env)
    left = os.listdir(tmpdir_path + "/tabulare")
    assert left == ["derived"], left


def test_files_key_follows_files_in_a_folder(spark, tmpdir_path):
    spark.range(3).write.parquet(tmpdir_path + "/t")
    before = files_key(spark, tmpdir_path + "/t")
    spark.range(2).write.mode("append").parquet(tmpdir_path + "/t")
    assert files_key(spark, tmpdir_path + "/t") != before


def test_package_is_shipped_to_python_workers(spark):
    from tabulare.session import ship_package

    def worker_paths(batches):          # nested: pickled by value, not by module
        import sys as _sys

        import pandas as _pd
        for _ in batches:
            yield _pd.DataFrame({"shipped": [any(p.endswith("tabulare.zip") for p in _sys.path)]})

    ship_package(spark)
    got = spark.range(1).mapInPandas(worker_paths, "shipped boolean").collect()
    assert all(r.shipped for r in got)
