"""Wide fixed-width records: the byte matrix gives what the column expressions give."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tabulare.sources.fwf import LATIN1, encode_line, parse_fwf
from tabulare.sources.layout import Layout
from tabulare.sources.wide import encode_line_wide, encode_records, parse_fwf_wide

_K = ("variable", "description", "start", "end", "length", "decimals", "type")


def _layout(widths, rule):
    rows, at = [], 1
    for i, (w, decimals, kind) in enumerate(widths):
        rows.append(dict(zip(_K, (f"V{i}", f"campo {i}", at, at + w - 1, w, decimals, kind))))
        at += w
    return Layout.from_rows(rows, rule)


CENSUS = _layout([(1, "", "N"), (2, "", "N"), (4, "", "N"), (9, "", "N"), (12, "", "N"), (16, "13", "N"), (6, "2", "N"), (7, "", "T"), (19, "", "N"), (20, "3", "N")], "census")
PNADC = _layout([(1, "", "N"), (2, "", "N"), (4, "", "N"), (9, "", "N"), (15, "", "N"), (22, "", "N"), (7, "", "T")], "pnadc")


def _line(rng, layout, wild):
    out = ""
    for f in layout.fields:
        w = f.width
        kind = layout.spark_type(f).simpleString()
        room = {"tinyint": min(w, 2), "smallint": min(w, 4), "int": min(w, 9), "bigint": min(w, 18)}.get(kind, min(w, 18))
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, room)))
        way = rng.random()
        if kind == "string":
            text = "".join(rng.choice("ab Zé\xa0ñ") for _ in range(rng.randint(0, w))) if wild else rng.choice(["", "abc", " a b"])
            out += text.rjust(w) if way < 0.5 else text.ljust(w)
        elif way < 0.15:
            out += " " * w
        elif way < 0.3:
            out += digits.rjust(w)
        elif wild and way < 0.36:
            out += digits.ljust(w)
        elif wild and way < 0.42 and w > 3:
            out += ("-" + digits[: w - 2]).rjust(w)
        elif kind == "double" and layout.rule == "pnadc" and way < 0.8:
            d = digits[: w - 1]
            k = rng.randint(0, len(d))
            out += (d[:k] + "." + d[k:]).rjust(w, rng.choice(" 0"))
        else:
            out += digits.zfill(w)
    return out


@pytest.mark.parametrize("layout", [CENSUS, PNADC], ids=["census", "pnadc"])
@pytest.mark.parametrize("wild", [False, True])
def test_equal_to_the_column_expressions(spark, layout, wild):
    rng = random.Random(11)
    lines = [_line(rng, layout, wild) for _ in range(3000)]
    if wild:
        lines += [lines[0][:-3], lines[1] + "tail", "", None]
    data = [(i, None if x is None else bytearray(x.encode("latin-1"))) for i, x in enumerate(lines)]
    df = spark.createDataFrame(data, "n int, value binary").repartition(3)
    for strict in (True, False):
        old = parse_fwf(df, layout, encoding=LATIN1, keep=["n"], strict=strict)
        new = parse_fwf_wide(df, layout, encoding=LATIN1, keep=["n"], strict=strict)
        assert new.schema == old.schema or [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in old.schema]
        assert sorted(new.collect()) == sorted(old.collect()) if not wild else {r.n: r for r in new.collect()} == {r.n: r for r in old.collect()}


def test_utf8_lines_chosen_fields_and_codes(spark):
    lines = ["112345    7", "1é2345    7", "1 2345    8", "9"]
    layout = _layout([(1, "", "N"), (5, "", "T"), (5, "", "N")], "census")
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    kw = dict(encoding=None, mapped=False, fields=["V1", "V2"])
    assert sorted(map(str, parse_fwf_wide(df, layout, **kw).collect())) == sorted(map(str, parse_fwf(df, layout, **kw).collect()))
    assert parse_fwf_wide(df.where("false"), layout, **kw).count() == 0


@pytest.mark.parametrize("field", ["1x", "300", "1.5", "--1", "1e1"])
def test_bad_numbers_fail_or_become_null(spark, field):
    layout = _layout([(3, "", "N"), (2, "", "N")], "census")
    layout = Layout.from_rows([dict(zip(_K, ("A", "a", 1, 3, 2, "", "N"))), dict(zip(_K, ("B", "b", 4, 5, 2, "", "N")))], "census")
    df = spark.createDataFrame([(field.rjust(3) + "07",), ("  1 2",)], "value string")
    assert sorted(map(str, parse_fwf_wide(df, layout, strict=False).collect())) == sorted(map(str, parse_fwf(df, layout, strict=False).collect()))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CAST_OVERFLOW"):
        parse_fwf_wide(df, layout).select(F.col("a")).collect()


# text and numbers with a written point between runs of numbers; gaps before, inside and between runs
TO_WRITE = {
    "census": [("A", 3, 3, ""), ("B", 4, 5, ""), ("C", 9, 17, ""), ("D", 18, 24, "2"), ("T", 26, 30, "T"), ("E", 33, 44, ""), ("F", 45, 64, "3")],
    "pnadc": [("A", 3, 3, ""), ("B", 4, 5, ""), ("D", 9, 20, "point"), ("C", 21, 25, ""), ("T", 26, 30, "T"), ("E", 33, 38, "")],
}


@pytest.mark.parametrize("rule", ["census", "pnadc"])
def test_written_as_by_the_column_expressions(spark, rule):
    layout = Layout.from_rows([dict(zip(_K, (v, v, a, b, b - a + 1, d if d in ("2", "3") else "", "T" if d == "T" else "N")))
                               for v, a, b, d in TO_WRITE[rule]], rule)
    rng = random.Random(5)

    def value(f):
        if rng.random() < 0.2:
            return None
        kind, w = layout.spark_type(f).simpleString(), f.width
        if kind == "string":
            return rng.choice(["", "ab", "é ñ", "longer than the field"])
        if kind == "double":
            return rng.choice([0.0, -0.0, 1.25, -3.5, 0.005, 0.015, -1e-9, rng.uniform(-99, 99)])
        return rng.choice([0, 9, 10 ** w - 1, *([-1, 1 - 10 ** (w - 1)] if w > 1 else [])])
    types = {"string": "string", "double": "double"}
    schema = "i int, " + ", ".join(f"{f.variable} {types.get(layout.spark_type(f).simpleString(), 'long')}" for f in layout.fields)
    df = spark.createDataFrame([(i, *[value(f) for f in layout.fields]) for i in range(1500)], schema).repartition(3)
    values = {f.variable: F.col(f.variable) for f in layout.fields}
    got = df.select("i", encode_line(layout, values).alias("old"), encode_line_wide(layout, values).alias("new")).collect()
    assert len(got) == 1500 and [r.new for r in got] == [r.old for r in got]
    assert df.where("false").select(encode_line_wide(layout, values)).count() == 0


@pytest.mark.parametrize("value, width", [(123, 2), (-12, 2), (-1, 1), (10 ** 18, 18)])
def test_a_number_too_wide_fails_the_job(spark, value, width):
    layout = Layout.from_rows([dict(zip(_K, ("A", "a", 1, width, width, "", "N"))), dict(zip(_K, ("B", "b", width + 1, width + 1, 1, "", "N")))])
    df = spark.createDataFrame([(1, 1), (value, 2)], "a long, b long")
    for line in (encode_line, encode_line_wide):
        with pytest.raises(Exception, match="too wide for fixed-width field A"):
            df.select(line(layout, {"A": F.col("a"), "B": F.col("b")})).collect()


def test_the_widest_longs(spark):
    layout = Layout.from_rows([dict(zip(_K, ("A", "a", 1, 20, 20, "", "N"))), dict(zip(_K, ("B", "b", 21, 39, 19, "", "N")))])
    df = spark.createDataFrame([(-(2 ** 63 - 1), 2 ** 63 - 1), (2 ** 63 - 1, 1 - 10 ** 18)], "a long, b long")
    values = {"A": F.col("a"), "B": F.col("b")}
    got = df.select(encode_line(layout, values).alias("old"), encode_line_wide(layout, values).alias("new")).collect()
    assert [r.new for r in got] == [r.old for r in got]


def test_wide_records_are_written_in_compressed_files_by_many_tasks(spark, tmpdir_path, monkeypatch):
    from tabulare.plans import q_ingest
    from tabulare.session import shared_dir

    monkeypatch.setattr(q_ingest, "_WIDE_LINES_PER_FILE", 100)
    rows = [(None if i % 97 == 0 else i * 3, i % 500 or None) for i in range(3000)] + [(9, 9)] * 2
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmpdir_path}/orders.parquet")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tabulare/derived/fwf-wide-*"))
    got = q_ingest._fwf_wide(spark, tmpdir_path)
    (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tabulare/derived/fwf-wide-*")) - before
    files = [os.path.getsize(f) for f in glob.glob(f"{path}/part-*")]
    assert len(files) >= 31                                      # 100 lines at most; one file of all before
    assert sum(files) < 0.8 * len(rows) * (q_ingest.WIDE.record_width() + 1)
    table = spark.read.parquet(f"{tmpdir_path}/orders.parquet")
    want = table.select(*[F.expr(v).alias(f"campo_{i}") for i, v in enumerate(q_ingest._WIDE_VALUES.values())])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = encode_records(table, q_ingest.WIDE, {k: F.expr(v) for k, v in q_ingest._WIDE_VALUES.items()})._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lpad" not in plan
