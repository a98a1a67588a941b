"""Property checks: fixed-width encode → parse is the identity; shares add up to 100."""

import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulare.operators import weighted
from tabulare.sources.fwf import encode_fwf, read_fwf
from tabulare.sources.layout import Layout

_K = ("variable", "description", "start", "end", "length", "decimals", "type")
LAYOUT = Layout.from_rows([dict(zip(_K, r)) for r in [
    ("A", "código curto", "1", "2", "2", "", "N"),          # byte
    ("B", "contagem", "4", "7", "4", "", "N"),              # short, after a gap
    ("C", "controle", "8", "16", "9", "", "N"),              # int
    ("D", "área", "17", "29", "13", "", "N"),                # long
    ("E", "peso", "30", "45", "3", "13", "N"),               # implied decimals
    ("F", "nome", "46", "55", "10", "", "T"),                # Latin-1 text
]])

row = st.tuples(
    st.one_of(st.none(), st.integers(0, 99)),
    st.one_of(st.none(), st.integers(-999, 9999)),
    st.one_of(st.none(), st.integers(0, 999_999_999)),
    st.one_of(st.none(), st.integers(0, 10 ** 13 - 1)),
    st.one_of(st.none(), st.integers(0, 10 ** 15).map(lambda n: n / 10 ** 13)),
    st.one_of(st.none(), st.text(alphabet="abcçãéÁ xyz0123", min_size=1, max_size=10)
              .map(str.strip).filter(bool)),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=40))
def test_fixed_width_round_trip(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, a int, b int, c int, d long, e double, f string")
    vals = {v: F.col(v.lower()) for v in "ABCDEF"}
    path = tempfile.mkdtemp(prefix="tabulare-prop-") + "/t"
    encode_fwf(df.orderBy("i"), LAYOUT, vals).coalesce(1).write.text(path)
    back = read_fwf(spark, path, LAYOUT, encoding=None).collect()   # text sink writes UTF-8
    got = [tuple(r) for r in back]
    want = [tuple(r) for r in rows]
    assert len(got) == len(want)
    norm = lambda t: tuple(round(x, 12) if isinstance(x, float) else x for x in t)
    assert sorted(map(norm, got), key=repr) == sorted(map(norm, want), key=repr)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.floats(0.01, 1e6)),
                     min_size=1, max_size=60))
def test_shares_add_up_to_100(spark, rows):
    df = spark.createDataFrame(rows, "v string, w double")
    for include_nulls in (False, True):
        pcts = [r.pct for r in weighted.weighted_distribution(df, "v", "w", include_nulls=include_nulls).collect()]
        if pcts:
            assert abs(sum(pcts) - 100.0) <= 0.05 * len(pcts) + 1e-9
