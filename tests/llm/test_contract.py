"""Registered queries against their SQL, and the pipeline against its parts."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P

from .conftest import SF
from .test_documents import WORDS, _base, _classes, _fingerprint, reference_encoding  # noqa: F401


def test_all_operators_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert {re.match(r"op(\d+)_", n).group(1) for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_native_plans_hold_no_python(spark, docs):
    from tabulare.llm import fingerprints, pii
    for df in (fingerprints.fingerprints(docs), pii.report(docs), pii.located(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stage_by_stage(spark, docs, reference_encoding):  # noqa: F811
    from tabulare.llm.common import materialize
    kept, frames = docs, []
    for name, stage in P.STAGES:
        kept = materialize(stage(spark, kept, SF), "stage")
        frames.append(kept.collect())
        if name != P.STAGES[-1][0]:
            assert kept.columns == docs.columns
    accepted, unique, masked, mixed, encoded = frames
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r.doc_id in {x.doc_id for x in accepted}) == bool(quality[r.doc_id]) for r in docs.collect() if r.doc_id in quality]
    assert sum(known) / len(known) > 0.95
    accepted.sort(key=lambda r: r.doc_id)
    classes = _classes([_fingerprint(r.text) for r in accepted])
    assert sorted(r.doc_id for r in unique) == sorted(accepted[c].doc_id for c in set(classes))
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in unique) and not any(_base(r.text) for r in masked)
    clean = {r.doc_id: r.text for r in unique if not _base(r.text)}
    assert all(r.text == clean[r.doc_id] for r in masked if r.doc_id in clean)
    words = lambda rows: Counter({s: sum(len(WORDS.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    before, after = words(masked), words(mixed)
    assert abs(sum(after.values()) - sum(before.values())) <= len(before) and all(after[s] <= 3 * before[s] for s in after)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    want = Counter((r.doc_id, tuple(reference_encoding.encode_ordinary(r.text or ""))) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == want


def test_pipeline_on_odd_documents(spark, odd, docs, tmp_path):
    """NULLs, empty and very long texts, repeated rows, rows without id, clashing extra columns; and no documents at all."""
    from tabulare.llm.common import materialize
    both = odd.unionByName(docs.limit(60), allowMissingColumns=True)
    for name, table, rows in (("odd", both, both.count()), ("none", both.where("false"), 0)):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, run in P.STAGES:
            before, kept = kept, materialize(run(spark, kept, sf), "stage")
            if stage == "SimHash near-dedup":
                texts = [r.text for r in kept.select("text").collect()]
                assert len({_fingerprint(t) for t in texts}) == len(texts)
                assert {_fingerprint(r.text) for r in before.select("text").collect()} >= {_fingerprint(t) for t in texts}
            elif stage == "PII":
                assert kept.count() == before.count() and not any(_base(r.text or "") for r in kept.collect())
            elif stage == "quality classifier":
                assert kept.count() <= rows
            if stage != P.STAGES[-1][0]:
                assert kept.columns == both.columns
        assert kept.count() == before.count() and (rows == 0) == (kept.count() == 0)
