"""Embedding whitening, filter interaction audit and line dedup."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabulare.llm import filter_audit, line_dedup, whitening

from .conftest import DDL, LONG, SF


# ---------------------------------------------------------------- 11 whitening
def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n", "3 AS i", "4 AS component")


def _plain(vectors, k=4):
    """n, per-row deviations, variances and axes from the covariance in rationals, then eigh in long double steps."""
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    fit = [list(t) for t in sorted({tuple(r) for r in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    y = [[Fraction(a) - Fraction(s, n) for a, s in zip(r, sums)] for r in fit]
    d = len(sums)
    cov = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(r, sums)] for r in x])
    return n, deviations, e[::-1][:k], v[:, ::-1][:, :k], centred, np.trace(cov)


def _hold(got, ids, vectors, k=4):
    n, deviations, e, v, centred, trace = _plain(vectors, k)
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r
    assert sorted(by) == list(range(1, min(k, len(e)) + 1))
    for c in by:
        assert {r.n for r in by[c].values()} == {n} and [by[c][i].deviation for i in ids] == deviations
        want = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([by[c][i].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6 * max(1, np.abs(want).max())
        assert {abs(r.explained - e[c - 1] / trace) < 1e-9 for r in by[c].values()} == {True}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whitening_equals_the_covariance_of_the_fit_list(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    _hold(whitening.whiten(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_with_copies_offsets_and_uneven_scales(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * [1e4, 30, 3, 0.4, 0.1, 0.02] + [1e7, -5, 0, 1e4, 0, 0]
    x = np.vstack([base, base[:1].repeat(40, axis=0)])                  # two fifths are one vector
    _hold(whitening.whiten(_vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])).collect(), list(range(len(x))), x.tolist())


def test_small_variances_beside_a_large_one_keep_their_digits(spark):
    """Variances 1e16 apart: the covariance matrix in doubles could not hold the small ones."""
    rng = np.random.default_rng(5)
    big, small = np.array([-1.0] * 32 + [1.0] * 32) * 1e10, rng.integers(-64, 64, (64, 2)) / 256 * 100
    x = np.c_[big, small[:, 0], small[:, 1]]
    got = [r for r in whitening.whiten(_vectors(spark, [(i, r.tolist()) for i, r in enumerate(x)])).collect()]
    own = np.floor(x * 256)
    own -= own.mean(axis=0)
    own[:, 1:] -= np.outer(own[:, 0], own[:, 0] @ own[:, 1:] / (own[:, 0] @ own[:, 0]))   # what the large one does not explain
    e = np.linalg.eigvalsh(own[:, 1:].T @ own[:, 1:] / 64)[::-1]
    trace = (own ** 2).sum() / 64
    shares = {r.component: r.explained for r in got}
    assert abs(shares[2] / (e[0] / trace) - 1) < 1e-4 and abs(shares[3] / (e[1] / trace) - 1) < 1e-4
    assert got[0].identity_error < 1e-4


def test_cholesky_qr_gives_r(spark):
    rng = np.random.default_rng(1)
    for x in (rng.integers(-999, 999, (300, 7)), np.c_[rng.integers(-9, 9, (50, 2)), np.zeros((50, 1), int)]):
        x = np.c_[x, x[:, :1]].astype(np.int64)                        # a column twice
        fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>")
        centre = whitening.Centre(len(x), x.sum(axis=0).tolist())
        r = whitening.triangular(fit, x.shape[1], centre)
        y = x - x.mean(axis=0)
        assert np.allclose(np.triu(r), r) and np.allclose(r.T @ r, y.T @ y, rtol=1e-9, atol=1e-6)
        real = np.linalg.svd(y)[1] > 1e-6
        assert np.allclose(np.linalg.svd(r)[1][real], np.linalg.svd(y)[1][real], rtol=1e-9)


def test_whitening_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0]), (None, [0.5, -0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-0.0, 2.0]),
            (8, []), (9, [1.0, 0.0])]
    got = whitening.whiten(_vectors(spark, rows)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, 2: 2, None: 2, 7: 2, 8: 2, 9: 2} and {r.component for r in got} == {1, 2}
    assert {r.n for r in got} == {5}                                    # [1] and [1, 0] are one vector
    assert got[0].identity_error < 1e-9 and abs(sum(r.explained for r in got if r.vec_id == 7) - 1) < 1e-9
    one = whitening.whiten(_vectors(spark, [(1, [3.0, 4.0]), (2, [3.0, 4.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    huge = whitening.whiten(_vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id != 3) and len(huge) == 6
    for none in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(_vectors(spark, none)).collect() == []


# ---------------------------------------------------------------- 12 filter audit
def _fails(rows):
    """The filters each row fails, by plain counting."""
    out = []
    for i, r in enumerate(rows):
        text = r["text"] or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
             "D": any(c in "#$%&*|" for c in text),
             "E": r["doc_id"] is not None and any(s["doc_id"] is not None and s["doc_id"] < r["doc_id"] and (s["text"] or "") == text for s in rows)}
        out.append({k for k, v in f.items() if v})
    return out


def _walk(rows, labels):
    """Apply every order one filter after another."""
    fails, out = _fails(rows), {}
    parts = {r["source"] or "" for r in rows}
    for part in parts:
        mine = [(f, labels.get(r["doc_id"], (0, 0))) for r, f in zip(rows, fails) if (r["source"] or "") == part]
        total = Counter()
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(p), step] = [len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine),
                                               sum(x[1][0] for x in gone), sum(x[1][1] for x in gone), f]
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = total[out[k][-1]]
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_walking_every_order(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ".join(words), " ".join(words[:10] * 30), "A" * 50 + " ".join(words), "# " + " ".join(words), " ".join(words[:199]), " ".join(words[:200]),
             " ".join(words[:100] * 2), "\x0b".join(words[:250]), " ".join(words), "X|Y", "É" * 300, "word " * 99 + "A" * 10]
    rows = [{"doc_id": int(i) if i % 17 else None, "text": texts[int(rng.integers(len(texts)))], "source": [None, "", "a", "b"][int(rng.integers(4))]}
            for i in range(1, 120)] + [{"doc_id": 5, "text": "twice", "source": "a"}] * 2 + [{"doc_id": 5, "text": "twice", "source": "b"}]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    df = df.selectExpr("*", "1 AS part", "2 AS mask", "3 AS same", "4 AS copies", "5 AS quality", "6 AS first")
    marks = {i: (int(i % 3 == 0), int(i % 5 == 0)) for i in range(1, 120, 2)}
    labels = spark.createDataFrame([(i, *m) for i, m in marks.items()] + [(None, 1, 1), (3, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got} == _walk(rows, marks) and len(got) == len({r["source"] or "" for r in rows}) * 600
    assert filter_audit.audit(df.where("false"), labels).count() == 0


def test_least_squares_gives_the_shapley_values():
    for n in (2, 3, 5):
        rng = np.random.default_rng(n)
        r = [0] + [int(x) for x in rng.integers(-50, 50, 2 ** n - 1)]
        total = [0] * n
        for p in permutations(range(n)):
            at = 0
            for i in p:
                total[i] += r[at | 1 << i] - r[at]
                at |= 1 << i
        assert [sum(c * x for c, x in zip(row, r)) for row in filter_audit.shapley_coefficients(n)] == total


def test_audit_odd_input(spark, odd):
    got = filter_audit.audit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * odd.select(F.coalesce("source", F.lit(""))).distinct().count()
    last = [r for r in got if r.filter_order == "ABCDE"]
    assert sum(r.kept for r in last if r.step == 5) + sum(r.removed for r in last) == odd.count()


# ---------------------------------------------------------------- 13 line dedup
SPACE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _tie(text):
    x = xxhash.xxh64_intdigest((text or "").encode())
    return x - (x >> 63 << 64)


def _deduped(rows):
    """Kept lines per row; rows without id are named by their text, after all ids in order of its hash."""
    who = lambda r: (r["doc_id"] is None, r["doc_id"] if r["doc_id"] is not None else _tie(r["text"]))
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders[_key(line)].add(who(r))
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(_key(x)) < 10 or who(r) == min(holders[_key(x)])]
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def _found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(df, text=False, digest=True).collect())


LINES = ["", "short", "a line that repeats", " A LINE that Repeats\t", "nine char", "ten chars!", "TEN CHARS!", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "\x0bvertical and form\x0c",
         "vertical and form", " a line that repeats", "tail\r", "carriage return line\r", "carriage return line"]


def test_line_dedup_equals_plain_counting(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        text = "\n".join([LINES[int(k)] for k in rng.integers(len(LINES), size=int(rng.integers(0, 9)))] + [f"own line number {i // 2}"])
        rows.append({"doc_id": [i, None, 7][0 if i % 5 else int(rng.integers(1, 3))], "text": text})
    rows += [{"doc_id": 400, "text": None}, {"doc_id": 401, "text": ""}, {"doc_id": None, "text": None}, rows[3], rows[3], {"doc_id": None, "text": "a line that repeats"},
             {"doc_id": None, "text": "a line that repeats"}]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(7)
    df = df.selectExpr("*", "1 AS hi", "2 AS lo", "3 AS tie", "4 AS keep", "5 AS `of`", "6 AS at")
    assert _found(df) == Counter(_deduped(rows))


def test_one_line_in_every_document_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = spark.range(5000).selectExpr("id AS doc_id", "'the same long line everywhere\nown line of ' || (id DIV 2) || '\nx' AS text").repartition(16)
        got = line_dedup.dedup_lines(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 5000
    for r in got:
        i = r.doc_id
        want = (["the same long line everywhere"] if i == 0 else []) + ([f"own line of {i // 2}"] if i % 2 == 0 or len(f"own line of {i // 2}") < 10 else []) + ["x"]
        assert r.text == "\n".join(want) and r.n_dropped == 3 - len(want)


def test_bitmaps_hold_a_bit_per_line(spark):
    docs = spark.createDataFrame([(1, "repeated line one\nb"), (2, "c\nRepeated Line One\nd")], "doc_id long, text string")
    r, = line_dedup.keep_bitmaps(docs).collect()
    assert (r.doc_id, r.n_lines, r.n_dropped) == (2, 3, 1)
    assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=3).tolist() == [1, 0, 1]


def test_line_dedup_odd_input(spark, odd):
    got = _found(odd)
    assert got == Counter(_deduped([{"doc_id": r.doc_id, "text": r.text} for r in odd.select("doc_id", "text").collect()]))
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0
    many = "\n".join(f"line number {i} of a very long text" for i in range(150_000))
    df = spark.createDataFrame([(2, many + "\n" + LONG), (1, many)], DDL.split(", lang")[0])
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()} == {1: (150_000, 0), 2: (150_001, 150_000)}
