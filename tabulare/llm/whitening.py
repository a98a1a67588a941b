"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers, x = floor(256 c). The distinct vectors are the
fit list; the components are the principal axes of its covariance. They come
from a QR factorisation of the centred fit list, not from the covariance
matrix: squaring would lose the small eigenvalues.

Each pass sums the Gram matrix of the rows as they are so far, scales it to a
unit diagonal, adds a shift and factors it (Cholesky); the next pass puts the
rows through one more triangular solve. The first pass is always shifted, so
that it succeeds at any condition number; later ones only while the Gram
matrix is near singular. When it is near the identity the product of all
factors is R with X = QR, and the singular values and right singular vectors
of R give variances and components. Columns that depend on others to rounding
error are left out of Q from the fourth pass on.

Rows are centred exactly: with S = n m + r, x - S/n = (n (x - m) - r) / n in
whole numbers.

Scale: the distinct vectors are written once and read by each pass (2 to 6);
a task sends one triangle of sums, added up by Spark per cell; the driver
holds matrices of the dimension squared, whatever the number of rows. Many
copies of one vector are combined before the shuffle.

Defined results for odd input: vectors that are NULL or hold NULL or
non-finite entries give no row; rows without id and repeated rows give theirs;
shorter vectors count as filled up with zeros to the longest; entries beyond
the range of long stay at its end; a deviation beyond long is NULL; a
component without variance (fewer distinct vectors than components, or
dependent entries) has explained 0 and whitened NULL and is left out of the
identity error; components end at the dimension; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

SCALE = 256
COMPONENTS = 4
CELLS = 1 << 20            # matrix entries a task holds at a time
PASSES = 8                 # more than any matrix needs; fewer are made
SHIFTED = 3                # passes that may shift; then dependent columns are left out
_EPS = float(np.finfo(float).eps)
_MAX = (1 << 63) - 1


def quantized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors that take part, ``x`` in whole numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = vectors.select("vec_id", F.col(column).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def _matrices(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and matrix of pieces of a list column, filled up with zeros."""
    rows = max(1, CELLS // max(dims, 1))
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        sizes = part.value_lengths().to_numpy(zero_copy_only=False)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if (sizes == dims).all():
            yield at, flat.reshape(-1, dims)
        else:
            x = np.zeros((len(part), dims), np.int64)
            x[np.arange(dims) < sizes[:, None]] = flat
            yield at, x


@dataclass
class Centre:
    """Size and column sums of the fit list: what centring needs."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S exactly; Python integers where 64 bits do not hold it."""
        low = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, low)]
        reach = max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, low)) if x.size else 0
        if self.n * (reach + 1) >= _MAX:
            x, low, rest = x.astype(object), np.array(low, object), np.array(rest, object)
            return self.n * (x - low) - rest
        return self.n * (x - np.array(low, np.int64)) - np.array(rest, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the columns of (n x - S)^2, exactly."""
        y = self.numerators(x)
        far = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
        if far * far * y.shape[1] > _MAX:
            y = y.astype(object)
        return [d if d <= _MAX else None for d in (y * y).sum(axis=1).tolist()]


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q of x = Q R by forward substitution; 0 in columns without a pivot."""
    q = np.zeros_like(x)
    for j in range(r.shape[0]):
        if r[j, j]:
            q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def factor(c: np.ndarray, shift: float, drop: float) -> np.ndarray:
    """Upper R with R'R = C + shift; a row without pivot stays zero where that is ``drop`` or less."""
    r = np.zeros_like(c)
    for j in range(len(c)):
        row = c[j, j:] - r[:j, j] @ r[:j, j:]
        row[0] += shift
        if row[0] > drop:
            r[j, j:] = row / np.sqrt(row[0])
    return r


def _sums(rows: DataFrame, dims: int) -> list[int]:
    """Exact sums per column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            for _, x in _matrices(batch.column(0), dims):
                # the high and low halves apart: neither sum leaves 64 bits
                hi, lo = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, hi, lo)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])
    got = rows.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r.s) for r in sorted(got, key=lambda r: r.i)]


def _gram(rows: DataFrame, dims: int, made) -> np.ndarray:
    """Sum over the rows of y'y, where ``made`` turns whole rows into y (``dims`` columns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in made(batch.column(0)):
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])
    out = np.zeros((dims, dims))
    for r in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def triangular(fit: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """R of the centred fit list, by repeated Gram passes."""
    factors: list[np.ndarray] = []
    whole = np.eye(dims)
    for turn in range(1, PASSES + 1):
        def made(column, factors=tuple(factors)):
            for _, x in _matrices(column, dims):
                y = centre.rows(x)
                for r in factors:
                    y = solved(y, r)
                yield y
        g = _gram(fit, dims, made)
        unit = np.sqrt(np.diag(g))
        unit[unit == 0] = 1.0
        c = g / unit / unit[:, None]
        values = np.linalg.eigvalsh(c)
        shift = 11 * (CELLS + dims * (dims + 1)) * _EPS * values[-1]
        shifting = turn == 1 or turn <= SHIFTED and values[0] < 100 * shift
        r = factor(c, shift if shifting else 0.0, 1e-8 if turn > SHIFTED else 0.0) * unit
        factors.append(r)
        whole = r @ whole
        held = np.diag(r) != 0
        if not shifting and np.abs(c - np.diag(held.astype(float)))[held].max(initial=0) < 1e-3:
            break
    return whole


@dataclass
class Whitening:
    """What whitening applies: variances (falling) and unit components, with the fit list's centre."""

    centre: Centre
    variances: np.ndarray
    components: np.ndarray     # one per row
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return self.components.shape[1]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        e = np.where(self.variances > 0, self.variances, np.nan)
        return self.centre.rows(x) @ self.components.T / np.sqrt(e)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on the distinct vectors of ``rows (x)``; None without any."""
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    size = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not size["n"] or not size["most"]:
        return None
    n, dims = size["n"], size["most"]
    if size["least"] < dims:                   # vectors that differ in length only by zeros are one
        zeros = F.array_repeat(F.lit(0).cast("long"), dims - F.size("x"))
        fit = materialize(fit.select(F.concat("x", zeros).alias("x")).distinct(), "whiten-fit")
        n = fit.count()
    centre = Centre(n, _sums(fit, dims))
    r = triangular(fit, dims, centre)
    _, sigma, axes = np.linalg.svd(r)
    least = dims * _EPS * _EPS * (sigma ** 2).sum()
    e = np.where(sigma ** 2 > least, sigma ** 2, 0.0) / n
    k = min(components, dims)
    axes = axes[:k] * np.sign(axes[np.arange(k), np.abs(axes[:k]).argmax(axis=1)])[:, None]      # largest entry positive
    w = Whitening(centre, e[:k], axes, e[:k] / e.sum() if e.sum() else np.zeros(k))
    real = int((w.variances > 0).sum())
    if real:
        cov = _gram(fit, real, lambda column: (w.whitened(x)[:, :real] for _, x in _matrices(column, dims))) / n
        w.identity_error = float(np.abs(cov - np.eye(real)).max())
    return w


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantized(vectors, column)
    w = fit_whitening(rows, components)
    if w is None:
        return spark.createDataFrame([], ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.variances)
        for batch in batches:
            for at, x in _matrices(batch.column(1), w.dims):
                m = len(x)
                each = np.repeat(np.arange(m), k)
                values = w.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.centre.n)), pa.array(w.centre.deviations(x), pa.int64()).take(pa.array(each)),
                     pa.array(values, mask=np.isnan(values)), pa.array(np.tile(w.explained, m)),
                     pa.array([w.identity_error] * (m * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, ddl)
