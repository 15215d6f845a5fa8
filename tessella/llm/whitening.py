"""Whitening of embeddings: exact centred scatter, pivoted Cholesky, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.staging import stage

#: Vectors that one matrix product takes.
ROWS = 1024
_EXACT = 1 << 53


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each entry as long; null where the vector is null or has a null or non-finite entry.

    Entries beyond the range of long take its end.
    """
    fine = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = col.value_lengths().to_numpy()
    flat = col.flatten().to_numpy()
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _top(m: np.ndarray) -> int:
    """Largest magnitude of integers, as a Python int."""
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def _centred(m: np.ndarray, factor: int, shift: list[int]) -> np.ndarray:
    """factor * m - shift without overflow: 64-bit where that holds, Python's integers otherwise."""
    if factor * _top(m) + max(map(abs, shift), default=0) < 1 << 62:
        return m * factor - np.array(shift, np.int64)
    return m.astype(object) * factor - np.array(shift, object)


def _product(y: np.ndarray) -> np.ndarray:
    """y' y of integers, exactly: in doubles where every sum stays below 2^53, else in Python's integers."""
    if y.dtype != object and _top(y) ** 2 * len(y) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of the vectors ``x`` and the sum of each dimension, exact."""

    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            n += len(m)
            total = total + (m.sum(0) if _top(m) * max(1, len(m)) < 1 << 62 else m.astype(object).sum(0))
        if n:
            values = [n, *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38))], names=["i", "v"])

    parts = fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    at = {r.i: int(r.v) for r in parts}
    return at.get(0, 0), [at.get(i + 1, 0) for i in range(dims)]


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the vectors ``x``, each entry an exact fraction rounded once.

    Vectors are centred on the rounded means before they are multiplied; what the rounding leaves is taken off exactly.  A task sends
    one sum for each pair of dimensions, Spark adds them up, and dims^2 / 2 numbers come back, however many vectors there are.
    """
    dims = len(total)
    middle = [(2 * s + n) // (2 * n) for s in total]

    def run(batches):
        acc = np.zeros((dims, dims), object)
        some = False
        for batch in batches:
            y = _centred(_matrix(batch.column(0), dims), 1, middle)
            for k in range(0, len(y), ROWS):
                acc, some = acc + _product(y[k : k + ROWS]), True
        if some:
            i, j = np.triu_indices(dims)
            v = [Decimal(int(a)) for a in acc[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38))], names=["i", "j", "v"])

    out = np.zeros((dims, dims))
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    for r in fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = (n * int(r.v) - rest[r.i] * rest[r.j]) / (n * n)
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a and as many columns as ``a`` has rank; the rows of L are lower triangular in the order of its pivots.

    The largest remaining diagonal entry is the next pivot; what is below rounding of the trace counts as zero.
    """
    rest = np.diag(a).astype(float).copy()
    out = np.zeros((len(a), len(a)))
    free = np.ones(len(a), bool)
    least = len(a) * np.finfo(float).eps * rest.sum()
    for k in range(len(a)):
        p = int(np.argmax(np.where(free, rest, -1.0)))
        if not rest[p] > least:
            return out[:, :k]
        out[p, k] = np.sqrt(rest[p])
        free[p] = False
        out[free, k] = (a[free, p] - out[free, :k] @ out[p, :k]) / out[p, k]
        rest[free] -= out[free, k] ** 2
    return out


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of l l', falling, and its unit eigenvectors as columns.

    Columns are rotated in pairs until all are orthogonal; then their squared norms are the eigenvalues, and normalised they are the
    eigenvectors.  Disjoint pairs turn together, in the rounds of a tournament.
    """
    r = l.shape[1]
    w = np.concatenate([l, np.zeros((len(l), r % 2))], axis=1)
    seats = np.arange(w.shape[1])
    for _ in range(sweeps):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            i, j = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            x, y = w[:, i], w[:, j]
            a, b, c = np.square(x).sum(0), np.square(y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > np.finfo(float).eps * np.sqrt(a * b)
            if turn.any():
                turned = True
                z = (b - a) / np.where(turn, 2 * c, 1.0)
                t = np.where(turn, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
                cos = 1 / np.hypot(1.0, t)
                w[:, i], w[:, j] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    value = np.square(w).sum(0)
    order = np.argsort(-value, kind="stable")[:r]
    unit = w[:, order] / np.sqrt(value[order])
    lead = np.abs(unit).argmax(0)
    return value[order], unit * np.where(unit[lead, np.arange(len(order))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """A fitted whitening: vectors' number, sums and dimensions, and the leading eigenvalues and components (columns)."""

    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def centred(self, m: np.ndarray) -> np.ndarray:
        """n * x - S of every row, exact."""
        return _centred(m, self.n, self.total)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ (self.components / np.sqrt(self.values))

    def transform(self, rows: DataFrame) -> DataFrame:
        """(vec_id, deviation, whitened) of rows (vec_id, x): sum of (n x - S)^2, exact, and the coordinates by falling eigenvalue."""
        dims = len(self.total)

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    c = self.centred(_matrix(part.column(1), dims))
                    far = np.square(c if _top(c) ** 2 * dims < 1 << 62 else c.astype(object)).sum(1)
                    w = self.project(c)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Decimal(int(v)) for v in far], pa.decimal128(38)), lists], names=["vec_id", "deviation", "whitened"])

        return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, fit: DataFrame) -> float:
        """Largest absolute entry of the whitened vectors' covariance less the identity: tasks' centred moments, merged in order."""
        dims, k = len(self.total), len(self.values)

        def run(batches):
            from pyspark import TaskContext

            n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
            for batch in batches:
                w = self.project(self.centred(_matrix(batch.column(0), dims)))
                n, mean, scatter = _merged((n, mean, scatter), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0)))) if len(w) else (n, mean, scatter)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["part", "n", "mean", "scatter"])

        parts = fit.select("x").mapInArrow(run, "part long, n long, mean array<double>, scatter array<double>").orderBy("part")
        whole = (0, np.zeros(k), np.zeros((k, k)))
        for p in parts.toLocalIterator():
            whole = _merged(whole, (p.n, np.array(p.mean), np.array(p.scatter).reshape(k, k)))
        return float(np.abs(whole[2] / max(1, whole[0]) - np.eye(k)).max(initial=0.0))


def _merged(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred scatter of two groups together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, all of one length (shorter ones end in zeros), staged."""
    dims = rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    padded = F.when(F.size("x") == dims, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    return stage(rows.select(padded.alias("x")).distinct(), "fit")


def whitening(fit: DataFrame, components: int) -> Whitening | None:
    """Fit on the distinct vectors ``x``; None if there is none.  No more components than the rank of their covariance."""
    first = fit.first()
    if first is None:
        return None
    n, total = sums(fit, len(first.x))
    v = covariance(fit, n, total)
    values, unit = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, total, values[:components], unit[:, :components], float(np.trace(v)))


def whitened(rows: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, x array<long>).

    The fit takes each distinct vector once, so copies, however many, don't pull it.  Sums and covariance are exact integers until
    one final rounding; only dims^2 numbers reach the driver, which factors the matrix there.  Eigenvectors have their largest entry
    positive.  Rows whose ``x`` is null take no part; repeated rows and ids come out once each; shorter vectors end in zeros.  If
    the covariance has fewer dimensions than ``components``, only those come out: none if all vectors are equal; an empty table gives
    no rows.  ``deviation`` is decimal(38); sums beyond that raise an error.  Jobs run as this is called.
    """
    spark = rows.sparkSession
    rows = rows.where("x IS NOT NULL").select("vec_id", "x")
    fit = distinct_vectors(rows)
    model = whitening(fit, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = model.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)), F.col("at") + 1)
    error = F.lit(model.identity_error(fit))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened coordinates of every row of ``embeddings``; a deviation beyond the range of long is null."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole(F.col("embedding")).alias("x"))
    return whitened(rows, 4).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
