"""Whitening against NumPy's own decompositions and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessella.llm import whitening as W


@pytest.mark.parametrize("rank,dims", [(1, 1), (2, 5), (5, 5), (7, 8), (40, 64)])
def test_decomposition(rank, dims):
    rng = np.random.default_rng(rank)
    g = rng.normal(size=(dims, rank)) * np.logspace(0, -6, rank)
    a = g @ g.T
    l = W.pivoted_cholesky(a)
    assert l.shape == (dims, rank) and np.abs(l @ l.T - a).max() <= 1e-14 * np.trace(a)
    value, unit = W.one_sided_jacobi(l)
    assert np.abs(unit.T @ unit - np.eye(rank)).max() < 1e-12
    want = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.abs(value - want).max() <= 1e-14 * want[0] * dims
    assert np.abs(a @ unit - unit * value).max() <= 1e-13 * want[0] * dims
    assert W.one_sided_jacobi(np.zeros((3, 0)))[1].shape == (3, 0)


def direct(vectors):
    """x of every row, and sums, number and covariance of the distinct ones, by fractions."""
    x = {k: tuple(int(np.floor(256 * float(c))) for c in v) for k, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, dims = len(fit), len(fit[0])
    total = [sum(f[i] for f in fit) for i in range(dims)]
    m = np.array(fit, object) * n - np.array(total, object)
    cov = m.T @ m
    return x, n, total, np.array([[float(Fraction(int(c), n**3)) for c in r] for r in cov])


def compare(rows, vectors, top=4):
    x, n, total, v = direct(vectors)
    value, unit = np.linalg.eigh(v)
    value, unit = value[::-1][:top], unit[:, ::-1][:, :top]
    assert len(rows) == len(vectors) * top
    for r in rows:
        k = r.component - 1
        d = [n * a - s for a, s in zip(x[r.vec_id], total, strict=True)]
        assert r.n == n and r.deviation == sum(c * c for c in d) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(value[k] / np.trace(v), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(np.array([c / n for c in d]) @ unit[:, k]) / np.sqrt(value[k]), rel=1e-6, abs=1e-7)
    signs = {r.component: set() for r in rows}
    for r in rows:
        w = np.array([(n * a - s) / n for a, s in zip(x[r.vec_id], total, strict=True)]) @ unit[:, r.component - 1]
        if abs(r.whitened) > 1e-6:
            signs[r.component].add(np.sign(w * r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    compare(W.op12_whitening(spark, DATA).collect(), vectors)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = {k: [float(np.float32(c)) for c in rng.normal(size=6) * [50, 20, 9, 4, 2, 1] + 1e4] for k in range(60)}
    base |= {k: base[7] for k in range(60, 160)}  # copies count once
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows = [(k, v, "t", k) for k, v in [*base.items(), *bad]]
    shape = "vec_id long, embedding array<float>, x string, component long"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(W.op12_whitening(spark, str(tmp_path)).collect(), base)


def test_ranks_and_sizes(spark):
    put = lambda rows: spark.createDataFrame(rows, "vec_id long, x array<long>")
    assert W.whitened(put([])).count() == 0 and W.whitened(put([(1, None)])).count() == 0
    assert W.whitened(put([(1, [5, 6]), (2, [5, 6])])).count() == 0  # nothing varies
    line = W.whitened(put([(1, [0, 0]), (2, [3]), (3, [6, 0]), (None, [6, 0])])).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in line] == [(None, 1), (1, 1), (2, 1), (3, 1)]  # short vectors end in zeros
    assert [round(abs(r.whitened), 9) for r in line] == [round(1.5**0.5, 9), round(1.5**0.5, 9), 0, round(1.5**0.5, 9)]
    far = 1 << 40
    big = W.whitened(put([(k, [far + k * k, -far * k, k]) for k in range(50)])).collect()
    n, total = 50, [sum(far + k * k for k in range(50)), sum(-far * k for k in range(50)), sum(range(50))]
    want = {k: sum((n * c - s) ** 2 for c, s in zip([far + k * k, -far * k, k], total, strict=True)) for k in range(50)}
    assert all(int(r.deviation) == want[r.vec_id] for r in big)
    assert W.whitened(put([(1, [far]), (2, [0])])).select(F.expr("try_cast(deviation AS bigint)")).first()[0] is None
