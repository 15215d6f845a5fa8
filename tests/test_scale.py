"""Selection and numbering at scale: exact quantiles, and numbers in the order of any keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import numbering as N
from tessella.operators import quantiles as Q
from tessella.operators import shards as H
from tessella.operators import stats as S


def values(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    return {
        "smooth": rng.normal(size=n),
        "ties": rng.integers(0, 3, n).astype(float),
        "one": np.full(n, 7.25),
        "wide": np.exp(rng.uniform(-700, 700, n)) * rng.choice([-1, 1], n),
        "outlier": np.append(rng.normal(size=n - 1), 1.7e308),
        "both ends": np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308),
        "tiny": rng.integers(0, 5, n) * 5e-324,
    }[kind]


@pytest.mark.parametrize("bins", [4, 1024])
def test_quantiles_of_any_distribution(spark, monkeypatch, bins):
    monkeypatch.setattr(Q, "BINS", bins)
    kinds = ["smooth", "ties", "one", "outlier", "both ends", "tiny", "wide"]
    table = np.stack([values(k, 400) for k in kinds], axis=1)
    rows = spark.createDataFrame([(row.tolist(),) for row in table], "v array<double>").repartition(3)
    got = S.dimension_statistics(rows, "v").orderBy("dim").collect()
    for r, k in zip(got, range(len(kinds)), strict=True):
        x = np.sort(table[:, k])
        for q, p in ((r.q01, 0.01), (r.q99, 0.99)):
            h = 399 * p
            a, b = x[int(h)], x[int(np.ceil(h))]
            assert q == pytest.approx(a + (h - int(h)) * (b - a), rel=1e-12)
        assert (r.n, r.min, r.max) == (400, x[0], x[-1])


def test_quantiles_by_group_with_gaps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else g, [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.integers(-9, 9)) for _ in range(g + 1)]) for g in range(4) for _ in range(60 * g + 1)]
    rows += [(9, [None]), (9, None), (9, [])]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(4)
    for most in (10_000, 0):  # broadcast and shuffled ranges
        monkeypatch.setattr(Q, "MOST_BROADCAST", most)
        got = {(r.g, r.dim): r for r in S.dimension_statistics(df, "v", ["g"]).collect()}
        want = {}
        for g, v in rows:
            for d, x in enumerate(v or []):
                want.setdefault((g, d), []).append(x)
        assert set(got) == set(want)
        for k, all_ in want.items():
            x = [y for y in all_ if y is not None and y == y]
            assert got[k].n == len(x)
            if x:
                assert got[k].q01 == pytest.approx(np.quantile(x, 0.01)) and got[k].q99 == pytest.approx(np.quantile(x, 0.99))
                assert got[k].mean == pytest.approx(np.mean(x)) and got[k].std == pytest.approx(np.std(x), abs=1e-12)
            else:
                assert got[k].q01 is None and got[k].min is None
    assert S.dimension_statistics(df.limit(0), "v", ["g"]).count() == 0


def test_no_plan_gathers_values(spark):
    """Neither lists of values nor percentiles: what the statistics read is staged bins."""
    rows = spark.createDataFrame([([float(k)],) for k in range(50)], "v array<double>")
    plan = S.dimension_statistics(rows, "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list(x" not in plan


def test_numbers_of_any_keys(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000).tolist()
    rows = [(k, f"k{k % 977:03d}", [k % 5], {"m": k}) for k in keys] + [(None, None, None, None), (1, "k001", [1], {"m": 1}), (1, "k001", [1], {"m": 1})]
    df = spark.createDataFrame(rows, "k long, s string, a array<bigint>, m map<string, bigint>").repartition(5)
    got = [(r.position, r.k) for r in N.numbered(df, "k").collect()]
    want = sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [k for _, k in sorted(got)] == want and sorted(p for p, _ in got) == list(range(len(rows)))
    by = [(r.position, r.s, r.k) for r in N.numbered(df, "s", F.desc("k")).collect()]
    assert [(s, k) for _, s, k in sorted(by)] == sorted(((r[1], r[0]) for r in rows), key=lambda x: (x[0] is not None, x[0], -(x[1] or 0)))


def test_one_hot_key_is_spread(spark):
    df = spark.range(20000).select(F.lit("same").alias("s"), "id")
    parts = N.ordered(df, "s").groupBy("_part").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 20000 * 0.6
    got = N.numbered(df, "s")
    first = got.collect()
    assert sorted(r.position for r in first) == list(range(20000)) and sorted(first) == sorted(got.collect())


def test_running_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(f"e{rng.integers(1 << 40):x}", None if k % 9 == 0 else int(rng.integers(0, 50)), k) for k in range(2000)]
    got = N.prefix_sum(spark.createDataFrame(rows, "e string, n long, id long"), "e", "n", "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: r.e):
        assert r.before == total
        total += r.n or 0
    assert N.prefix_sum(spark.createDataFrame([], "e string, n long"), "e", "n", "before").count() == 0


def test_zip_and_strides_by_text(spark):
    a = spark.createDataFrame([(f"a{k:02d}",) for k in range(7)], "x string")
    b = spark.createDataFrame([(f"b{k:02d}", k) for k in range(5)], "y string, k int")
    assert sorted((r.x, r.y) for r in H.zip_shortest(a, b, "x", "y").collect()) == [(f"a{k:02d}", f"b{k:02d}") for k in range(5)]
    got = H.assign_strided(a, "x", 2, 2, start=1).collect()  # six shards padded to eight
    assert sorted((r.slot, r.x, r["rank"], r.worker) for r in got) == [(s, f"a{1 + s % 6:02d}", s % 2, s // 2 % 2) for s in range(8)]
