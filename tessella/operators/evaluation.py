"""Frame metrics rolled up to episodes, checkpoints and datasets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def no_nan(c: Column) -> Column:
    """NaN (not computed) as null, so that aggregates pass it over."""
    return F.when(~F.isnan(c), c)


def frame_decay(frames: DataFrame, by: list[str], early: int, mid: int) -> DataFrame:
    """Per group the mean, population deviation and slope over ``t`` of ``l1``, and the means of its early, middle and
    late frames.  Frame 0 is the given one and doesn't count; a single frame has no slope (NaN)."""
    rows = frames.where("t > 0")
    part = lambda test: F.avg(F.when(test, F.col("l1")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("l1").alias("mean_l1"),
        F.stddev_pop("l1").alias("std_l1"),
        F.coalesce(F.when(F.count("*") > 1, F.regr_slope("l1", "t")), F.lit(NAN)).alias("slope"),
        F.coalesce(part(F.col("t") <= early), F.lit(NAN)).alias("early"),
        F.coalesce(part((F.col("t") > early) & (F.col("t") <= mid)), F.lit(NAN)).alias("middle"),
        F.coalesce(part(F.col("t") > mid), F.lit(NAN)).alias("late"),
    )


def score_and_coverage(value: Column) -> tuple[Column, Column]:
    """Median of the valid values, and their share in percent."""
    return F.median(no_nan(value)), 100 * F.avg(F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(1.0))


def ci95(value: Column) -> tuple[Column, Column]:
    """Mean -+ 1.96 standard errors (sample deviation); one value is its own interval."""
    half = F.coalesce(F.when(F.count(value) > 1, 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))), F.lit(0.0))
    return F.avg(value) - half, F.avg(value) + half


def checkpoint_summary(episodes: DataFrame, metrics: list[str]) -> DataFrame:
    """Per checkpoint, and per checkpoint and dataset (dataset null for all): of each metric the count, mean, population
    deviation and interval over episodes; metrics without data are null."""
    cols = []
    for m in metrics:
        v = no_nan(F.col(m))
        low, high = ci95(v)
        cols += [F.count(v).alias(f"{m}_n"), F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std"), low.alias(f"{m}_low"), high.alias(f"{m}_high")]
    return episodes.groupingSets([["checkpoint"], ["checkpoint", "dataset"]], "checkpoint", "dataset").agg(*cols)


def stitched(chunks: DataFrame) -> DataFrame:
    """Frames of consecutive chunks (episode, chunk, t) in order, without the first of every chunk but the first."""
    from pyspark.sql import Window

    order = Window.partitionBy("episode").orderBy("chunk", "t")
    return chunks.where("chunk = 0 OR t > 0").withColumn("frame", F.row_number().over(order) - 1)


def zncc(rows: DataFrame, by: list[str], a: str, b: str, eps: float = 1e-8) -> DataFrame:
    """Zero-mean normalized cross-correlation of two columns per group: covariance / (product of deviations + eps)."""
    return rows.groupBy(*by).agg((F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + eps)).alias("zncc"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest matching of rows to columns by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = r, -1, 0.0
        while True:
            reach = base + c[row] - row_price[row] - col_price
            better = ~done & (reach < dist)
            dist[better], came[better] = reach[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[col] = dist[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        seen = done.copy()
        seen[col] = False
        row_price[r] += base
        for k in np.flatnonzero(seen):
            row_price[owner[k]] += base - dist[k]
            col_price[k] -= base - dist[k]
        while col >= 0:
            back = came[col]
            owner[col] = r if back < 0 else owner[back]
            col = back
    pairs = [(int(owner[k]), k) for k in range(m) if owner[k] >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def centroid_distance(points: DataFrame, by: list[str], miss: float) -> DataFrame:
    """Per frame the mean distance of the true centroids (side 0) to the generated ones (side 1) that match them best, ``miss`` for
    each that has none.

    Frames without true centroids are NaN; generated ones in surplus don't count.  A frame has a handful of points; frames are
    grouped over the cluster.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf.loc[pdf["side"] == s, ["x", "y"]].to_numpy(float) for s in (0, 1))
        value = NAN
        if len(a):
            gap = np.hypot(*(a[:, None, :] - b[None, :, :]).transpose(2, 0, 1))
            pairs = assignment(gap) if len(b) else []
            value = (sum(gap[p] for p in pairs) + miss * (len(a) - len(pairs))) / len(a)
        return pd.DataFrame([[*key, value]], columns=[*by, "distance"])

    return points.groupBy(*by).applyInPandas(run, f"{names}, distance double")


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, high: float = 1.0) -> float:
    """Mean structural similarity of two grey images over uniform windows."""
    def mean(x):
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    c1, c2, ma, mb = (0.01 * high) ** 2, (0.03 * high) ** 2, mean(a), mean(b)
    n = window**2 / (window**2 - 1)
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))))


def frame_ssim(side: int):
    """A vectorized function: SSIM of two flattened square images of ``side`` pixels."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        image = lambda v: np.asarray(v, float).reshape(side, side)
        return pd.Series([ssim(image(x), image(y)) for x, y in zip(a, b, strict=True)])

    return run


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in scan order: labels spread until nothing changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(lab, 1)
        near = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        low = np.where(near > 0, near, mask.size + 1).min(0)
        new = np.where(mask, low, 0)
        if (new == lab).all():
            return np.unique(lab, return_inverse=True)[1].reshape(lab.shape) if (lab == 0).any() else np.unique(lab, return_inverse=True)[1].reshape(lab.shape) + 1
        lab = new
