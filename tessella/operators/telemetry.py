"""Telemetry: rank aggregates, timing, loss bins."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_metrics(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(ids, metrics, "metric", "value")


def metric_summary(long: DataFrame) -> DataFrame:
    """Average, maximum and minimum over ranks of each metric."""
    return long.groupBy("metric").agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"))


def slowest_rank(rows: DataFrame, by: list[str], rank: str, value: str) -> DataFrame:
    """Per group the rank with the highest mean, ties to the lowest rank."""
    means = rows.groupBy(*by, rank).agg(F.avg(value).alias("_m"))
    return means.groupBy(*by).agg(F.max_by(rank, F.struct("_m", -F.col(rank))).alias("rank"), F.max("_m").alias("mean"))


def mean_of_rank_means(rows: DataFrame, by: list[str], rank: str, loss: str) -> DataFrame:
    """Loss per group: mean over ranks of each rank's mean, NaN and infinite losses counted apart; none gives 0."""
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    inner = rows.groupBy(*by, rank).agg(F.avg(F.when(~bad, F.col(loss))).alias("_m"), F.count_if(bad).alias("_bad"))
    return inner.groupBy(*by).agg(F.coalesce(F.avg("_m"), F.lit(0.0)).alias("loss"), F.sum("_bad").alias("bad"))


def normal_bins(n: int, mean: float, std: float) -> list[float]:
    """Edges of n bins of equal probability for exp(normal): quantiles from 1 / 1000 to 999 / 1000."""
    d = NormalDist(mean, std)
    return [float(np.exp(d.inv_cdf(p))) for p in np.linspace(0.001, 0.999, n + 1)]


def bin_of(x: Column, edges: list[float]) -> Column:
    """Bin of x, the last one closed on the right; null outside."""
    at = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        upper = x <= edges[k + 1] if k == len(edges) - 2 else x < edges[k + 1]
        at = F.when((x >= edges[k]) & upper, k).otherwise(at)
    return at


def seconds_per_iteration(rows: DataFrame, by: list[str], time: str, every: int, step: int = 1) -> DataFrame:
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return rows.withColumn("seconds", gap / every / step)
