"""Per-dimension statistics of vector columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.quantiles import exact_quantiles
from tessella.shared import cut


def dimension_statistics(rows: DataFrame, vector: str, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(by..., dim, n, mean, std, min, max, q01, q99): one row per dimension.

    ``std`` is the population's.  Nulls and NaN don't count; a dimension without values is null but for n = 0.  Quantiles
    interpolate linearly.  Exact ones are selected by passes over ``rows`` that narrow ranges (``exact_quantiles``), which
    run as this is called; ``exact=False`` takes mergeable sketches in the one pass of the other statistics.
    """
    by = by or []
    long = rows.select(*by, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")))
    basic = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    if not exact:
        return long.groupBy(*by, "dim").agg(*basic, *(F.percentile_approx("x", p, 10_000).alias(q) for p, q in ((0.01, "q01"), (0.99, "q99"))))
    basic = cut(long.groupBy(*by, "dim").agg(*basic), "extents")
    q = exact_quantiles(rows, vector, basic, [0.01, 0.99], by)
    met = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*by, "dim"]])
    return basic.alias("b").join(q.alias("q"), met, "left").select("b.*", F.col("quantiles")[0].alias("q01"), F.col("quantiles")[1].alias("q99"))


def as_struct(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per group) with ``stats``, a struct of arrays in dimension order."""
    names = ["mean", "std", "min", "max", "q01", "q99"]
    ordered = F.array_sort(F.collect_list(F.struct("dim", *names)))
    out = stats.groupBy(*(by or [])).agg(ordered.alias("_s"))
    return out.select(*(by or []), F.struct(*[F.col("_s")[n].alias(n) for n in names]).alias("stats"))
