"""Exact quantiles by distributed selection: histograms narrow the ranges that hold the wanted ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.shared import cut

#: Bins of a range in one pass, and groups up to which the ranges are broadcast to the rows.
BINS, MOST_BROADCAST = 1024, 10_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """The bin of lo <= x <= hi: lo is in the first, hi in the last, and greater values are in no lower bin.

    Halves keep the width finite; a range too narrow to be divided has two bins.
    """
    at = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)
    return F.when(at.isNull(), (x > lo).cast("long")).otherwise(F.least(F.floor(at * BINS), F.lit(BINS - 1)))


def _ranges(state: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: for every dimension the distinct ranges that still hold a rank."""
    each = state.select(*by, "dim", "lo", "hi").distinct().groupBy(*by, "dim").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    whole = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("dim", "r"))).alias("m"))
    dims = F.sequence(F.lit(0), F.array_max(F.map_keys("m")))
    return whole.select(*by, F.transform(dims, lambda d: F.try_element_at("m", d)).alias("_ranges"))


def _joined(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's ranges.  Groups are broadcast up to a counted number and joined by shuffling beyond it."""
    if not by:
        return rows.crossJoin(F.broadcast(ranges))  # one row
    own = ranges.select(*(F.col(k).alias(f"_{k}") for k in by), "_ranges")
    met = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(own[f"_{k}"]) for k in by])
    return rows.join(F.broadcast(own) if own.count() <= MOST_BROADCAST else own, met)


def exact_quantiles(rows: DataFrame, vector: str, extent: DataFrame, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., dim, quantiles): of each dimension of a vector column the quantiles, interpolated linearly, as an array.

    ``extent`` has (by..., dim, n, min, max) of the values that count: neither null nor NaN.  Every wanted rank begins with the range
    from the smallest to the largest value.  A pass cuts the ranges into BINS bins, counts the rows in each with its smallest and largest
    value, and moves each rank to the bin that holds it, until that has one value only.  Counting is aggregated before it is
    shuffled, so no task sees the values of a dimension, and no list of values is held anywhere; what is shuffled are bins.  Smooth data
    of n values take about log n / log BINS passes; in any data a range loses its smallest or its largest value at least.
    Every pass reads ``rows`` again and runs as this is called.
    """
    by = by or []
    h = lambda p: (F.col("n") - 1) * F.lit(p)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(h(p)), F.ceil(h(p))) for p in probabilities))))
    found = extent.where("n > 0")
    state = found.select(*by, "dim", F.explode(wanted).alias("rank"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(0).cast("long").alias("below"))
    done = []
    keys = [*by, "dim", "lo", "hi"]
    while True:
        state = cut(state, "ranks")
        done.append(state.where("lo >= hi"))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        wide = _joined(rows.select(*by, F.col(vector).alias("_v")), _ranges(state, by), by)
        long = wide.select(*by, "_ranges", F.posexplode("_v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
        inside = long.select(*by, "dim", "x", F.explode(F.filter(F.get("_ranges", F.col("dim")), lambda r: (F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"]))).alias("r"))
        bins = inside.where(~F.isnan("x")).select(*by, "dim", "x", "r.lo", "r.hi", _bin(F.col("x"), F.col("r.lo"), F.col("r.hi")).alias("bin"))
        bins = bins.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
        met = state.alias("s").join(bins.alias("b"), reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]))
        rest = F.col("s.rank") - F.col("s.below")
        met = met.where((F.col("b.before") <= rest) & (rest < F.col("b.before") + F.col("b.c")))
        state = met.select(*(f"s.{k}" for k in by), "s.dim", "s.rank", F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), (F.col("s.below") + F.col("b.before")).alias("below"))
    values = reduce(DataFrame.unionByName, done).groupBy(*by, "dim").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at"))
    at = lambda r: F.element_at("_at", r)
    lerp = [at(F.floor(h(p))) + (h(p) - F.floor(h(p))) * (at(F.ceil(h(p))) - at(F.floor(h(p)))) for p in probabilities]
    met = found.alias("f").join(values.alias("v"), reduce(lambda x, y: x & y, [F.col(f"f.{k}").eqNullSafe(F.col(f"v.{k}")) for k in [*by, "dim"]]))
    return met.select(*(f"f.{k}" for k in by), "f.dim", F.array(*lerp).alias("quantiles"))
