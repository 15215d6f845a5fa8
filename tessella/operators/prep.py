"""Preparation: filters over samples, fallbacks, frame index plans, incremental export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correspondence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("side")))


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``value`` from ``first``, else ``second``, else the default; both lookups have unique keys."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b", default)).drop("_a", "_b")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def parse_windows(windows: Column, fps: Column, least_seconds: float, least_frames: int) -> Column:
    """Caption windows that are long enough; of several, the last (often cut short) is left out first."""
    kept = F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 1, F.lit(1)))
    frames = lambda w: w["end_frame"] - w["start_frame"]
    return F.filter(kept, lambda w: (frames(w) / fps >= least_seconds) & (frames(w) >= least_frames))


def valid_strides(fps: Column, n_frames: Column, target: int, low: float, high: float) -> Column:
    """Strides s with fps / s in [low, high] and target frames s apart in the video."""
    most = F.greatest(F.lit(1), F.floor((n_frames - 1) / max(1, target - 1))).cast("int")
    return F.filter(F.sequence(F.lit(1), most), lambda s: (fps / s >= low) & (fps / s <= high) & ((target - 1) * s < n_frames))


def frame_plan(start: Column, stride: Column, target: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: start + k * stride)


def controlled_fps(fps: Column, samples: Column, target: int, low: int, high: int, power: float = 0.0) -> Column:
    """(f, stride, weight) of the frame rates from max(low, ceil(fps * target / samples)) to min(high, fps)."""
    first = F.greatest(F.lit(low), F.ceil(fps * target / samples)).cast("int")
    last = F.least(F.lit(high), F.floor(fps)).cast("int")
    options = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(options, lambda f: F.struct(f.alias("f"), F.floor(fps / f).alias("stride"), F.pow(f.cast("double"), -power).alias("weight")))


def centre_segment(n_frames: Column, target: int, most: int) -> Column:
    """(start, step) of the centred segment with the largest step up to ``most`` that fits ``target`` frames."""
    step = F.least(F.lit(most), F.floor(n_frames / target)).cast("int")
    return F.when(step >= 1, F.struct(F.floor((n_frames - step * target) / 2).alias("start"), step.alias("step")))


def depth_validity(pixels: DataFrame, by: list[str], low: float, high: float, factor: float) -> DataFrame:
    """``valid``: finite depths between the limits and at most ``factor`` times the lower median of those; others are set
    to ``high``.  Two passes, the first a partial aggregate per image."""
    d = F.col("depth")
    inside = F.coalesce(~F.isnan(d) & (F.abs(d) != float("inf")) & (d > low) & (d < high), F.lit(False))
    medians = pixels.where(inside).groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY depth)").alias("_median"))
    rows = pixels.join(medians, by, "left")
    valid = inside & F.coalesce(d <= factor * F.col("_median"), F.lit(False))
    return rows.withColumn("valid", valid).withColumn("depth", F.when(valid, d).otherwise(F.lit(high))).drop("_median")


def overridden(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Argument rows: a field's override, else its value, else its default."""
    return rows.withColumns({f: F.coalesce(F.col(f"override_{f}"), F.col(f), default) for f, default in fields.items()})


def view_subset(views: Column, n: Column) -> Column:
    """The first n view ids in ascending order."""
    return F.slice(F.array_sort(views), F.lit(1), n)


def merge_fields(own: Column, nested: Column, keys: list[str]) -> Column:
    """Whitelisted keys of two maps, the first winning; null unless all are there."""
    value = lambda k: F.coalesce(own[k], nested[k])
    whole = value(keys[0]).isNotNull()
    for k in keys[1:]:
        whole = whole & value(k).isNotNull()
    return F.when(whole, F.create_map(*[x for k in keys for x in (F.lit(k), value(k))]))


def checked_range(value: Column, low: float, high: float, name: str) -> Column:
    """A number, or text that reads as one, within inclusive limits; else an error.  Null passes."""
    number = value.cast("double")
    return F.when(value.isNull() | ((number >= low) & (number <= high)), number).otherwise(F.raise_error(F.lit(f"{name} is out of range")).cast("double"))


def checked_choice(value: Column, options: list[str], name: str) -> Column:
    return F.when(value.isNull() | value.isin(options), value).otherwise(F.raise_error(F.lit(f"{name} is none of its options")).cast("string"))


def checked_multiple(value: Column, of: int, name: str) -> Column:
    return F.when(value.isNull() | (value % of == 0), value).otherwise(F.raise_error(F.lit(f"{name} is no multiple of {of}")).cast("bigint"))
