"""Episode steps: enumeration, splits, exclusions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import prefix_sum


def enumerate_steps(episodes: DataFrame) -> DataFrame:
    """One row per step of every episode (episode, length); episodes of length 0 or null give none."""
    return episodes.where("length > 0").select("episode", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("base"))


def tail_holdout(episodes: DataFrame) -> DataFrame:
    """Steps with their number in the whole table and ``is_test`` for the last ceil(n / 20) of all n steps.

    The split is over steps, so an episode may lie on both sides.
    """
    placed = prefix_sum(episodes.where("length > 0"), "episode", "length", "offset")
    total = episodes.where("length > 0").agg(F.sum("length").alias("total"))
    rows = placed.select("episode", "offset", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("base")).crossJoin(F.broadcast(total))  # one row
    number = F.col("offset") + F.col("base")
    return rows.select("episode", "base", number.alias("row_no"), (number >= F.col("total") - F.ceil(F.col("total") / 20)).alias("is_test"))


def numbered_steps(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Steps (episode, base, ...) with their number in the whole table and ``is_test`` as ``tail_holdout`` has it, by a
    join with the episodes' offsets alone."""
    placed = prefix_sum(episodes.where("length > 0"), "episode", "length", "offset").select("episode", "offset")
    total = episodes.where("length > 0").agg(F.sum("length").alias("total"))
    rows = steps.join(placed, "episode").crossJoin(F.broadcast(total))  # one row
    number = F.col("offset") + F.col("base")
    return rows.withColumn("row_no", number).withColumn("is_test", number >= F.col("total") - F.ceil(F.col("total") / 20)).drop("offset", "total")


def parse_ranges(spec: Column) -> Column:
    """Sorted distinct episode ids of a split specification such as ``"0:99, 200-299 42"``.

    Ranges are inclusive, parts are separated by commas or blanks; an end before its start is an error.
    """
    parts = F.filter(F.split(spec, r"[,\s]+"), lambda p: p != "")

    def ids(p: Column) -> Column:
        ends = F.split(p, "[:-]")
        a, b = ends[0].cast("long"), F.element_at(ends, -1).cast("long")
        return F.when(b < a, F.raise_error(F.concat(F.lit("range ends before it starts: "), p)).cast("array<bigint>")).otherwise(F.sequence(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, ids))))


def excluded_episodes(splits: DataFrame, names: list[str]) -> DataFrame:
    """Episode ids of the named splits (name, spec), names compared without case; unknown names exclude nothing."""
    wanted = [n.lower() for n in names]
    return splits.where(F.lower("name").isin(wanted)).select(F.explode(parse_ranges(F.col("spec"))).alias("episode")).distinct()


def exclude(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Steps of other episodes."""
    return steps.join(episodes.select("episode"), "episode", "left_anti")


def window_gather(steps: DataFrame, value: str, deltas: list[int], absolute: bool = True) -> DataFrame:
    """Add ``window``: the values at base + delta for each delta, padded at the episode's ends.

    Absolute values repeat the first or last step's, relative ones are 0 beyond the ends.  Offsets are in rows.
    One sort by episode serves all offsets; nothing is exploded.
    """
    order = Window.partitionBy("episode").orderBy("base")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first(value).over(whole), F.last(value).over(whole), F.count("*").over(whole)
    at = F.row_number().over(order) - 1

    def pick(d: int) -> Column:
        inside = (at + d >= 0) & (at + d < n)
        there = F.lead(value, d).over(order) if d >= 0 else F.lag(value, -d).over(order)
        return F.when(inside, there).otherwise(F.when(at + d < 0, first).otherwise(last) if absolute else F.lit(0.0))

    return steps.withColumn("window", F.array(*[pick(d) for d in deltas]))


def horizon_filters(steps: DataFrame, link: str, engaged: str, deltas: list[int]) -> DataFrame:
    """``keep``: bases whose horizon has one arm link throughout and is engaged somewhere (both tests over the sampled
    offsets that exist)."""
    order = Window.partitionBy("episode").orderBy("base")
    links = F.array(*[F.lead(link, d).over(order) for d in deltas])
    on = F.array(*[F.lead(engaged, d).over(order) for d in deltas])
    same = F.size(F.array_distinct(F.array_compact(links))) <= 1
    return steps.withColumn("same_link", same).withColumn("any_engaged", F.exists(F.array_compact(on), lambda x: x)).withColumn("keep", F.col("same_link") & F.col("any_engaged"))


def chain(steps: DataFrame, stride: int) -> DataFrame:
    """Steps of the chain base 0, stride, 2 stride, ... of each episode up to the first gap."""
    rows = steps.where(F.col("base") % stride == 0)
    k = F.row_number().over(Window.partitionBy("episode").orderBy("base")) - 1
    return rows.withColumn("_k", k).where(F.col("_k") == F.col("base") / stride).drop("_k")


def step_delta(steps: DataFrame, value: str) -> DataFrame:
    """Add ``delta``: a step's value less that of the step before; the first step of an episode has none and is left out."""
    before = F.lag(value).over(Window.partitionBy("episode").orderBy("base"))
    return steps.withColumn("delta", F.col(value) - before).where("base > 0")


def rebased(steps: DataFrame, value: str, every: int) -> DataFrame:
    """Add ``moved``: a step's value less that of the last multiple of ``every`` before it, where accumulation begins anew.

    The first step of an episode has none and is left out; a base step that is missing leaves its stretch out.
    """
    start = (every * F.floor((F.col("base") - 1) / every)).cast("long")
    bases = steps.where(F.col("base") % every == 0).select("episode", F.col("base").alias("_start"), F.col(value).alias("_from"))
    return steps.where("base > 0").withColumn("_start", start).join(bases, ["episode", "_start"]).withColumn("moved", F.col(value) - F.col("_from")).drop("_start", "_from")


def consecutive_frames(steps: DataFrame, value: str, start: int, count: int, least: int) -> DataFrame:
    """(episode, frames): ``count`` values in a row from step ``start`` on; episodes of fewer than ``least`` steps are left out.

    Only the window's rows are gathered, so an episode's length doesn't matter.
    """
    own = F.when((F.col("base") >= start) & (F.col("base") < start + count), F.struct("base", value))
    rows = steps.groupBy("episode").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(own)).alias("_own")).where(F.col("_n") >= least)
    return rows.select("episode", F.transform("_own", lambda x: x[value]).alias("frames"))


def sliding_starts(episodes: DataFrame, interval: int, length: int, ratio: int) -> DataFrame:
    """(episode, start): every ``interval``-th start whose ``length`` frames, ``ratio`` apart, lie in the episode."""
    last = F.col("length") - 1 - (length - 1) * ratio
    return episodes.where(last >= 0).select("episode", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(interval).cast("long"))).alias("start"))


def engaged_path(steps: DataFrame, value: str, engaged: str) -> DataFrame:
    """Engagement-aware sums: ``path`` adds a step's change only where it and the step before are engaged; ``held``
    keeps the last engaged value (the first step's before); ``zeroed`` is 0 while disengaged."""
    order = Window.partitionBy("episode").orderBy("base")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.when(F.col(engaged) & F.lag(engaged).over(order), F.col(value) - F.lag(value).over(order)).otherwise(F.lit(0.0))
    rows = steps.withColumn("_d", change).withColumn("_hold", F.when(F.col(engaged) | (F.col("base") == 0), F.col(value)))
    return rows.withColumn("path", F.sum("_d").over(run)).withColumn("held", F.last("_hold", ignorenulls=True).over(run)).withColumn("zeroed", F.when(F.col(engaged), F.col(value)).otherwise(F.lit(0.0))).drop("_d", "_hold")


def timestamp_check(steps: DataFrame, fps: float) -> DataFrame:
    """Per episode whether its timestamps (column ``t`` in seconds) can be trusted; else index / fps is used.

    Not trusted: a span under half of what the frames need, values like epochs, fewer than half distinct, or a mean
    spacing over ten frames' time.
    """
    need = (F.col("n") - 1) / F.lit(float(fps))
    stats = steps.groupBy("episode").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_distinct("t").alias("distinct"))
    bad = (F.col("hi") - F.col("lo") < need / 2) | (F.col("hi") > 1e8) | (F.col("distinct") < F.col("n") / 2) | ((F.col("n") > 1) & ((F.col("hi") - F.col("lo")) / (F.col("n") - 1) > 10 / float(fps)))
    return stats.withColumn("trusted", ~bad)


def nearest(left: DataFrame, right: DataFrame, bucket: float) -> DataFrame:
    """As-of join in both directions: each query (episode, q, t) with the frame (episode, frame, ft) nearest in time,
    ties to the earlier frame.

    Both sides are merged into one sorted stream per (episode), where the last frame before and the first after each
    query are running windows: linear in the rows, no pairs.  ``bucket`` bounds how far a frame may be (seconds).
    """
    q = left.select("episode", F.col("t").alias("_t"), F.lit(1).alias("_kind"), "q", F.lit(None).cast("struct<ft:double,frame:bigint>").alias("_f"))
    f = right.select("episode", F.col("ft").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("q"), F.struct(F.col("ft").cast("double").alias("ft"), F.col("frame").cast("long").alias("frame")).alias("_f"))
    both = q.unionByName(f)
    back = Window.partitionBy("episode").orderBy("_t", "_kind", F.col("_f.frame").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("episode").orderBy(F.col("_t").desc(), F.col("_kind"), F.col("_f.frame").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_a", F.last("_f", ignorenulls=True).over(back)).withColumn("_b", F.last("_f", ignorenulls=True).over(ahead)).where("_kind = 1")
    options = F.filter(F.array("_a", "_b"), lambda x: x.isNotNull())
    ranked = F.array_sort(F.transform(options, lambda x: F.struct(F.abs(x["ft"] - F.col("_t")).alias("gap"), x["frame"].alias("frame"))))
    best = F.try_element_at(ranked, F.lit(1))
    return rows.select("episode", "q", F.col("_t").alias("t"), best.alias("_best")).select("episode", "q", "t", F.when(F.col("_best.gap") <= bucket, F.col("_best.frame")).alias("frame"), F.when(F.col("_best.gap") <= bucket, F.col("_best.gap")).alias("gap"))
