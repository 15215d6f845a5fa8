"""Mixture planning: repeat factors, locating virtual rows, interleaving, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import prefix_sum
from tessella.shared import cut

#: Datasets of a mixture that travel with every row (some 50 bytes each); more are joined by shuffling.
MOST_PARTS = 20_000


def repeat_factors(parts: DataFrame) -> DataFrame:
    """Add ``factor``, ``virtual`` size and ``share`` (percent) to one row per dataset (n, ratio).

    w = ratio / max(n, 1); factor = max(1, w / min w rounded half to even); rows with no steps count as one step.
    """
    w = F.col("ratio") / F.greatest(F.col("n"), F.lit(1))
    every = Window.partitionBy()
    rows = parts.withColumn("_w", w).withColumn("factor", F.greatest(F.lit(1), F.bround(F.col("_w") / F.min("_w").over(every))).cast("long"))
    rows = rows.withColumn("virtual", F.col("n") * F.col("factor"))
    return rows.withColumn("share", 100 * F.col("virtual") / F.sum("virtual").over(every)).drop("_w")


def locate(index: DataFrame, parts: DataFrame) -> DataFrame:
    """Dataset and row within it of each virtual index ``i``: the dataset whose range of the running sum of ``virtual``
    sizes holds i (taken modulo the whole), the row modulo its real size.

    Up to MOST_PARTS datasets (counted) travel as one sorted array in which every index is searched by halving, log2 of their
    number steps a row; more are cut at the borders of equal stretches and joined by stretch, so that an index meets the few ranges that
    begin or end in its own.  Datasets of no size hold nothing.  Jobs run as this is called.
    """
    placed = cut(prefix_sum(parts.where("virtual > 0"), "dataset", "virtual", "lo").select("dataset", "n", "virtual", "lo"), "ranges")
    size = placed.agg(F.count("*").alias("parts"), F.sum("virtual").alias("total")).first()
    at = F.pmod(F.col("i"), F.lit(size["total"]))
    found = [*index.columns, F.col("_p.dataset").alias("dataset"), F.pmod(at - F.col("_p.lo"), F.col("_p.n")).alias("row")]
    if not size["parts"]:
        return index.withColumn("_p", F.lit(None).cast("struct<lo: bigint, n: bigint, dataset: string>")).where("false").select(*found)
    one = F.struct("lo", "dataset", "n", "virtual")
    if size["parts"] <= MOST_PARTS:
        sorted_ = placed.agg(F.array_sort(F.collect_list(one)).alias("_all"))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(size["parts"].bit_length()))))
        place = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.coalesce(F.get("_all", lo + step)["lo"] <= at, F.lit(False)), lo + step).otherwise(lo))
        return index.crossJoin(F.broadcast(sorted_)).withColumn("_p", F.get("_all", place)).select(*found)
    width = -(-size["total"] // size["parts"])
    stretches = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("virtual") - 1) / width))
    ranges = placed.select(one.alias("_p"), F.explode(stretches).alias("_s"))
    met = index.withColumn("_s", F.floor(at / width)).join(ranges, "_s")
    return met.where((at >= F.col("_p.lo")) & (at < F.col("_p.lo") + F.col("_p.virtual"))).select(*found)


def interleave_slot(i: Column, ratios: list[int]) -> tuple[Column, Column]:
    """Source number and ordinal of global position i when sources take turns of ``ratios`` rows each."""
    total, at = sum(ratios), 0
    slot = F.pmod(i, F.lit(total))
    source, ordinal = F.lit(len(ratios) - 1), F.lit(0)
    for k, r in reversed(list(enumerate(ratios))):
        at = sum(ratios[:k])
        inside = (slot >= at) & (slot < at + r)
        source = F.when(inside, k).otherwise(source)
        ordinal = F.when(inside, F.floor(i / total) * r + slot - at).otherwise(ordinal)
    return source, ordinal.cast("long")


def replicate(rows: DataFrame, copies: Column, out: str = "copy") -> DataFrame:
    """``copies`` rows of each; none for 0 or less."""
    return rows.where(copies > 0).withColumn(out, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))


def expected_copies(n: float, seed: Column) -> Column:
    """floor(n) copies and one more with probability n - floor(n), by a hash."""
    unit = F.pmod(F.xxhash64(seed), F.lit(1 << 20)) / float(1 << 20)
    return F.lit(int(n)) + (unit < n - int(n)).cast("int")


def mixed_radix(i: Column, sizes: list[int]) -> list[Column]:
    """Digits of i in a mixed radix, the first varying fastest."""
    out, step = [], 1
    for n in sizes:
        out.append(F.pmod(F.floor(i / step), F.lit(n)))
        step *= n
    return out


def rank_ranges(n: int, world: int) -> list[tuple[int, int]]:
    """Contiguous [begin, end) of each rank, remainders to the first ranks; ranks beyond n get row 0."""
    base, more = divmod(n, world)
    out, at = [], 0
    for r in range(world):
        size = base + (r < more)
        out.append((at, at + size) if size else (0, min(1, n)))
        at += size
    return out
