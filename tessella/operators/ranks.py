"""Rows dealt to ranks and gathered again in order; workers given to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.numbering import numbered


def dealt(rows: DataFrame, world: int, *keys: str | Column) -> DataFrame:
    """Rows dealt one by one to ranks in the order of ``keys``: ``rank``, ``place`` within it and ``dummy``.

    Ranks that would have one row less than the first get a dummy, whose other columns are null, so that all have as many.  An empty
    table gives none.
    """
    own = numbered(rows, *keys).withColumn("dummy", F.lit(False))
    n = own.count()
    short = rows.sparkSession.range(n, n + -n % world).select(F.col("id").alias("position"), F.lit(True).alias("dummy"))
    every = own.unionByName(short, allowMissingColumns=True)
    return every.withColumn("rank", F.col("position") % world).withColumn("place", F.floor(F.col("position") / world)).drop("position")


def gathered(rows: DataFrame, world: int, dummy: str | None = "dummy") -> DataFrame:
    """Rows (rank, place, ...) with ``position``, their number before they were dealt; dummies are left out.

    The inverse of dealing: place * world + rank.  Without a ``dummy`` column nothing was padded, and ranks may be a row short.  What ranks
    hold is checked by counts, one row a rank: places must run from 0 without gaps, and the ranks with one row less (or
    with a dummy, which must come last) be the last ones; anything else is an error as rows are read.
    """
    real = ~F.col(dummy) if dummy else F.lit(True)
    held = rows.groupBy("rank").agg(F.count_if(real).alias("n"), F.count("*").alias("with_dummies"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), F.min("place").alias("first"), F.max(F.when(real, F.col("place"))).alias("last_real"))
    total = held.agg(F.sum("n").alias("_n"), F.bool_and((F.col("places") == F.col("with_dummies")) & (F.col("first") == 0) & (F.col("last") == F.col("places") - 1) & (F.col("with_dummies") - F.col("n") <= 1) & (F.coalesce(F.col("last_real") + 1, F.lit(0)) == F.col("n"))).alias("_whole"), F.collect_list(F.struct("rank", "n")).alias("_held"))
    due = lambda r: F.floor((F.col("_n") - r + world - 1) / world)
    fine = F.col("_whole") & F.forall("_held", lambda h: h["n"] == due(h["rank"])) & (F.aggregate("_held", F.lit(0).cast("long"), lambda a, h: a + h["n"]) == F.col("_n"))
    good = total.select("_n", fine.alias("_fine"))
    out = rows.where(real).crossJoin(F.broadcast(good))  # one row
    position = F.when(F.col("_fine"), F.col("place") * world + F.col("rank")).otherwise(F.raise_error(F.lit("ranks hold more than one dummy, gaps or rows out of turn")).cast("long"))
    return out.withColumn("position", position.cast("long")).drop("_n", "_fine", "rank", "place", *([dummy] if dummy else []))


def allocated_workers(groups: DataFrame, workers: int, by: list[str] | None = None) -> DataFrame:
    """(by..., key, n, workers): workers of each group (key, n); each has one, and the rest go one by one to the group whose share of the
    workers given so far is furthest below its share of all ``n``, ties to the first key.

    Groups of one table (of each ``by``) are few, such as aspect ratios; they are folded in one expression, nothing goes
    through the driver.  Fewer workers than groups is an error.
    """
    listed = groups.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("_g"), F.sum("n").alias("_total"))
    one = F.transform("_g", lambda g: F.lit(1).cast("long"))
    given = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def step(held: Column, _: Column) -> Column:
        lack = F.zip_with(held, "_g", lambda w, g: w / given(held) - g["n"] / F.col("_total"))
        return F.transform(F.array(F.array_position(lack, F.array_min(lack)) - 1), lambda at: F.transform(held, lambda w, i: w + (i == at).cast("long")))[0]

    rounds = F.lit(workers) - F.size("_g")
    turns = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).when(rounds == 0, F.array().cast("array<int>")).otherwise(F.raise_error(F.lit("fewer workers than groups")).cast("array<int>"))
    done = listed.withColumn("_w", F.aggregate(turns, one, step))
    return done.select(*(by or []), F.explode(F.arrays_zip("_g", "_w")).alias("z")).select(*(by or []), "z._g.key", "z._g.n", F.col("z._w").alias("workers"))
