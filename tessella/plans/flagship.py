"""The flagship query: enumerate, split, gather, pad, normalize, roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import STEPS, steps, table
from tessella.operators import steps as S
from tessella.registry import query

DELTAS = list(range(0, 36, 3))


@query(
    "flagship_windows",
    f"""WITH {STEPS}, n AS (SELECT *, row_number() OVER (ORDER BY episode, base) AS rn, count(*) OVER () AS total, count(*) OVER (PARTITION BY episode) AS len FROM s),
t AS (SELECT *, rn > total - ceil(total / 20.0) AS is_test FROM n), m AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM t WHERE NOT is_test),
g AS (SELECT b.kind, b.is_test, b.episode, b.base, (o.value - mean) / std AS z FROM t b CROSS JOIN m CROSS JOIN (SELECT unnest(range(0, 36, 3)) AS d) JOIN t o ON o.episode = b.episode AND o.base = least(b.base + d, b.len - 1))
SELECT kind, CASE WHEN is_test THEN 'test' ELSE 'train' END AS side, count(DISTINCT (episode, base)) AS steps, round(sum(z), 3) AS total, round(max(z), 5) AS highest FROM g GROUP BY 1, 2""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per step a window of 12 values, 3 steps apart and padded with the last; standardized by the training steps'
    statistics and summed by kind and side of the 95/5 split.

    One pass over the steps: sums and highest values by kind and side, together with the count, mean and variance of
    the steps' own values; the statistics and with them the standardized figures follow from these few rows.
    """
    rows = S.window_gather(steps(spark, sf).select("episode", "base", "kind", "value"), "value", DELTAS)
    lengths = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("length"))
    side = F.when(F.col("is_test"), "test").otherwise("train")
    window = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    parts = S.numbered_steps(rows, lengths).groupBy("kind", side.alias("side")).agg(
        F.count("*").alias("steps"), F.sum(window).alias("sum"), F.max(F.array_max("window")).alias("top"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    every, n = Window.partitionBy(), F.when(F.col("side") == "train", F.col("steps"))
    with_mean = parts.withColumn("n", n).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    spread = F.col("v") + F.pow(F.col("m") - F.col("mean"), 2)
    scored = with_mean.withColumn("std", F.sqrt(F.sum(F.col("n") * spread).over(every) / F.sum("n").over(every)))
    total = (F.col("sum") - len(DELTAS) * F.col("steps") * F.col("mean")) / F.col("std")
    return scored.select("kind", "side", "steps", F.round(total, 3).alias("total"), F.round((F.col("top") - F.col("mean")) / F.col("std"), 5).alias("highest"))
