"""Queries over vector columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog import table
from tessella.functions import vectors as V
from tessella.operators import stats as S
from tessella.registry import query

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
LONG = f"WITH {VEC}, l AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v)"
STATS = f"{LONG}, st AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM l GROUP BY dim)"


def rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def with_stats(spark, sf):
    st = S.as_struct(S.dimension_statistics(rows(spark, sf), "e"))
    return rows(spark, sf).crossJoin(F.broadcast(st))  # one row of 64 dimensions


def spread(df, col: str = "y"):
    """Long form with values rounded."""
    return df.select("vec_id", F.posexplode(col).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("ag1_dimension_statistics", f"{STATS} SELECT CAST(dim AS BIGINT) AS dim, round(mean, 6) AS mean, round(std, 6) AS std, round(mn, 6) AS min, round(mx, 6) AS max, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM st")
def ag1(spark, sf):
    st = S.dimension_statistics(rows(spark, sf), "e")
    return st.select(F.col("dim").cast("long").alias("dim"), *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "q01", "q99")])


@query("ag1_grouped_statistics", f"""{LONG} SELECT label, CAST(dim AS BIGINT) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99
FROM l GROUP BY label, dim""")
def ag1_grouped(spark, sf):
    """The same for each label."""
    st = S.dimension_statistics(rows(spark, sf), "e", ["label"])
    return st.select("label", F.col("dim").cast("long").alias("dim"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q01", "q99")])


@query("ag23_max_dimension", f"WITH {VEC} SELECT label, max(len(e)) AS dims FROM v GROUP BY 1")
def ag23(spark, sf):
    return rows(spark, sf).groupBy("label").agg(F.max(F.size("e")).cast("long").alias("dims"))


@query("ma1_vector_slice", f"{LONG} SELECT vec_id, count(*) AS n, round(sum(x), 6) AS total FROM l WHERE dim >= 7 AND dim < 21 GROUP BY 1")
def ma1(spark, sf):
    part = V.vslice(F.col("e"), 7, 21)
    return rows(spark, sf).select("vec_id", F.size(part).cast("long").alias("n"), F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("ma2_zero_pad", f"WITH {VEC} SELECT vec_id, greatest(len(e), 44) + 8 AS dims, 0.0::DOUBLE AS tail FROM v")
def ma2(spark, sf):
    p = V.pad(F.col("e"), 72)
    return rows(spark, sf).select("vec_id", F.size(p).cast("long").alias("dims"), F.get(p, F.size(p) - 1).alias("tail"))


@query("ma3_concat_split", f"WITH {VEC} SELECT vec_id, round(e[1], 6) AS a, round(e[34], 6) AS b, round(e[10], 6) AS c FROM v")
def ma3(spark, sf):
    e = F.col("e")
    joined = V.concat_checked([(V.vslice(e, 30, 40), 10), (V.vslice(e, 0, 10), 10)])
    b, a = V.split(joined, [10, 10])
    return rows(spark, sf).select("vec_id", F.round(a[0], 6).alias("a"), F.round(b[3], 6).alias("b"), F.round(a[9], 6).alias("c"))


NORMAL = {
    "min_max": "CASE WHEN mn = mx THEN 0 ELSE 2 * (x - mn) / (mx - mn) - 1 END",
    "q99": "least(greatest(CASE WHEN q01 = q99 THEN x ELSE 2 * (x - q01) / (q99 - q01) - 1 END, -1), 1)",
    "mean_std": "CASE WHEN std = 0 THEN x ELSE (x - mean) / std END",
    "scale": "CASE WHEN greatest(abs(mn), abs(mx)) = 0 THEN 0 ELSE x / greatest(abs(mn), abs(mx)) END",
    "binary": "CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END",
}
for mode, sql in NORMAL.items():

    @query(f"ma4_normalize_{mode}", f"{STATS} SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(CAST({sql} AS DOUBLE), 6) AS x FROM l JOIN st USING (dim)")
    def ma4(spark, sf, mode=mode):
        return spread(with_stats(spark, sf).select("vec_id", V.normalize(F.col("e"), F.col("stats"), mode).alias("y")))


for mode in ("min_max", "mean_std"):

    @query(f"ma4_inverse_{mode}", f"{LONG} SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x, 6) AS x FROM l")
    def ma4i(spark, sf, mode=mode):
        y = V.normalize(F.col("e"), F.col("stats"), mode)
        return spread(with_stats(spark, sf).select("vec_id", "stats", y.alias("y")).select("vec_id", V.denormalize(F.col("y"), F.col("stats"), mode).alias("y")))


@query("ma5_sin_cos", f"{LONG} SELECT vec_id, CAST(dim + k * 64 AS BIGINT) AS dim, round(CASE k WHEN 0 THEN sin(x) ELSE cos(x) END, 6) AS x FROM l CROSS JOIN (VALUES (0), (1)) t(k)")
def ma5(spark, sf):
    return spread(rows(spark, sf).select("vec_id", V.sin_cos(F.col("e")).alias("y")))


@query("ma6_ma7_noise_dropout")
def ma67(spark, sf):
    noisy = V.perturbed(V.dropped(F.col("e"), F.col("vec_id"), 0.2), F.col("vec_id"), 0.05)
    return rows(spark, sf).select("vec_id", noisy.alias("y"))


@query("ma21_dequantise", f"{LONG} SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(-1 + (least(greatest(floor((x + 1) / 2 * 256), 0), 255) + 0.5) * 2 / 256, 6) AS x FROM l")
def ma21(spark, sf):
    bins = F.transform("e", lambda x: F.least(F.greatest(F.floor((x + 1) / 2 * 256), F.lit(0)), F.lit(255)))
    return spread(rows(spark, sf).select("vec_id", V.dequantise(bins, -1.0, 1.0, 256).alias("y")))


@query("ma22_position_embedding", "SELECT vec_id, CAST(k AS BIGINT) AS dim, round(CASE WHEN k < 4 THEN sin(vec_id / pow(10000.0, k / 4.0)) ELSE cos(vec_id / pow(10000.0, (k - 4) / 4.0)) END, 6) AS x FROM embeddings CROSS JOIN range(8) t(k)")
def ma22(spark, sf):
    return spread(rows(spark, sf).select("vec_id", V.sincos_embedding(F.col("vec_id"), 8).alias("y")))


@query("ma23_pad_mask", f"WITH {VEC} SELECT vec_id, 50 AS n, CAST(least(50, label * 9) AS BIGINT) AS own FROM v")
def ma23(spark, sf):
    """Token lists cut or filled to 50 with their masks."""
    y, mask = V.resize(F.slice("e", F.lit(1), F.col("label") * 9), 50)
    return rows(spark, sf).select("vec_id", F.size(y).alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("own"))


@query("ma33_elementwise", f"WITH {VEC} SELECT a.vec_id, CAST(g.i - 1 AS BIGINT) AS dim, round((a.e[g.i] + b.e[g.i]) * a.e[g.i], 6) AS x FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 CROSS JOIN (SELECT unnest(range(1, 65)) AS i) g")
def ma33(spark, sf):
    r = rows(spark, sf)
    both = r.join(r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return spread(both.select("vec_id", V.combine(V.combine(F.col("e"), F.col("f"), "add"), F.col("e"), "mul").alias("y")))


@query("ma34_fixed_positions", f"{LONG} SELECT vec_id, CAST(list_position([0, 9, 18, 27, 34], dim) - 1 AS BIGINT) AS dim, round(x, 6) AS x FROM l WHERE dim IN (0, 9, 18, 27, 34)")
def ma34(spark, sf):
    return spread(rows(spark, sf).select("vec_id", V.picked(F.col("e"), [0, 9, 18, 27, 34]).alias("y")))


@query("ag18_trajectory_mse", f"WITH {VEC}, n AS (SELECT *, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM v) SELECT label, round(avg(d * d), 6) AS mse, count(*) AS n FROM (SELECT label, unnest(e) - unnest(f) AS d FROM n WHERE f IS NOT NULL) GROUP BY 1")
def ag18(spark, sf):
    """Mean squared difference between each vector and the next of its label."""
    from pyspark.sql import Window

    r = rows(spark, sf).withColumn("f", F.lead("e").over(Window.partitionBy("label").orderBy("vec_id"))).where("f IS NOT NULL")
    d = r.select("label", F.explode(V.combine(F.col("e"), F.col("f"), "sub")).alias("d"))
    return d.groupBy("label").agg(F.round(F.avg(F.col("d") * F.col("d")), 6).alias("mse"), F.count("*").alias("n"))


@query("j8_statistics_fallback", f"{STATS} SELECT k.name, CAST(st.dim - k.s AS BIGINT) AS dim, round(CASE WHEN k.own THEN k.s ELSE st.mean END, 6) AS mean FROM (VALUES ('eef', 0, 7, false), ('grip', 7, 8, true), ('joint', 8, 14, false)) k(name, s, e, own) JOIN st ON st.dim >= k.s AND st.dim < k.e")
def j8(spark, sf):
    """A key's own statistics, else the slice of its source vector's."""
    keys = spark.createDataFrame([("eef", 0, 7, None), ("grip", 7, 8, [7.0]), ("joint", 8, 14, None)], "name string, s int, e int, own array<double>")
    st = S.as_struct(S.dimension_statistics(rows(spark, sf), "e"))
    both = st.crossJoin(F.broadcast(keys))
    mean = F.coalesce("own", F.expr("slice(stats.mean, s + 1, e - s)"))
    return both.select("name", F.posexplode(mean).alias("dim", "mean")).select("name", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))
