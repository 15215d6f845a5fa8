"""Queries over evaluation records and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import STEPS, steps, table
from tessella.operators import evaluation as E
from tessella.operators import telemetry as M
from tessella.registry import query

R = lambda c, n=4: F.round(c, n)

#: Frames: each order's line items, rank in a total order as time, |quantity / 50 - discount| as the metric.
FRAMES = """f AS (SELECT l_orderkey AS episode, l_suppkey % 5 AS dataset, l_returnflag AS checkpoint, abs(l_quantity / 50 - l_discount) AS l1, l_quantity / 50 AS gt, l_discount AS gen,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS t FROM lineitem)"""


def frames(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"),
        (F.col("l_suppkey") % 5).alias("dataset"),
        F.col("l_returnflag").alias("checkpoint"),
        F.abs(F.col("l_quantity") / 50 - F.col("l_discount")).alias("l1"),
        (F.col("l_quantity") / 50).alias("gt"),
        F.col("l_discount").alias("gen"),
        (F.row_number().over(order) - 1).cast("long").alias("t"),
    )


@query("ag6_frame_decay", f"""WITH {FRAMES} SELECT episode, count(*) AS n, round(avg(l1), 7) AS mean_l1, round(stddev_pop(l1), 7) AS std_l1, round(CASE WHEN count(*) > 1 THEN regr_slope(l1, t) END, 7) AS slope,
round(avg(l1) FILTER (t <= 1), 7) AS early, round(avg(l1) FILTER (t > 1 AND t <= 2), 7) AS middle, round(avg(l1) FILTER (t > 2), 7) AS late FROM f WHERE t > 0 GROUP BY 1""")
def ag6(spark, sf):
    rows = E.frame_decay(frames(spark, sf), ["episode"], 1, 2)
    return rows.select("episode", "n", *[R(E.no_nan(F.col(c)), 7).alias(c) for c in ("mean_l1", "std_l1", "slope", "early", "middle", "late")])


@query("ag7_frame_ssim")
def ag7(spark, sf):
    """SSIM of each embedding as an 8 x 8 image against the next of its label."""
    r = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.lead(F.col("embedding").cast("array<double>")).over(Window.partitionBy("label").orderBy("vec_id")).alias("b"))
    return r.where("b IS NOT NULL").select("vec_id", E.frame_ssim(8)("a", "b").alias("ssim"))


VALID = "CASE WHEN value < 20 THEN NULL ELSE value END"


@query("ag8_ag11_median_coverage", f"SELECT event_type, round(median({VALID}), 4) AS score, round(100.0 * avg(CASE WHEN value < 20 THEN 0.0 ELSE 1.0 END), 4) AS coverage FROM events GROUP BY 1")
def ag8(spark, sf):
    """Median of valid scores; low values stand for NaN (not computed)."""
    rows = table(spark, sf, "events").withColumn("v", F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value")))
    score, coverage = E.score_and_coverage(F.col("v"))
    return rows.groupBy("event_type").agg(R(score).alias("score"), R(coverage).alias("coverage"))


@query("ag9_confidence_interval", "SELECT user_id, round(avg(value) - coalesce(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(*)) END, 0), 4) AS low, round(avg(value) + coalesce(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(*)) END, 0), 4) AS high FROM events GROUP BY 1")
def ag9(spark, sf):
    low, high = E.ci95(F.col("value"))
    return table(spark, sf, "events").groupBy("user_id").agg(R(low).alias("low"), R(high).alias("high"))


EPISODES = f"{FRAMES}, e AS (SELECT checkpoint, dataset, episode, avg(l1) AS l1, CASE WHEN count(*) > 1 THEN avg(gt) END AS gatc FROM f GROUP BY 1, 2, 3)"


@query("ag10_checkpoint_summary", f"""WITH {EPISODES} SELECT checkpoint, dataset, count(l1) AS l1_n, round(avg(l1), 4) AS l1_mean, round(stddev_pop(l1), 4) AS l1_std,
round(avg(l1) - coalesce(1.96 * CASE WHEN count(l1) > 1 THEN stddev_samp(l1) END / sqrt(count(l1)), 0), 4) AS l1_low, count(gatc) AS gatc_n, round(avg(gatc), 4) AS gatc_mean FROM e GROUP BY GROUPING SETS ((checkpoint), (checkpoint, dataset))""")
def ag10(spark, sf):
    f = frames(spark, sf).groupBy("checkpoint", "dataset", "episode").agg(F.avg("l1").alias("l1"), F.coalesce(F.when(F.count("*") > 1, F.avg("gt")), F.lit(float("nan"))).alias("gatc"))
    rows = E.checkpoint_summary(f, ["l1", "gatc"])
    return rows.select("checkpoint", "dataset", "l1_n", *[R(F.col(c)).alias(c) for c in ("l1_mean", "l1_std", "l1_low")], "gatc_n", R(F.col("gatc_mean")).alias("gatc_mean"))


@query("sk5_results_json", f"WITH {EPISODES} SELECT checkpoint, '{{\"episodes\":' || count(*) || ',\"datasets\":' || count(DISTINCT dataset) || '}}' AS result FROM e GROUP BY 1")
def sk5(spark, sf):
    """Checkpoint results as JSON, per-frame arrays and private keys left out."""
    rows = frames(spark, sf).groupBy("checkpoint").agg(F.count_distinct("dataset", "episode").alias("episodes"), F.count_distinct("dataset").alias("datasets"), F.lit(0).alias("_private"))
    keep = [c for c in rows.columns if not c.startswith("_") and c != "checkpoint"]
    return rows.select("checkpoint", F.to_json(F.struct(*keep)).alias("result"))


@query("j10_frame_pairing", f"WITH {FRAMES} SELECT a.episode, count(*) AS n, round(avg(abs(a.gt - b.gen)), 7) AS l1 FROM f a JOIN f b ON a.episode = b.episode + 1 AND a.t = b.t GROUP BY 1")
def j10(spark, sf):
    """Ground truth and generated frames paired by time, cut to the shorter."""
    f = frames(spark, sf)
    b = f.select((F.col("episode") + 1).alias("episode"), "t", F.col("gen").alias("other"))
    rows = f.join(b, ["episode", "t"])
    return rows.groupBy("episode").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("gt") - F.col("other"))), 7).alias("l1"))


@query("ma28_zncc", f"WITH {FRAMES} SELECT checkpoint, dataset, round(covar_pop(gt, gen) / (stddev_pop(gt) * stddev_pop(gen) + 1e-8), 4) + 0 AS zncc FROM f GROUP BY 1, 2")
def ma28(spark, sf):
    return E.zncc(frames(spark, sf), ["checkpoint", "dataset"], "gt", "gen").select("checkpoint", "dataset", (R(F.col("zncc")) + 0.0).alias("zncc"))


@query("ma29_mask_centroid", "SELECT label, round(avg((vec_id % 40)), 4) AS x, round(avg(vec_id // 40), 4) AS y, count(*) AS area FROM embeddings WHERE embedding[1] > 0 GROUP BY 1 HAVING count(*) >= 5")
def ma29(spark, sf):
    """Centroids of masks with at least 5 pixels."""
    px = table(spark, sf, "embeddings").where(F.col("embedding")[0] > 0)
    rows = px.groupBy("label").agg(R(F.avg(F.col("vec_id") % 40)).alias("x"), R(F.avg(F.floor(F.col("vec_id") / 40))).alias("y"), F.count("*").alias("area"))
    return rows.where("area >= 5")


@query("j11_centroid_matching")
def j11(spark, sf):
    """Mean distance of optimally matched points per label."""
    e = F.col("embedding")
    points = table(spark, sf, "embeddings").select("label", F.floor(F.col("vec_id") / 100).alias("frame"), (F.col("vec_id") % 2).alias("side"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    return E.centroid_distance(points, ["label", "frame"], 1.0)


@query("wn13_chunk_stitch", f"WITH {STEPS}, c AS (SELECT episode, base, base // 13 AS chunk, base % 13 AS t FROM s) SELECT episode, base, row_number() OVER (PARTITION BY episode ORDER BY chunk, t) - 1 AS frame FROM c WHERE chunk = 0 OR t > 0")
def wn13(spark, sf):
    rows = steps(spark, sf).select("episode", "base", F.floor(F.col("base") / 13).alias("chunk"), (F.col("base") % 13).alias("t"))
    return E.stitched(rows).select("episode", "base", F.col("frame").cast("long").alias("frame"))


@query("ag19_inference_fps", "SELECT user_id, round(count(*) / sum(value / 1000), 4) AS fps, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS chunks FROM events GROUP BY 1 HAVING sum(value) > 0")
def ag19(spark, sf):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value") / 1000).alias("s"), ids.alias("chunks")).where("s > 0")
    return rows.select("user_id", R(F.col("n") / F.col("s")).alias("fps"), "chunks")


METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ag13_rank_telemetry", " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 4) AS avg, round(max({m}), 4) AS max, round(min({m}), 4) AS min FROM (SELECT l_suppkey, avg({m}) AS {m} FROM lineitem GROUP BY 1)" for m in METRICS))
def ag13(spark, sf):
    """Each supplier is a rank: average, maximum and minimum over ranks of every metric."""
    ranks = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.avg(m).alias(m) for m in METRICS])
    return M.metric_summary(M.long_metrics(ranks, ["l_suppkey"], METRICS)).select("metric", *[R(F.col(c)).alias(c) for c in ("avg", "max", "min")])


@query("sc22_transpose", " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS metric, round(sum({m}), 2) AS total FROM lineitem GROUP BY 1" for m in METRICS))
def sc22(spark, sf):
    long = M.long_metrics(table(spark, sf, "lineitem"), ["l_returnflag"], METRICS)
    return long.groupBy("l_returnflag", "metric").agg(R(F.sum("value"), 2).alias("total"))


@query("ag14_slowest_rank", "WITH m AS (SELECT l_returnflag, l_suppkey, round(avg(l_tax), 9) AS m FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m DESC, l_suppkey) AS rn FROM m) SELECT l_returnflag, l_suppkey AS rank, round(m, 6) AS mean FROM r WHERE rn = 1")
def ag14(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_tax"), 9).alias("m"))
    return M.slowest_rank(rows, ["l_returnflag"], "l_suppkey", "m").select("l_returnflag", "rank", R(F.col("mean"), 6).alias("mean"))


@query("ag15_operation_timing", "SELECT event_type AS op, count(*) AS n, round(sum(value), 2) AS total, round(max(value), 4) AS longest, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def ag15(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("total"), R(F.max("value")).alias("longest"), R(F.avg("value")).alias("mean"))


EDGES = [round(x, 6) for x in M.normal_bins(10, 3.5, 1.0)]


@query("ag16_binned_loss", "SELECT bin, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (SELECT value, CASE " + " ".join(f"WHEN value >= {EDGES[k]} AND value {'<=' if k == 9 else '<'} {EDGES[k + 1]} THEN {k}" for k in range(10)) + " END AS bin FROM events) GROUP BY 1")
def ag16(spark, sf):
    return table(spark, sf, "events").groupBy(M.bin_of(F.col("value"), EDGES).alias("bin")).agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"), R(F.stddev_pop("value")).alias("std"))


@query("ag17_loss_by_kind", "SELECT event_type, round(coalesce(avg(m), 0), 4) AS loss, CAST(sum(bad) AS BIGINT) AS bad FROM (SELECT event_type, user_id % 8 AS r, avg(value) FILTER (value < 90) AS m, count(*) FILTER (value >= 90) AS bad FROM events GROUP BY 1, 2) GROUP BY 1")
def ag17(spark, sf):
    """Mean over ranks of each rank's mean; large values stand for infinite losses."""
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 8).alias("r"), F.when(F.col("value") >= 90, F.lit(float("inf"))).otherwise(F.col("value")).alias("loss"))
    return M.mean_of_rank_means(rows, ["event_type"], "r", "loss").select("event_type", R(F.col("loss")).alias("loss"), "bad")


@query("ag22_pointcloud_rescale", "WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), m AS (SELECT label, avg(sqrt(x * x + y * y + z * z)) AS d FROM p GROUP BY 1) SELECT vec_id, round(x / d, 5) AS x, round(y / d, 5) AS y, round(z / d, 5) AS z FROM p JOIN m USING (label)")
def ag22(spark, sf):
    """Points scaled to a mean distance of 1 in each cloud."""
    e = F.col("embedding")
    p = table(spark, sf, "embeddings").select("label", "vec_id", *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    d = p.groupBy("label").agg(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("d"))
    return p.join(d, "label").select("vec_id", *[F.round(F.col(c) / F.col("d"), 5).alias(c) for c in "xyz"])


@query("ag24_running_counters", f"WITH {STEPS} SELECT episode, base, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER w::BIGINT AS clicks, round(sum(value) OVER w / 3600, 7) AS hours FROM s WINDOW w AS (PARTITION BY episode ORDER BY base ROWS UNBOUNDED PRECEDING)")
def ag24(spark, sf):
    w = Window.partitionBy("episode").orderBy("base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps(spark, sf).select("episode", "base", F.sum((F.col("kind") == "click").cast("long")).over(w).alias("clicks"), R(F.sum("value").over(w) / 3600, 7).alias("hours"))


@query("ag25_seconds_per_iteration", f"WITH {STEPS} SELECT episode, base, round((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY episode ORDER BY base)) / 5, 3) AS seconds FROM s QUALIFY base > 0")
def ag25(spark, sf):
    rows = steps(spark, sf).select("episode", "base", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return M.seconds_per_iteration(rows, ["episode"], "t", 5).where("base > 0").select("episode", "base", R(F.col("seconds"), 3).alias("seconds"))


@query("ss5_every_n", f"WITH {STEPS} SELECT episode, base FROM s WHERE base % 10 = 0")
def ss5(spark, sf):
    return steps(spark, sf).where("base % 10 = 0").select("episode", "base")


@query("ss3_chunk_plan", "SELECT user_id AS episode, count(*) // 12 AS chunks, count(*) % 12 AS dropped FROM events GROUP BY 1")
def ss3(spark, sf):
    """Chunks of 12 actions; a remainder is dropped."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("n"))
    return rows.select("episode", F.floor(F.col("n") / 12).alias("chunks"), (F.col("n") % 12).alias("dropped"))


@query("j15_gather_order", "SELECT o_custkey AS pos, min(o_orderkey % 4) AS rank, count(*) AS n FROM orders GROUP BY 1")
def j15(spark, sf):
    """Rows gathered from ranks in their original order; no padding rows are needed."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pos")).agg(F.min(F.col("o_orderkey") % 4).alias("rank"), F.count("*").alias("n"))
