"""Queries over episodes and steps (scans, splits, lookups, windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import STEPS, steps, table
from tessella.operators import steps as S
from tessella.registry import query

R = lambda c, n=4: F.round(c, n)
EPISODES = f"WITH {STEPS}, e AS (SELECT episode, count(*) AS length FROM s GROUP BY 1)"


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("length"))


@query("sc1_episode_scan", f"{EPISODES} SELECT episode, floor(episode / 100)::BIGINT AS chunk, printf('data/chunk-%03d/episode_%06d.parquet', floor(episode / 100)::BIGINT, episode) AS path, length, total FROM e JOIN (SELECT episode, round(sum(value), 2) AS total FROM s GROUP BY 1) USING (episode)")
def sc1(spark, sf):
    """Episodes by chunk with the path that the template gives and the sum over their steps."""
    rows = steps(spark, sf).groupBy("episode").agg(F.count("*").alias("length"), R(F.sum("value"), 2).alias("total"))
    chunk = F.floor(F.col("episode") / 100)
    return rows.select("episode", chunk.alias("chunk"), F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk, F.col("episode")).alias("path"), "length", "total")


@query("sc2_full_scan", "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def sc2(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("sc3_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sc3(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("pf1_split_ranges", "WITH n AS (SELECT user_id AS episode, count(*) AS n FROM events GROUP BY 1) SELECT episode, unnest(generate_series(0, n // 2) || generate_series(n // 2 + 2, n + 2) || [n + 4]) AS step FROM n")
def pf1(spark, sf):
    """Every episode's split specification, written from its length, as step numbers."""
    n = F.col("length")
    spec = F.format_string("0:%d, %d-%d %d", F.floor(n / 2), F.floor(n / 2) + 2, n + 2, n + 4)
    return episodes(spark, sf).select("episode", F.explode(S.parse_ranges(spec)).alias("step"))


SPLITS = (("Fail", "3-5, 9"), ("bad_frames", "0:1"), ("train", "0:1000000"))


def split_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPLITS), "name string, spec string")


@query("pf2_excluded_episodes", "SELECT DISTINCT user_id AS episode FROM events WHERE user_id IN (3, 4, 5, 9, 0, 1)")
def pf2(spark, sf):
    gone = S.excluded_episodes(split_table(spark), ["FAIL", "Bad_Frames", "unknown"])
    return episodes(spark, sf).join(gone, "episode", "left_semi").select("episode")


@query("pf3_episode_exclusion", f"{EPISODES} SELECT episode, count(*) AS n, max(base) AS last FROM s WHERE episode NOT IN (3, 4, 5, 9, 0, 1) GROUP BY 1")
def pf3(spark, sf):
    gone = S.excluded_episodes(split_table(spark), ["fail", "bad_frames"])
    return S.exclude(S.enumerate_steps(episodes(spark, sf)), gone).groupBy("episode").agg(F.count("*").alias("n"), F.max("base").alias("last"))


@query("pf4_enumerate_steps", f"WITH {STEPS} SELECT episode, base FROM s")
def pf4(spark, sf):
    return S.enumerate_steps(episodes(spark, sf)).select("episode", "base")


@query("pf5_tail_holdout", f"WITH {STEPS}, n AS (SELECT *, row_number() OVER (ORDER BY episode, base) - 1 AS row_no, count(*) OVER () AS total FROM s) SELECT episode, base, row_no, row_no >= total - ceil(total / 20.0) AS is_test FROM n")
def pf5(spark, sf):
    return S.tail_holdout(episodes(spark, sf))


@query("ag4_test_split_counts", f"""WITH {STEPS}, n AS (SELECT *, row_number() OVER (ORDER BY episode, base) AS rn, count(*) OVER () AS total FROM s)
SELECT CASE WHEN rn > total - ceil(total / 20.0) THEN 'test' ELSE 'train' END AS side, count(*) AS steps, count(DISTINCT episode) AS episodes, min(episode) AS first_episode, max(episode) AS last_episode FROM n GROUP BY 1""")
def ag4(spark, sf):
    rows = S.tail_holdout(episodes(spark, sf)).withColumn("side", F.when(F.col("is_test"), "test").otherwise("train"))
    return rows.groupBy("side").agg(F.count("*").alias("steps"), F.count_distinct("episode").alias("episodes"), F.min("episode").alias("first_episode"), F.max("episode").alias("last_episode"))


@query("sk7_test_episode_index", f"""WITH {STEPS}, n AS (SELECT *, row_number() OVER (ORDER BY episode, base) AS rn, count(*) OVER () AS total FROM s)
SELECT kind, string_agg(DISTINCT CAST(episode AS VARCHAR), ',' ORDER BY CAST(episode AS VARCHAR)) AS episodes, count(*) AS steps FROM n WHERE rn > total - ceil(total / 20.0) GROUP BY 1""")
def sk7(spark, sf):
    test = S.tail_holdout(episodes(spark, sf)).where("is_test").select("episode", "base")
    rows = steps(spark, sf).join(test, ["episode", "base"])
    return rows.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set(F.col("episode").cast("string"))), ",").alias("episodes"), F.count("*").alias("steps"))


CLUTCH = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def clutch_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with an arm link and an engagement flag derived from their properties."""
    k = F.from_json("props", "k bigint")["k"]
    return steps(spark, sf).select("episode", "base", "value", (k % 2).alias("link"), (F.col("value") > 50).alias("engaged"))


@query("pf6_pf7_clutch_rules", f"""WITH {STEPS}, c AS (SELECT episode, base, {CLUTCH} % 2 AS link, value > 50 AS engaged FROM s),
h AS (SELECT b.episode, b.base, count(DISTINCT o.link) AS links, bool_or(o.engaged) AS any_on FROM c b JOIN c o ON o.episode = b.episode AND o.base - b.base IN (0, 3, 6) GROUP BY 1, 2)
SELECT episode, base, links <= 1 AS same_link, any_on AS any_engaged, links <= 1 AND any_on AS keep FROM h""")
def pf67(spark, sf):
    return S.horizon_filters(clutch_steps(spark, sf), "link", "engaged", [0, 3, 6]).select("episode", "base", "same_link", "any_engaged", "keep")


@query("pf8_filter_cache_key", "SELECT event_type AS name, substr(md5(event_type || '_train_[0, 3, 6]'), 1, 12) AS cache_key, count(*) AS n FROM events GROUP BY 1, 2")
def pf8(spark, sf):
    key = F.substring(F.md5(F.concat("event_type", F.lit("_train_[0, 3, 6]"))), 1, 12)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), key.alias("cache_key")).agg(F.count("*").alias("n"))


@query("j1_task_lookup", "SELECT c_custkey, n_name AS task FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j1(spark, sf):
    """Step to task text; a step whose task is missing is an error."""
    tasks = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(tasks, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    task = F.when(F.col("n_name").isNull(), F.raise_error(F.lit("no such task")).cast("string")).otherwise(F.col("n_name"))
    return rows.select("c_custkey", task.alias("task"))


DELTAS = [0, 3, 6, 9]
GATHER = f"""WITH {STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM s),
g AS (SELECT b.episode, b.base, d.d, {{pick}} AS v FROM n b CROSS JOIN (VALUES (0), (3), (6), (9)) d(d) LEFT JOIN s o ON o.episode = b.episode AND o.base = {{at}})
SELECT episode, base, round(max(v) FILTER (d = 0), 4) AS v0, round(max(v) FILTER (d = 3), 4) AS v3, round(max(v) FILTER (d = 6), 4) AS v6, round(max(v) FILTER (d = 9), 4) AS v9 FROM g GROUP BY 1, 2"""


def gathered(rows: DataFrame) -> DataFrame:
    return rows.select("episode", "base", *[R(F.col("window")[k]).alias(f"v{d}") for k, d in enumerate(DELTAS)])


@query("j2_offset_gather", GATHER.format(pick="o.value", at="b.base + d.d"))
def j2(spark, sf):
    """Offset gather as a self join on exact row offsets; offsets beyond the end are null."""
    s = steps(spark, sf).select("episode", "base", "value")
    asked = s.select("episode", "base", F.explode(F.array(*map(F.lit, DELTAS))).alias("d")).withColumn("at", F.col("base") + F.col("d"))
    rows = asked.join(s.select("episode", F.col("base").alias("at"), "value"), ["episode", "at"], "left")
    return rows.groupBy("episode", "base").agg(*[R(F.max(F.when(F.col("d") == d, F.col("value")))).alias(f"v{d}") for d in DELTAS])


@query("wn1_wn2_window_absolute", GATHER.format(pick="o.value", at="least(b.base + d.d, b.n - 1)"))
def wn12(spark, sf):
    return gathered(S.window_gather(steps(spark, sf).select("episode", "base", "value"), "value", DELTAS))


@query("wn2_window_relative", GATHER.format(pick="coalesce(o.value, 0)", at="b.base + d.d"))
def wn2r(spark, sf):
    return gathered(S.window_gather(steps(spark, sf).select("episode", "base", "value"), "value", DELTAS, absolute=False))


@query("wn3_index_clamp", f"WITH {STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM s) SELECT b.episode, b.base, o.event_id AS frame FROM n b JOIN s o ON o.episode = b.episode AND o.base = least(greatest(b.base - 2, 0), b.n - 1)")
def wn3(spark, sf):
    s = steps(spark, sf).select("episode", "base", "event_id")
    n = s.withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    at = F.least(F.greatest(F.col("base") - 2, F.lit(0)), F.col("n") - 1)
    return n.select("episode", "base", at.alias("at")).join(s.select("episode", F.col("base").alias("at"), F.col("event_id").alias("frame")), ["episode", "at"]).select("episode", "base", "frame")


@query("wn4_wn6_engaged_path", f"""WITH {STEPS}, c AS (SELECT episode, base, value, value > 50 AS on_ FROM s),
d AS (SELECT *, CASE WHEN on_ AND lag(on_) OVER w THEN value - lag(value) OVER w ELSE 0 END AS dv, CASE WHEN on_ OR base = 0 THEN base END AS hb FROM c WINDOW w AS (PARTITION BY episode ORDER BY base)),
p AS (SELECT *, sum(dv) OVER w AS path, max(hb) OVER w AS hold FROM d WINDOW w AS (PARTITION BY episode ORDER BY base ROWS UNBOUNDED PRECEDING))
SELECT p.episode, p.base, round(path, 4) + 0 AS path, round(h.value, 4) AS held, round(CASE WHEN p.on_ THEN p.value ELSE 0 END, 4) AS zeroed FROM p JOIN s h ON h.episode = p.episode AND h.base = p.hold""")
def wn456(spark, sf):
    rows = S.engaged_path(clutch_steps(spark, sf), "value", "engaged")
    return rows.select("episode", "base", (R(F.col("path")) + 0.0).alias("path"), R(F.col("held")).alias("held"), R(F.col("zeroed")).alias("zeroed"))


@query("wn7_step_delta", f"WITH {STEPS} SELECT episode, base, round(value - lag(value) OVER (PARTITION BY episode ORDER BY base), 4) AS delta FROM s QUALIFY base > 0")
def wn7(spark, sf):
    return S.step_delta(steps(spark, sf), "value").select("episode", "base", R(F.col("delta")).alias("delta"))


@query("wn8_rebased", f"WITH {STEPS} SELECT a.episode, a.base, round(a.value - b.value, 4) AS moved FROM s a JOIN s b ON b.episode = a.episode AND b.base = 4 * CAST(floor((a.base - 1) / 4) AS BIGINT) WHERE a.base > 0")
def wn8(spark, sf):
    """Change since the base, which is set anew every four steps."""
    return S.rebased(steps(spark, sf).select("episode", "base", "value"), "value", 4).select("episode", "base", R(F.col("moved")).alias("moved"))


@query("wn9_sliding_starts", f"{EPISODES} SELECT e.episode, b.base AS start FROM e JOIN s b USING (episode) WHERE b.base % 4 = 0 AND b.base + 5 * 3 < length")
def wn9(spark, sf):
    return S.sliding_starts(episodes(spark, sf), 4, 6, 3)


@query("wn14_row_identity", f"WITH {STEPS} SELECT event_id, row_number() OVER (ORDER BY episode, base) AS row_id FROM s")
def wn14(spark, sf):
    """The number of each row in file and frame order, from prefix sums over episodes."""
    placed = S.prefix_sum(episodes(spark, sf), "episode", "length", "offset")
    return steps(spark, sf).join(placed, "episode").select("event_id", (F.col("offset") + F.col("base") + 1).alias("row_id"))


@query("j9_requested_episodes", f"WITH {STEPS} SELECT episode, count(*) AS n FROM s WHERE episode IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def j9(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("episode"))
    return steps(spark, sf).join(wanted, "episode", "left_semi").groupBy("episode").agg(F.count("*").alias("n"))


@query("j13_chunk_chain", f"""WITH {STEPS}, g AS (SELECT episode, base, row_number() OVER (PARTITION BY episode ORDER BY base) - 1 AS k FROM s WHERE base % 12 = 0 AND kind <> 'error')
SELECT episode, count(*) AS chunks, max(base) AS last FROM g WHERE k * 12 = base GROUP BY 1""")
def j13(spark, sf):
    rows = S.chain(steps(spark, sf).where("kind <> 'error'"), 12)
    return rows.groupBy("episode").agg(F.count("*").alias("chunks"), F.max("base").alias("last"))


@query("ag5_episode_index_map", f"WITH {STEPS} SELECT episode, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY base) AS ids FROM s GROUP BY 1")
def ag5(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("base", "event_id")))
    return steps(spark, sf).groupBy("episode").agg(F.array_join(F.transform(ordered, lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("pf23_timestamp_check", f"""WITH {STEPS}, t AS (SELECT episode, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY episode) AS t FROM s),
a AS (SELECT episode, count(*) AS n, max(t) - min(t) AS span, max(t) AS hi, count(DISTINCT t) AS distinct_t FROM t GROUP BY 1)
SELECT episode, n, NOT (span < (n - 1) / 0.0001 / 2 OR hi > 1e8 OR distinct_t < n / 2.0 OR (n > 1 AND span / (n - 1) > 10 / 0.0001)) AS trusted FROM a""")
def pf23(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = steps(spark, sf).select("episode", (t - F.min(t).over(Window.partitionBy("episode"))).alias("t"))
    return S.timestamp_check(rows, 0.0001).select("episode", "n", "trusted")


@query("j3_nearest_frame", f"""WITH {STEPS}, t AS (SELECT episode, base, epoch(ts) AS t, kind FROM s),
q AS (SELECT episode, base, t FROM t WHERE kind = 'click'), f AS (SELECT episode, base AS frame, t AS ft FROM t WHERE kind <> 'click'),
r AS (SELECT q.episode, q.base, frame, row_number() OVER (PARTITION BY q.episode, q.base ORDER BY abs(ft - t), frame) AS rn FROM q JOIN f ON q.episode = f.episode)
SELECT episode, base, frame FROM r WHERE rn = 1""")
def j3(spark, sf):
    """For every click the frame nearest in time, earlier or later."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    s = steps(spark, sf).select("episode", "base", t, "kind")
    q = s.where("kind = 'click'").select("episode", F.col("base").alias("q"), "t")
    f = s.where("kind <> 'click'").select("episode", F.col("base").alias("frame"), F.col("t").alias("ft"))
    return S.nearest(q, f, float("inf")).where("frame IS NOT NULL").select("episode", F.col("q").alias("base"), "frame")
