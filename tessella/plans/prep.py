"""Queries over sample preparation and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog import STEPS, steps, table
from tessella.operators import prep as P
from tessella.operators.multiview import multiview_frames
from tessella.operators.transforms import augmented, augmentors
from tessella.registry import query


@query("j6_caption_correspondence", "(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def j6(spark, sf):
    return P.correspondence(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("j7_sk3_batch_input", """WITH a AS (SELECT n_nationkey AS k, n_name AS prompt FROM nation WHERE n_nationkey < 15), b AS (SELECT r_regionkey + 13 AS k, r_name AS prompt FROM region)
SELECT s_suppkey, '{"input":"' || s_name || '.mp4","prompt":"' || coalesce(a.prompt, b.prompt, 'none') || '"}' AS line FROM supplier LEFT JOIN a ON s_nationkey = a.k LEFT JOIN b ON s_nationkey = b.k""")
def j7(spark, sf):
    """A prompt by one name, else by another, as a line of batch input."""
    a = table(spark, sf, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("prompt"))
    b = table(spark, sf, "region").select((F.col("r_regionkey") + 13).alias("k"), F.col("r_name").alias("prompt"))
    rows = P.with_fallback(table(spark, sf, "supplier").withColumn("k", F.col("s_nationkey")), a, b, "k", "prompt", F.lit("none"))
    return rows.select("s_suppkey", F.to_json(F.struct(F.concat("s_name", F.lit(".mp4")).alias("input"), "prompt")).alias("line"))


@query("sk4_caption_rows", "SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS mode FROM documents WHERE length(text) > 0 AND length(source) > 0")
def sk4(spark, sf):
    rows = table(spark, sf, "documents").where((F.length("text") > 0) & (F.length("source") > 0))
    return rows.select("doc_id", F.when(F.col("doc_id") % 20 == 0, "val").otherwise("train").alias("mode"))


@query("sk10_incremental_export", "SELECT doc_id, least(n_chars, 512) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sk10(spark, sf):
    """Documents without output yet, cut to their true length."""
    rows = P.pending(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", F.least("n_chars", F.lit(512)).alias("n"))


@query("sk1_jsonl_rows", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def sk1(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("sk2_prompt_files", "SELECT s_suppkey, s_name || '.txt' AS file, 'a robot at ' || n_name AS prompt FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sk2(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.concat("s_name", F.lit(".txt")).alias("file"), F.concat(F.lit("a robot at "), "n_name").alias("prompt"))


@query("sc14_rollout_filter", "SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0")
def sc14(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").where((F.col("event_type") != "error") & (k % 2 == 0)).select("event_id")


@query("pf12_pf16_skip_flags", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND coalesce(n_chars % 11, 0) <> 1")
def pf12(spark, sf):
    """Samples without the skip flag and with a value left after augmentation."""
    return table(spark, sf, "documents").where(F.coalesce(F.col("n_chars") % 11, F.lit(0)) != 1).where("text IS NOT NULL").select("doc_id")


@query("pf17_window_filter", """WITH w AS (SELECT conv_id, turn, turn * 40 AS a, turn * 40 + 10 + turn * 9 AS b, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, count(*) AS windows FROM w WHERE (turn < last OR n = 1) AND (b - a) / 24.0 >= 1 AND b - a >= 25 GROUP BY 1""")
def pf17(spark, sf):
    t = F.col("turn")
    w = F.array_sort(F.collect_list(F.struct((t * 40).alias("start_frame"), (t * 40 + 10 + t * 9).alias("end_frame"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(w.alias("w"))
    return rows.select("conv_id", F.size(P.parse_windows(F.col("w"), F.lit(24.0), 1.0, 25)).cast("long").alias("windows")).where("windows > 0")


@query("pf18_field_merge", "SELECT p_partkey, CAST(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, p_size * 10) AS VARCHAR) AS size FROM part WHERE p_size % 5 <> 0")
def pf18(spark, sf):
    """Whitelisted fields of nested maps, the first winning; rows with a missing key go."""
    text = lambda c: c.cast("string")
    own = F.create_map(F.lit("size"), F.when(F.col("p_size") % 2 == 0, text(F.col("p_size"))))
    nested = F.create_map(F.lit("size"), text(F.col("p_size") * 10), F.lit("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")))
    rows = table(spark, sf, "part").select("p_partkey", P.merge_fields(own, nested, ["size", "name"]).alias("m"))
    return rows.where("m IS NOT NULL").select("p_partkey", F.col("m")["size"].alias("size"))


@query("pf19_constant_fields", "SELECT page_id, 30.0::DOUBLE AS fps, CAST(1 AS INTEGER) AS num_frames FROM pages")
def pf19(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lit(30.0).alias("fps"), F.lit(1).alias("num_frames"))


@query("pf21_depth_mask", """WITH v AS (SELECT * FROM events WHERE value > 1 AND value < 400), m AS (SELECT user_id, quantile_disc(value, 0.5) AS m FROM v GROUP BY 1)
SELECT event_id, coalesce(value > 1 AND value < 400 AND value <= 1.5 * m, false) AS valid, round(CASE WHEN value > 1 AND value < 400 AND value <= 1.5 * m THEN value ELSE 400 END, 4) AS depth FROM events LEFT JOIN m USING (user_id)""")
def pf21(spark, sf):
    rows = P.depth_validity(table(spark, sf, "events").withColumn("depth", F.col("value")), ["user_id"], 1.0, 400.0, 1.5)
    return rows.select("event_id", "valid", F.round("depth", 4).alias("depth"))


@query("pf22_view_subset", "SELECT c_nationkey, list_sum(list_slice(list_sort(list(c_custkey)), 1, 4))::BIGINT AS total FROM customer GROUP BY 1")
def pf22(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("v"))
    return rows.select("c_nationkey", F.aggregate(P.view_subset(F.col("v"), F.lit(4)), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("pf24_metadata_fallback", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 288 ELSE 480 END AS height, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 30 END AS DOUBLE) AS fps FROM part")
def pf24(spark, sf):
    """Video height and fps: named dimensions, else CHW or HWC shapes, else 288 and 30."""
    s = F.col("p_size")
    named = F.when(s % 3 == 0, s)
    shape = F.when(s % 3 == 2, F.array(F.lit(3), F.lit(480), F.lit(640)))
    by_shape = F.when(shape[0] <= 4, shape[1]).otherwise(shape[0])
    return table(spark, sf, "part").select("p_partkey", F.coalesce(named, by_shape, F.lit(288)).alias("height"), F.coalesce(F.when(s % 2 == 0, s.cast("double")), F.lit(30.0)).alias("fps"))


@query("pf27_argument_overrides", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 7 END, CASE WHEN p_size > 10 THEN p_size END, 3) AS steps FROM part")
def pf27(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.lit(7)).alias("override_steps"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("steps"))
    return P.overridden(rows, {"steps": F.lit(3)}).select("p_partkey", "steps")


@augmentors.add("long_texts")
def long_texts(rows):
    return rows.where("n_chars > 100")


@augmentors.add("two_parts")
def two_parts(rows):
    return rows.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))


@augmentors.add("parts_apart")
def parts_apart(rows):
    return rows.where("doc_id % 3 <> part")


@query("pf20_augmentor_chain", "SELECT doc_id, part FROM (SELECT doc_id, unnest([1, 2]) AS part FROM documents WHERE n_chars > 100) WHERE doc_id % 3 <> part")
def pf20(spark, sf):
    """A chain of augmentors: map, filter and one-to-many steps by DataFrame.transform."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return augmented(rows, ["long_texts", "two_parts", "parts_apart"]).select("doc_id", "part")


@query("st12_stride_plan", "SELECT p_partkey, max(s) AS stride FROM (SELECT p_partkey, 20 + p_size AS fps, 60 + p_partkey % 200 AS n, unnest(range(1, 60)) AS s FROM part) WHERE CAST(fps AS DOUBLE) / s >= 4 AND CAST(fps AS DOUBLE) / s <= 30 AND 8 * s < n GROUP BY 1")
def st12(spark, sf):
    """The largest stride that gives 9 frames at 4 to 30 fps."""
    fps, n = (F.col("p_size") + 20).cast("double"), F.col("p_partkey") % 200 + 60
    rows = table(spark, sf, "part").select("p_partkey", F.array_max(P.valid_strides(fps, n, 9, 4.0, 30.0)).cast("long").alias("stride"))
    return rows.where("stride IS NOT NULL")


@query("st13_centre_segment", "SELECT doc_id, CAST(floor((n_chars - least(4, n_chars // 61) * 61) / 2) AS BIGINT) AS start, CAST(least(4, n_chars // 61) AS INTEGER) AS step FROM documents WHERE n_chars // 61 >= 1")
def st13(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", P.centre_segment(F.col("n_chars"), 61, 4).alias("s"))
    return rows.where("s IS NOT NULL").select("doc_id", "s.start", "s.step")


@query("st20_controlled_fps", "SELECT doc_id, CAST(f AS INTEGER) AS f, CAST(floor((10 + doc_id % 20) / f) AS BIGINT) AS stride FROM (SELECT doc_id, n_chars, unnest(range(4, 25)) AS f FROM documents WHERE n_chars > 0) WHERE f >= ceil((10 + doc_id % 20) * 61.0 / n_chars) AND f <= 10 + doc_id % 20")
def st20(spark, sf):
    fps = (F.col("doc_id") % 20 + 10).cast("double")
    rows = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", F.explode(P.controlled_fps(fps, F.col("n_chars"), 61, 4, 24)).alias("c"))
    return rows.select("doc_id", "c.f", "c.stride")


@query("ma30_multiview_frames", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS views, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS prefix FROM customer GROUP BY 1")
def ma30(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    return rows.select("c_nationkey", F.size("v").cast("long").alias("views"), F.array_join("v", "|").alias("prefix"))


VIEWS = ["click", "error", "purchase", "view"]
FRAME_WINDOWS = f"""WITH {STEPS}, v AS (SELECT episode AS sample, kind AS view, min(base) AS start, max(base) - min(base) + 1 AS frames, 15 + 15 * (episode % 7 % 2) * (CASE WHEN kind = 'view' AND episode % 3 = 0 THEN 0 ELSE 1 END) AS fps, min(event_id) AS c FROM s WHERE kind IN {tuple(VIEWS)} GROUP BY ALL),
m AS (SELECT sample, count(*) AS n, min(fps) AS fps, max(fps) AS most, max(start) AS lo, min(start + frames) AS hi, list(CASE view WHEN 'click' THEN 'front:' WHEN 'error' THEN 'left:' WHEN 'purchase' THEN 'right:' ELSE 'back:' END || ' ' || c ORDER BY view) AS said FROM v GROUP BY 1),
p AS (SELECT *, CASE WHEN n < 4 THEN 'a view is missing' WHEN fps <> most THEN 'frame rates differ' WHEN lo + 3 * 2 >= hi THEN 'too few frames' END AS problem FROM m)"""


@query("ma30_view_alignment", f"""{FRAME_WINDOWS} SELECT sample, problem, CASE WHEN problem IS NULL THEN fps END AS fps, CASE WHEN problem IS NULL THEN lo || ',' || (lo + 2) || ',' || (lo + 4) || ',' || (lo + 6) END AS frames,
CASE WHEN problem IS NULL THEN array_to_string(said, '|') END AS captions FROM p""")
def ma30_alignment(spark, sf):
    """Kinds of a user's events are views of one scene: the frames that all views share, and captions with their prefixes."""
    s = steps(spark, sf).where(F.col("kind").isin(VIEWS))
    uneven = F.when((F.col("view") == "view") & (F.col("sample") % 3 == 0), 0).otherwise(1)
    v = s.groupBy(F.col("episode").alias("sample"), F.col("kind").alias("view")).agg(F.min("base").alias("start"), (F.max("base") - F.min("base") + 1).alias("frames"), F.min("event_id").cast("string").alias("caption"))
    v = v.withColumn("fps", 15 + 15 * (F.col("sample") % 7 % 2) * uneven)
    got = multiview_frames(v, VIEWS, 4, 2, dict(zip(VIEWS, ["front:", "left:", "right:", "back:"], strict=True)), merge=True)
    return got.select("sample", "problem", "fps", F.array_join(F.transform("frame_ids", lambda x: x.cast("string")), ",").alias("frames"), F.array_join("captions", "|").alias("captions"))


@query("ma31_decode_plan", "SELECT doc_id, string_agg(CAST(k * (n_chars // 9) AS VARCHAR), ',' ORDER BY k) AS frames FROM documents CROSS JOIN range(9) t(k) WHERE n_chars >= 9 GROUP BY 1")
def ma31(spark, sf):
    """Frame indices that a decoder is asked for: 9, evenly spaced."""
    plan = P.frame_plan(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 9), 9)
    return table(spark, sf, "documents").where("n_chars >= 9").select("doc_id", F.array_join(F.transform(plan, lambda x: x.cast("string")), ",").alias("frames"))
