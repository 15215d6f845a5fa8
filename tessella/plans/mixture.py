"""Queries over mixtures, shards and sample alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import STEPS, steps, table
from tessella.operators import mixture as M
from tessella.operators import shards as H
from tessella.operators import ranks
from tessella.operators import steps as S
from tessella.operators.numbering import numbered
from tessella.registry import query

PARTS_SQL = """p AS (SELECT source AS dataset, count(*) AS n, CASE WHEN source LIKE '%1' THEN 3.0 WHEN source LIKE '%2' THEN 0.5 ELSE 1.0 END AS ratio FROM documents GROUP BY 1, 3),
w AS (SELECT *, ratio / greatest(n, 1) AS w FROM p),
m AS (SELECT dataset, n, ratio, CAST(greatest(1, round_even(w / min(w) OVER (), 0)) AS BIGINT) AS factor FROM w),
v AS (SELECT *, n * factor AS virtual, 100.0 * n * factor / sum(n * factor) OVER () AS share FROM m)"""


def parts(spark, sf):
    ratio = F.when(F.col("source").like("%1"), 3.0).when(F.col("source").like("%2"), 0.5).otherwise(1.0)
    return table(spark, sf, "documents").groupBy(F.col("source").alias("dataset"), ratio.alias("ratio")).agg(F.count("*").alias("n"))


@query("ag2_repeat_factors", f"WITH {PARTS_SQL} SELECT dataset, n, factor, CAST(virtual AS BIGINT) AS virtual, round(share, 4) AS share FROM v")
def ag2(spark, sf):
    return M.repeat_factors(parts(spark, sf)).select("dataset", "n", "factor", "virtual", F.round("share", 4).alias("share"))


@query("ag3_mixture_summary", f"WITH {PARTS_SQL} SELECT coalesce(CAST(ratio AS VARCHAR), 'all') AS kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(virtual) AS BIGINT) AS virtual FROM v GROUP BY ROLLUP (ratio)")
def ag3(spark, sf):
    rows = M.repeat_factors(parts(spark, sf))
    return rows.rollup("ratio").agg(F.sum("n").alias("n"), F.sum("virtual").alias("virtual")).select(F.coalesce(F.col("ratio").cast("string"), F.lit("all")).alias("kind"), "n", "virtual")


@query("wn10_locate_row", f"WITH {PARTS_SQL}, c AS (SELECT *, sum(virtual) OVER (ORDER BY dataset) AS hi, sum(virtual) OVER () AS total FROM v) SELECT event_id, dataset, CAST((event_id * 37 % total - (hi - virtual)) % n AS BIGINT) AS row FROM events JOIN c ON event_id * 37 % total >= hi - virtual AND event_id * 37 % total < hi")
def wn10(spark, sf):
    index = table(spark, sf, "events").select("event_id", (F.col("event_id") * 37).alias("i"))
    return M.locate(index, M.repeat_factors(parts(spark, sf))).select("event_id", "dataset", "row")


@query("st9_ratio_interleave", "SELECT event_id, CAST(CASE WHEN event_id % 6 < 3 THEN 0 WHEN event_id % 6 < 4 THEN 1 ELSE 2 END AS INTEGER) AS source, CAST(CASE WHEN event_id % 6 < 3 THEN event_id // 6 * 3 + event_id % 6 WHEN event_id % 6 < 4 THEN event_id // 6 ELSE event_id // 6 * 2 + event_id % 6 - 4 END AS BIGINT) AS ordinal FROM events")
def st9(spark, sf):
    source, ordinal = M.interleave_slot(F.col("event_id"), [3, 1, 2])
    return table(spark, sf, "events").select("event_id", source.alias("source"), ordinal.alias("ordinal"))


@query("st14_replication", "SELECT p_partkey, CAST(k AS INTEGER) AS copy FROM part CROSS JOIN range(7) t(k) WHERE k < p_size % 7")
def st14(spark, sf):
    return M.replicate(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_size") % 7).select("p_partkey", "copy")


@query("st14_expected_replication")
def st14e(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey")
    return M.replicate(rows, M.expected_copies(2.4, F.col("p_partkey")))


@query("st15_batch_concat", "SELECT event_type, g AS batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4 AS g FROM events) GROUP BY 1, 2")
def st15(spark, sf):
    """Output batch i of each stream merges inputs j * 4 + i."""
    rows = H.batch_concat(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 4, "event_id")
    return rows.select("event_type", "batch", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("st19_mixed_radix", "SELECT event_id, event_id % 5 AS file, event_id // 5 % 3 AS aug, event_id // 15 % 4 AS sigma FROM events")
def st19(spark, sf):
    a, b, c = M.mixed_radix(F.col("event_id"), [5, 3, 4])
    return table(spark, sf, "events").select("event_id", a.alias("file"), b.alias("aug"), c.alias("sigma"))


@query("st7_rank_split", "WITH n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT k AS rank, n // 7 AS b, n % 7 AS m, n FROM n CROSS JOIN range(7) t(k)) SELECT rank, rank * b + least(rank, m) AS first, (rank + 1) * b + least(rank + 1, m) AS beyond FROM r")
def st7(spark, sf):
    """Even contiguous ranges of the rows for seven ranks, remainders to the first."""
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    rows = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("rank"))
    edge = lambda r: r * F.floor(F.col("n") / 7) + F.least(r, F.col("n") % 7)
    return rows.select("rank", edge(F.col("rank")).alias("first"), edge(F.col("rank") + 1).alias("beyond"))


@query("st17_consecutive_frames", f"WITH {STEPS} SELECT episode, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY base) AS frames FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM s) WHERE n >= 60 AND base >= 2 AND base < 10 GROUP BY 1")
def st17(spark, sf):
    rows = S.consecutive_frames(steps(spark, sf), "event_id", 2, 8, 60)
    return rows.select("episode", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("st18_frame_thinning", f"WITH {STEPS} SELECT episode, base FROM s WHERE base % 15 = 0")
def st18(spark, sf):
    return steps(spark, sf).where("base % 15 = 0").select("episode", "base")


MANIFEST_SQL = "p AS (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), u AS (SELECT page_id, regexp_replace('s3://bucket/' || host, '^[a-z0-9]+://[^/]+/?', '') AS root, host AS dataset FROM p)"


def manifests(spark, sf):
    """Manifests of the hosts of ``pages``: their shards are the pages, at most 100 in one manifest, so that a host of any
    size has many manifests and no row that grows with it."""
    host = F.split(F.split("url", "://")[1], "/")[0]
    shard = F.format_string("%06d.tar", "page_id")
    keys = F.array(F.lit("metas"), F.lit("videos"))
    return table(spark, sf, "pages").groupBy(host.alias("dataset"), F.floor(F.col("page_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(shard)).alias("data_list")).withColumn("root", F.concat(F.lit("s3://bucket/"), "dataset")).withColumn("data_keys", keys).withColumn("chunk_size", F.lit(100))


@query("sc6_manifest_parse", f"WITH {MANIFEST_SQL} SELECT dataset, root || '/' || k || '/' || printf('%06d.tar', page_id) AS path FROM u CROSS JOIN (VALUES ('metas'), ('videos')) t(k)")
def sc6(spark, sf):
    return H.manifest_rows(manifests(spark, sf)).select("dataset", "path")


@query("sc7_camera_manifest", f"WITH {MANIFEST_SQL} SELECT dataset, root || '/' || k || '/' || printf('%06d.tar', page_id) AS path FROM u CROSS JOIN (VALUES ('metas'), ('videos/left'), ('videos/right')) t(k)")
def sc7(spark, sf):
    return H.manifest_rows(manifests(spark, sf), ["left", "right"]).select("dataset", "path")


@query("sc9_key_index", "SELECT split_part(p_name || '.tar', '.', 1) AS key, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part")
def sc9(spark, sf):
    rows = numbered(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return rows.select(F.split(F.concat("p_name", F.lit(".tar")), r"\.")[0].alias("key"), "position")


@query("wn14_text_numbering", "SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS key, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) - 1 AS position FROM events")
def wn14_text(spark, sf):
    """Dense numbers for events in the order of random text keys."""
    return numbered(table(spark, sf, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("key")), "key")


@query("wn14_grouped_numbering", "SELECT doc_id, source, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS position FROM documents")
def wn14_grouped(spark, sf):
    """Dense numbers for documents by source: few keys, one of which may hold most rows."""
    return numbered(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("sc18_item_files", "SELECT printf('%06d.pkl', 100 + s_suppkey) AS file FROM supplier WHERE s_suppkey >= 0 AND s_suppkey < 1000000")
def sc18(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey >= 0 AND s_suppkey < 1000000").select(F.format_string("%06d.pkl", F.col("s_suppkey") + 100).alias("file"))


@query("sc20_positional_zip", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) SELECT s_suppkey, c_custkey FROM a JOIN b USING (i)")
def sc20(spark, sf):
    a, b = table(spark, sf, "supplier").select("s_suppkey"), table(spark, sf, "customer").select("c_custkey")
    return H.zip_shortest(a, b, "s_suppkey", "c_custkey").select("s_suppkey", "c_custkey")


@query("st1_sorted_shards", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS place FROM pages QUALIFY place <= 50")
def st1_st2(spark, sf):
    """The first 50 shards by path: a top-k, so no total sort."""
    top = table(spark, sf, "pages").select("url", "page_id").orderBy("url", "page_id").limit(50)
    return top.select("page_id", F.row_number().over(Window.orderBy("url", "page_id")).cast("long").alias("place"))


@query("st3_st5_strided_assignment", """WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), k AS (SELECT s_suppkey, i - 3 AS i, count(*) OVER () AS c FROM n WHERE i >= 3),
z AS (SELECT s_suppkey, i + j * c AS slot FROM k CROSS JOIN range(50) t(j) WHERE i + j * c < ceil(c / 12.0) * 12) SELECT s_suppkey, CAST(slot % 4 AS BIGINT) AS rank, CAST(slot // 4 % 3 AS BIGINT) AS worker FROM z""")
def st3(spark, sf):
    return H.assign_strided(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 4, 3, start=3).select("s_suppkey", F.col("rank").cast("long").alias("rank"), F.col("worker").cast("long").alias("worker"))


@query("ag21_worker_equalization", """WITH g AS (SELECT lang AS aspect, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT *, CAST(ceil(n / sum(n) OVER () * 16) AS BIGINT) AS c, row_number() OVER (ORDER BY n DESC, aspect) = 1 AS big FROM g),
w AS (SELECT aspect, n, CASE WHEN big THEN 16 - (sum(c) OVER () - c) ELSE c END AS workers FROM c) SELECT aspect, n, CAST(workers AS BIGINT) AS workers, CAST(ceil(n / greatest(workers, 1)) AS BIGINT) AS per_worker FROM w""")
def ag21(spark, sf):
    return H.equalised_workers(table(spark, sf, "documents").groupBy(F.col("lang").alias("aspect")).agg(F.count("*").alias("n")), 16)


@query("ag20_worker_allocation", """WITH RECURSIVE g AS (SELECT source, list(lang ORDER BY lang) AS k, list(n ORDER BY lang) AS n, sum(n) AS total FROM (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1),
r(source, k, n, total, w) AS (SELECT *, list_transform(k, lambda x: 1::BIGINT) FROM g UNION ALL SELECT source, k, n, total, list_transform(range(1, len(w) + 1), lambda i: w[i] + CASE WHEN i = list_position(lack, list_min(lack)) THEN 1 ELSE 0 END)
  FROM (SELECT *, list_transform(range(1, len(w) + 1), lambda i: w[i] / list_sum(w)::DOUBLE - n[i] / total::DOUBLE) AS lack FROM r WHERE list_sum(w) < 24))
SELECT source, unnest(k) AS lang, unnest(n) AS n, unnest(w) AS workers FROM r WHERE list_sum(w) = 24""")
def ag20(spark, sf):
    """24 workers of each source given to its languages, one at a time where the share lacks most."""
    groups = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    return ranks.allocated_workers(groups, 24, ["source"]).select("source", F.col("key").alias("lang"), "n", "workers")


@query("j15_order_restored", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents")
def j15(spark, sf):
    """Documents dealt to seven ranks with dummies, and gathered in the order before."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return ranks.gathered(ranks.dealt(rows, 7, "n_chars", "doc_id"), 7).select("doc_id", "n_chars", "position")


@query("st4_aspect_assignment", "SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 AS BIGINT) AS worker FROM documents")
def st4(spark, sf):
    return H.assign_by_group(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 4)


@query("j4_j5_sample_alignment", """WITH v AS (SELECT o_custkey AS key, max_by(o_orderpriority, -o_orderkey) AS video FROM orders GROUP BY 1), t AS (SELECT c_custkey AS key, c_mktsegment AS caption FROM customer WHERE c_acctbal > 0),
i AS (SELECT user_id AS key, min(event_id) AS position FROM events GROUP BY 1) SELECT key, video, caption, position FROM v JOIN t USING (key) JOIN i USING (key)""")
def j5(spark, sf):
    """Three streams aligned by key: complete samples, repeated keys once, in index order."""
    video = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("position"))
    text = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).alias("position"))
    index = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("position"))
    return H.align({"video": video, "caption": text}, index)


@query("se1_union_with_offsets", "SELECT 0 AS part, p_partkey AS id, p_partkey AS row FROM part UNION ALL SELECT 1, s_suppkey, s_suppkey + (SELECT count(*) FROM part) FROM supplier")
def se1(spark, sf):
    a = table(spark, sf, "part").select(F.lit(0).alias("part"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("row"))
    n = table(spark, sf, "part").agg(F.count("*").alias("n"))
    b = table(spark, sf, "supplier").crossJoin(F.broadcast(n)).select(F.lit(1).alias("part"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + F.col("n")).alias("row"))
    return a.unionByName(b)


@query("se2_se5_set_union", "SELECT DISTINCT c_nationkey AS key FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier")
def se2(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("se3_set_difference", "(SELECT 'left' AS side, o_custkey AS key FROM orders EXCEPT SELECT 'left', user_id FROM events) UNION ALL (SELECT 'right', user_id FROM events EXCEPT SELECT 'right', o_custkey FROM orders)")
def se3(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    b = table(spark, sf, "events").select(F.col("user_id").alias("key")).distinct()
    left, right = a.join(b, "key", "left_anti"), b.join(a, "key", "left_anti")
    return left.select(F.lit("left").alias("side"), "key").unionByName(right.select(F.lit("right").alias("side"), "key"))


@query("se4_key_containment", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def se4(spark, sf):
    """Keys that a table lacks; an empty result is containment."""
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey")


@query("wn11_caption_windows", """WITH d AS (SELECT doc_id, n_chars / 40.0 AS secs FROM documents WHERE n_chars > 0), k AS (SELECT *, greatest(0, CAST(ceil(secs / 5.0 - 1.5) AS BIGINT)) AS k FROM d),
w AS (SELECT doc_id, secs, k, unnest(range(0, k + 1)) AS i FROM k) SELECT doc_id, CAST(i * 5 * 30 AS BIGINT) AS first_frame, CAST(CASE WHEN i < k THEN (i + 1) * 5 * 30 ELSE floor(secs * 30) END AS BIGINT) - 1 AS last_frame FROM w""")
def wn11(spark, sf):
    """Fixed windows of 5 s with inclusive frame ranges at 30 fps."""
    rows = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", F.explode(H.tail_windows(F.col("n_chars") / 40.0)).alias("w"))
    frame = lambda t: F.floor(t * 30)
    return rows.select("doc_id", frame(F.col("w.start")).alias("first_frame"), (frame(F.col("w.end")) - 1).alias("last_frame"))


@query("wn12_caption_chunks", """WITH d AS (SELECT doc_id, n_chars AS f, greatest(n_chars // 256, 1) AS n FROM documents WHERE n_chars >= 4), r AS (SELECT *, f - n * 256 AS rest, f - n * 256 >= 128 AND f - n * 256 > 4 AS tail FROM d)
SELECT doc_id, i * 256 AS start, CAST(CASE WHEN i = n THEN rest WHEN f < 512 AND NOT tail THEN f ELSE 256 END AS BIGINT) AS size FROM (SELECT *, unnest(range(0, n + CASE WHEN tail THEN 1 ELSE 0 END)) AS i FROM r)""")
def wn12(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(H.caption_chunks(F.col("n_chars"), 256, 4)).alias("w"))
    return rows.select("doc_id", "w.start", "w.size")


@query("j14_three_way_stems", "SELECT c_custkey AS stem FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def j14(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("stem"))
    b, c = table(spark, sf, "orders").select(F.col("o_custkey").alias("stem")), table(spark, sf, "events").select(F.col("user_id").alias("stem"))
    return a.join(b, "stem", "left_semi").join(c, "stem", "left_semi")


@query("st6_st8_seeded_shuffle")
def st6(spark, sf):
    """A seeded permutation: rows in hash order, the same on every run."""
    return table(spark, sf, "supplier").select("s_suppkey", F.xxhash64("s_suppkey", F.lit(0)).alias("place")).orderBy("place")


@query("st10_probabilistic_mix")
def st10(spark, sf):
    """Each row goes to a source by a hash against cumulative probabilities."""
    u = F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    return table(spark, sf, "events").select("event_id", F.when(u < 0.5, "video").when(u < 0.8, "image").otherwise("text").alias("source"))
