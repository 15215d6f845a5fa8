"""Queries over masks and frames; every vector of ``embeddings`` is an image of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import table
from tessella.operators import evaluation as E
from tessella.operators import images as I
from tessella.registry import query

CROSS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx)"
#: Masks, erosion by a cross, components of the rest with diagonals, and growth back in eight steps.
INSTANCES = (
    f"""RECURSIVE px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) WHERE embedding[i + 1] > -0.1),
near AS (SELECT p.vec_id, p.y, p.x, count(*) FILTER (p.y + dy BETWEEN 0 AND 7 AND p.x + dx BETWEEN 0 AND 7 AND q.vec_id IS NULL) AS open FROM px p CROSS JOIN {CROSS} LEFT JOIN px q ON q.vec_id = p.vec_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
core AS (SELECT vec_id, y, x FROM near WHERE open = 0), seed AS (SELECT * FROM core UNION ALL SELECT * FROM px WHERE vec_id NOT IN (SELECT vec_id FROM core)),
reach(vec_id, y, x, root) AS (SELECT vec_id, y, x, y * 8 + x FROM seed UNION SELECT s.vec_id, s.y, s.x, root FROM reach r JOIN seed s ON s.vec_id = r.vec_id AND abs(s.y - r.y) <= 1 AND abs(s.x - r.x) <= 1),
least AS (SELECT vec_id, y, x, min(root) AS root FROM reach GROUP BY ALL), g0 AS (SELECT vec_id, y, x, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label FROM least), """
    + ", ".join(f"g{k + 1} AS MATERIALIZED (SELECT * FROM g{k} UNION ALL SELECT p.vec_id, p.y, p.x, max(g.label) FROM px p CROSS JOIN {CROSS} JOIN g{k} g ON g.vec_id = p.vec_id AND g.y = p.y + dy AND g.x = p.x + dx WHERE (p.vec_id, p.y, p.x) NOT IN (SELECT (vec_id, y, x) FROM g{k}) GROUP BY ALL)" for k in range(8))
    + ", inst AS (SELECT vec_id, label AS instance, count(*) AS area, avg(x) AS x, avg(y) AS y FROM g8 GROUP BY ALL HAVING count(*) >= 4)"
)


def mask_rows(spark, sf):
    masks = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") > -0.1).alias("mask"))
    return I.mask_instances(masks, ["vec_id"], "mask", 8, 8, radius=1, least=4)


@query("ma29_mask_instances", f"WITH {INSTANCES} SELECT vec_id, CAST(instance AS INTEGER) AS instance, area, round(x, 6) AS x, round(y, 6) AS y FROM inst")
def ma29(spark, sf):
    """Instances of every image's mask after erosion, labelling and growing back, with area and centroid."""
    return mask_rows(spark, sf).select("vec_id", "instance", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("ma29_instance_counts", f"WITH {INSTANCES} SELECT label, count(*) AS instances, count(DISTINCT vec_id) AS frames, sum(area)::BIGINT AS area FROM inst JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY 1")
def ma29_counts(spark, sf):
    """The same summed up by label."""
    rows = mask_rows(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return rows.groupBy("label").agg(F.count("*").alias("instances"), F.count_distinct("vec_id").alias("frames"), F.sum("area").alias("area"))


@query("j11_mask_distance")
def j11(spark, sf):
    """Mean distance of each image's instances to those of the next image with its label; half a diagonal for each that has no match."""
    order = Window.partitionBy("label").orderBy("vec_id")
    pairs = table(spark, sf, "embeddings").select("vec_id", F.lead("vec_id").over(order).alias("other")).where("other IS NOT NULL")
    points = mask_rows(spark, sf)
    gt = pairs.join(points, "vec_id").select("vec_id", F.lit(0).alias("side"), "x", "y")
    gen = pairs.join(points.withColumnRenamed("vec_id", "other"), "other").select("vec_id", F.lit(1).alias("side"), "x", "y")
    return E.centroid_distance(gt.unionByName(gen), ["vec_id"], 0.5 * 128**0.5)


def _pixel(image: str, y: str, x: str) -> str:
    """A pixel mirrored at the borders."""
    mirrored = lambda v: f"(7 - abs(7 - abs({v})))"
    return f"{image}[{mirrored(y)} * 8 + {mirrored(x)} + 1]"


def _gradient(image: str) -> str:
    smooth = lambda y, x, dy, dx: f"({_pixel(image, f'{y} - {dx}', f'{x} - {dy}')} + 2 * {_pixel(image, y, x)} + {_pixel(image, f'{y} + {dx}', f'{x} + {dy}')})"
    gx = f"({smooth('y', '(x + 1)', 0, 1)} - {smooth('y', '(x - 1)', 0, 1)})"
    gy = f"({smooth('(y + 1)', 'x', 1, 0)} - {smooth('(y - 1)', 'x', 1, 0)})"
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


CLAMPED = "gen[least(greatest(y - dy, 0), 7) * 8 + least(greatest(x - dx, 0), 7) + 1]"
CONSISTENCY = f"""e AS (SELECT label AS video, row_number() OVER w - 1 AS t, CAST(embedding AS DOUBLE[]) AS gt, CAST(coalesce(lead(embedding) OVER w, embedding) AS DOUBLE[]) AS nx FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
f AS (SELECT video, t, gt, list_transform(list_zip(gt, nx), lambda p: (p[1] + p[2]) / 2) AS gen FROM e), grid AS (SELECT i // 8 AS y, i % 8 AS x FROM range(64) r(i)),
m AS (SELECT DISTINCT video, t, g.y, g.x FROM f CROSS JOIN grid g CROSS JOIN (SELECT * FROM {CROSS} UNION ALL SELECT 0, 0) d(dy, dx) WHERE g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7 AND gt[(g.y + dy) * 8 + g.x + dx + 1] > 0.12),
big AS (SELECT video, t FROM m GROUP BY ALL HAVING count(*) >= 20),
pen AS (SELECT video, t, least(1.0, avg({_gradient('gen')}) / (avg({_gradient('gt')}) + 1e-6)) AS penalty FROM m JOIN f USING (video, t) GROUP BY ALL),
s AS (SELECT video, t, d, dy, dx, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b) + 1e-6) AS z FROM (SELECT video, m.t, d, dy, dx, f.gt[y * 8 + x + 1] AS a, o.{CLAMPED} AS b
  FROM m JOIN big USING (video, t) JOIN f USING (video, t) CROSS JOIN range(-1, 2) r(d) JOIN (SELECT video, t AS other, gen FROM f) o USING (video) CROSS JOIN range(-3, 4) u(dy) CROSS JOIN range(-3, 4) v(dx) WHERE o.other = m.t + d) GROUP BY ALL),
best AS (SELECT video, t, max(z) AS z FROM s GROUP BY ALL),
sc AS (SELECT f.video, f.t, z * penalty AS score, z IS NOT NULL AS valid FROM f LEFT JOIN best USING (video, t) LEFT JOIN pen USING (video, t))"""


def consistency(spark, sf):
    """The images of a label are a video; the generated frame is the mean of an image and the next."""
    order = Window.partitionBy("label").orderBy("vec_id")
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("video"), (F.row_number().over(order) - 1).cast("long").alias("t"), e.alias("gt"), F.coalesce(F.lead(e).over(order), e).alias("nx"))
    rows = rows.withColumn("gen", F.zip_with("gt", "nx", lambda a, b: (a + b) / 2)).withColumn("mask", F.transform("gt", lambda v: v > 0.12))
    return I.anchored_consistency(rows, ["video"], "t", 8, 8, k=3, radius=1, least=20)


@query("ma28_anchored_consistency", f"WITH {CONSISTENCY} SELECT video, t, round(score, 6) + 0 AS score, valid FROM sc")
def ma28(spark, sf):
    """Every frame's best correlation over shifts of 3 pixels and 1 frame under its grown mask, times the share of gradient kept."""
    return consistency(spark, sf).select("video", "t", (F.round("score", 6) + 0.0).alias("score"), "valid")


@query("ma28_consistency_summary", f"WITH {CONSISTENCY} SELECT video, count(*) AS frames, round(median(score) FILTER (valid), 6) AS score, round(100 * avg(CAST(valid AS DOUBLE)), 6) AS coverage FROM sc GROUP BY 1")
def ma28_summary(spark, sf):
    return I.consistency_summary(consistency(spark, sf), ["video"]).select("video", "frames", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))
