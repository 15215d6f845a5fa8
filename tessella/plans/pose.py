"""Queries over poses: rotations, relative poses, cameras, sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import table
from tessella.functions import pose as P
from tessella.registry import query

E = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(16))
BASE = f"b AS (SELECT vec_id, label, {E} FROM embeddings)"


def rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def out(df, names, cols, digits: int = 6):
    return df.select("vec_id", *[(F.round(c, digits) + 0.0).alias(n) for n, c in zip(names, cols, strict=True)])


R9 = [f"r{k}" for k in range(9)]
#: Gram-Schmidt of e0..e5 in SQL, step by step.
GS = f"""{BASE}, x AS (SELECT *, e0 / n AS x0, e1 / n AS x1, e2 / n AS x2 FROM (SELECT *, greatest(sqrt(e0 * e0 + e1 * e1 + e2 * e2), 1e-8) AS n FROM b)),
k AS (SELECT *, e3 - d * x0 AS u0, e4 - d * x1 AS u1, e5 - d * x2 AS u2 FROM (SELECT *, x0 * e3 + x1 * e4 + x2 * e5 AS d FROM x)),
y AS (SELECT *, u0 / m AS y0, u1 / m AS y1, u2 / m AS y2 FROM (SELECT *, greatest(sqrt(u0 * u0 + u1 * u1 + u2 * u2), 1e-8) AS m FROM k)),
g AS (SELECT vec_id, label, e6, e7, e8, e9, e10, e11, x0, x1, x2, y0, y1, y2, x1 * y2 - x2 * y1 AS z0, x2 * y0 - x0 * y2 AS z1, x0 * y1 - x1 * y0 AS z2 FROM y)"""

#: The same with 1e-8 added to lengths.
GS_EPS = GS.replace("greatest(sqrt(", "(sqrt(").replace("), 1e-8)", ") + 1e-8)")


def sql_round(cols):
    return ", ".join(f"round({c}, 6) + 0 AS {n}" for n, c in cols)


@query("ma8_rot6d_columns", f"WITH {GS} SELECT vec_id, {sql_round(zip(R9, ['x0', 'y0', 'z0', 'x1', 'y1', 'z1', 'x2', 'y2', 'z2']))} FROM g")
def ma8(spark, sf):
    return out(rows(spark, sf), R9, P.rot6d_columns(P.parts(F.col("e"), 6)))


@query("ma8_rot6d_round_trip", f"WITH {GS} SELECT vec_id, {sql_round([('d0', 'x0'), ('d1', 'x1'), ('d2', 'x2'), ('d3', 'y0'), ('d4', 'y1'), ('d5', 'y2')])} FROM g")
def ma8r(spark, sf):
    m = P.rot6d_columns(P.parts(F.col("e"), 6))
    return out(rows(spark, sf), [f"d{k}" for k in range(6)], P.to_rot6d(m))


@query("ma9_rot6d_rows", f"WITH {GS_EPS} SELECT vec_id, round(x0, 5) + 0 AS r0, round(x1, 5) + 0 AS r1, round(y0, 5) + 0 AS r3, round(z2, 5) + 0 AS r8 FROM g")
def ma9(spark, sf):
    m = P.rot6d_rows(P.parts(F.col("e"), 6))
    return out(rows(spark, sf), ["r0", "r1", "r3", "r8"], [m[0], m[1], m[3], m[8]], 5)


QUAT = f"{BASE}, q AS (SELECT vec_id, e0 / n AS x, e1 / n AS y, e2 / n AS z, e3 / n AS w FROM (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS n FROM b))"
QM = ["1 - 2 * (y * y + z * z)", "2 * (x * y - z * w)", "2 * (x * z + y * w)", "2 * (x * y + z * w)", "1 - 2 * (x * x + z * z)", "2 * (y * z - x * w)", "2 * (x * z - y * w)", "2 * (y * z + x * w)", "1 - 2 * (x * x + y * y)"]


@query("ma10_quaternion_matrix", f"WITH {QUAT} SELECT vec_id, {sql_round(zip(R9, QM))} FROM q")
def ma10(spark, sf):
    return out(rows(spark, sf), R9, P.quaternion(P.parts(F.col("e"), 4)))


@query("ma12_quaternion_round_trip", f"WITH {QUAT} SELECT vec_id, round(abs(x), 6) AS x, round(abs(y), 6) AS y, round(abs(z), 6) AS z, round(abs(w), 6) AS w FROM q")
def ma12(spark, sf):
    q = P.to_quaternion(P.quaternion(P.parts(F.col("e"), 4)))
    return out(rows(spark, sf), list("xyzw"), [F.abs(c) for c in q])


EUL = f"{BASE}, a AS (SELECT vec_id, e0 AS a, e1 AS p, e2 AS y FROM b)"
EM = ["cos(y) * cos(p)", "cos(y) * sin(p) * sin(a) - sin(y) * cos(a)", "cos(y) * sin(p) * cos(a) + sin(y) * sin(a)", "sin(y) * cos(p)", "sin(y) * sin(p) * sin(a) + cos(y) * cos(a)", "sin(y) * sin(p) * cos(a) - cos(y) * sin(a)", "-sin(p)", "cos(p) * sin(a)", "cos(p) * cos(a)"]


@query("ma11_euler_matrix", f"WITH {EUL} SELECT vec_id, {sql_round(zip(R9, EM))} FROM a")
def ma11(spark, sf):
    return out(rows(spark, sf), R9, P.euler(P.parts(F.col("e"), 3)))


@query("ma11_euler_round_trip", f"WITH {EUL} SELECT vec_id, {sql_round([('roll', 'a'), ('pitch', 'p'), ('yaw', 'y')])} FROM a")
def ma11r(spark, sf):
    return out(rows(spark, sf), ["roll", "pitch", "yaw"], P.to_euler(P.euler(P.parts(F.col("e"), 3))))


@query("ma13_hybrid_relative", f"""WITH {GS}, p AS (SELECT a.vec_id, a.e6 - f.e6 AS dx, a.e7 - f.e7 AS dy, a.e8 - f.e8 AS dz, f.x0 * a.x0 + f.x1 * a.x1 + f.x2 * a.x2 AS r00, f.y0 * a.x0 + f.y1 * a.x1 + f.y2 * a.x2 AS r10, f.z0 * a.x0 + f.z1 * a.x1 + f.z2 * a.x2 AS r20
FROM g a JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) f ON a.label = f.label) SELECT vec_id, {sql_round([(c, c) for c in ('dx', 'dy', 'dz', 'r00', 'r10', 'r20')])} FROM p""")
def ma13(spark, sf):
    """Each pose against its label's first: shift in the world's frame."""
    r = rows(spark, sf)
    r = r.withColumn("f", F.first("e").over(Window.partitionBy("label").orderBy("vec_id")))
    rot = lambda c: P.rot6d_columns(P.parts(F.col(c), 6))
    h = P.hybrid_relative(P.parts(F.col("e"), 3, 6), rot("e"), P.parts(F.col("f"), 3, 6), rot("f"))
    return out(r, ["dx", "dy", "dz", "r00", "r10", "r20"], h[:6])


@query("ma16_local_relative", f"""WITH {GS}, p AS (SELECT a.vec_id, a.e6 - f.e6 AS dx, a.e7 - f.e7 AS dy, a.e8 - f.e8 AS dz, f.* FROM g a JOIN (SELECT * EXCLUDE (vec_id) FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) f ON a.label = f.label)
SELECT vec_id, round(20 * (x0 * dx + x1 * dy + x2 * dz), 5) + 0 AS tx, round(20 * (y0 * dx + y1 * dy + y2 * dz), 5) + 0 AS ty, round(20 * (z0 * dx + z1 * dy + z2 * dz), 5) + 0 AS tz FROM p""")
def ma16(spark, sf):
    """The same in the reference's own frame, scaled by 20."""
    r = rows(spark, sf)
    r = r.withColumn("f", F.first("e").over(Window.partitionBy("label").orderBy("vec_id")))
    rot = lambda c: P.rot6d_columns(P.parts(F.col(c), 6))
    h = P.local_relative(P.parts(F.col("e"), 3, 6), rot("e"), P.parts(F.col("f"), 3, 6), rot("f"), 20.0)
    return out(r, ["tx", "ty", "tz"], h[:3], 5)


@query("ma14_masked_rotation_product")
def ma14(spark, sf):
    """Ordered product of each label's rotations where engaged (first component positive)."""
    m = F.when(F.col("e")[6] > 0, F.array(*P.rot6d_columns(P.parts(F.col("e"), 6)))).otherwise(F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", m.alias("m")))), lambda x: x["m"])
    block = F.floor(F.col("vec_id") / 256)
    part = rows(spark, sf).groupBy("label", block.alias("block")).agg(P.product_in_order(ordered).alias("m"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("block", "m"))), lambda x: x["m"])
    return part.groupBy("label").agg(P.product_in_order(whole).alias("rotation"))


@query("ma15_scaled_angle", f"WITH {EUL} SELECT vec_id, round(cos(a / 2), 6) + 0 AS c, round(sin(a / 2), 6) + 0 AS s FROM a")
def ma15(spark, sf):
    """Half the angle of a roll: its cosine and sine."""
    roll = P.euler([F.col("e")[0], F.lit(0.0), F.lit(0.0)])
    h = P.scaled_angle(roll, 0.5)
    return out(rows(spark, sf), ["c", "s"], [h[4], h[7]])


@query("ma17_representation_switch", f"WITH {BASE}, f AS (SELECT *, first_value(e0) OVER w AS f0, lag(e0) OVER w AS p0 FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, round(CASE label % 3 WHEN 0 THEN e0 - f0 WHEN 1 THEN coalesce(e0 - p0, 0) ELSE e0 END, 6) + 0 AS y FROM f")
def ma17(spark, sf):
    """Relative, delta or absolute by the key's configuration (here the label)."""
    kind = F.when(F.col("label") % 3 == 0, "relative").when(F.col("label") % 3 == 1, "delta").otherwise("absolute")
    return out(rows(spark, sf), ["y"], [P.represented(F.col("e")[0], kind, "label", "vec_id")])


@query("ma18_dual_arm_relative", f"WITH {GS_EPS} SELECT a.vec_id, round(a.e6 - f.e6, 6) + 0 AS x, round(f.x0 * a.x0 + f.x1 * a.x1 + f.x2 * a.x2, 5) + 0 AS c FROM g a JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) f ON a.label = f.label WHERE a.vec_id <> f.vec_id")
def ma18(spark, sf):
    """Poses after the first against it, rows convention: shift and the cosine between first axes."""
    w = Window.partitionBy("label").orderBy("vec_id")
    r = rows(spark, sf).withColumn("f", F.first("e").over(w)).withColumn("n", F.row_number().over(w)).where("n > 1")
    m, f = P.rot6d_rows(P.parts(F.col("e"), 6)), P.rot6d_rows(P.parts(F.col("f"), 6))
    rel = P.matmul(f, P.transpose(m))
    return r.select("vec_id", (F.round(F.col("e")[6] - F.col("f")[6], 6) + 0.0).alias("x"), (F.round(rel[0], 5) + 0.0).alias("c"))


@query("ma19_rotation_converter", f"WITH {QUAT} SELECT vec_id, {sql_round([('d0', QM[0]), ('d1', QM[3]), ('d2', QM[6]), ('d3', QM[1])])} FROM q")
def ma19(spark, sf):
    """Quaternion to six numbers by way of the matrix."""
    return out(rows(spark, sf), ["d0", "d1", "d2", "d3"], P.to_rot6d(P.quaternion(P.parts(F.col("e"), 4)))[:4])


@query("ma24_camera_rays", f"WITH {QUAT}, o AS (SELECT q.*, b.e4 AS a, b.e5 AS b, b.e6 AS c FROM q JOIN b USING (vec_id)) SELECT vec_id, round(-(({QM[0]}) * a + ({QM[3]}) * b + ({QM[6]}) * c), 6) + 0 AS cx, round(-(({QM[1]}) * a + ({QM[4]}) * b + ({QM[7]}) * c), 6) + 0 AS cy FROM o")
def ma24(spark, sf):
    """Camera centres of world-to-camera transforms (and rays through them, tested in Python)."""
    _, c = P.look_at_inverse(P.quaternion(P.parts(F.col("e"), 4)), P.parts(F.col("e"), 3, 4))
    return out(rows(spark, sf), ["cx", "cy"], c[:2])


@query("ma25_back_projection", "SELECT vec_id, round((vec_id % 64 - 32) / 50.0 * (1 + label), 6) + 0 AS x, round((vec_id // 64 - 4) / 50.0 * (1 + label), 6) + 0 AS y, CAST(1 + label AS DOUBLE) AS z FROM embeddings")
def ma25(spark, sf):
    p = P.back_project(F.col("vec_id") % 64, F.floor(F.col("vec_id") / 64), (F.col("label") + 1).cast("double"), 50.0, 50.0, 32.0, 4.0)
    return out(rows(spark, sf), list("xyz"), p)


@query("ma26_resize_geometry", "SELECT p_partkey, CAST(floor(greatest(512.0 / w, 288.0 / h) * w + 0.5) AS BIGINT) AS cover_w, CAST(floor(least(512.0 / w, 288.0 / h) * h + 0.5) AS BIGINT) AS fit_h FROM (SELECT p_partkey, CAST(p_size * 16 AS DOUBLE) AS w, CAST(100 + p_partkey % 900 AS DOUBLE) AS h FROM part)")
def ma26(spark, sf):
    w, h = (F.col("p_size") * 16).cast("double"), (F.col("p_partkey") % 900 + 100).cast("double")
    return table(spark, sf, "part").select("p_partkey", P.resized(w, h, 512, 288)[0].alias("cover_w"), P.resized(w, h, 512, 288, False)[1].alias("fit_h"))


@query("ma20_wired_motion", f"WITH {BASE}, f AS (SELECT *, first_value(e0) OVER w AS f0, first_value(e6 > 0) OVER w AS on_ FROM b WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, round(CASE WHEN on_ THEN 0.5 * (e0 - f0) ELSE 0 END, 6) + 0 AS dx FROM f")
def ma20(spark, sf):
    """The wired preset: one engagement flag per window, motion scaled by 0.5, grippers untouched."""
    return out(rows(spark, sf), ["dx"], [P.wired_motion(F.col("e")[0], F.col("e")[6] > 0, 0.5, "label", "vec_id")])

