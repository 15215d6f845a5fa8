"""Rotation and pose algebra on array columns: matrices are arrays of 9 doubles, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Vec = list  # of Columns


def parts(v: Column, n: int, start: int = 0) -> Vec:
    """Elements of an array column, null beyond its end.

    The optimizer takes ``get`` of an array that the select before has built apart and writes its expressions out at every use, which
    grows exponentially over a few conversions; it leaves this form alone, so each select is evaluated once.
    """
    return [F.try_element_at(v, F.lit(start + k + 1)) for k in range(n)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def matmul(a: Vec, b: Vec) -> Vec:
    """Product of two 3 x 3 matrices."""
    return [dot(a[3 * r : 3 * r + 3], [b[c], b[c + 3], b[c + 6]]) for r in range(3) for c in range(3)]


def transpose(m: Vec) -> Vec:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def apply(m: Vec, v: Vec) -> Vec:
    return [dot(m[3 * r : 3 * r + 3], v) for r in range(3)]


def rot6d_columns(d: Vec, floor: float = 1e-8) -> Vec:
    """Matrix whose first two columns the six numbers span (Gram-Schmidt, lengths at least ``floor``)."""
    a, b = d[:3], d[3:]
    n = F.greatest(norm(a), F.lit(floor))
    x = [v / n for v in a]
    k = dot(x, b)
    u = [v - k * w for v, w in zip(b, x, strict=True)]
    m = F.greatest(norm(u), F.lit(floor))
    y = [v / m for v in u]
    z = cross(x, y)
    return [x[0], y[0], z[0], x[1], y[1], z[1], x[2], y[2], z[2]]


def rot6d_rows(d: Vec, eps: float = 1e-8) -> Vec:
    """Matrix whose first two rows the six numbers span; ``eps`` is added to lengths."""
    a, b = d[:3], d[3:]
    x = [v / (norm(a) + eps) for v in a]
    k = dot(x, b)
    u = [v - k * w for v, w in zip(b, x, strict=True)]
    y = [v / (norm(u) + eps) for v in u]
    return [*x, *y, *cross(x, y)]


def to_rot6d(m: Vec) -> Vec:
    """First two columns."""
    return [m[0], m[3], m[6], m[1], m[4], m[7]]


def quaternion(q: Vec, order: str = "xyzw") -> Vec:
    """Matrix of a quaternion, normalized first; a zero one gives the identity."""
    x, y, z, w = q if order == "xyzw" else [q[1], q[2], q[3], q[0]]
    n = dot([x, y, z, w], [x, y, z, w])
    s = F.when(n > 0, 2.0 / n).otherwise(F.lit(0.0))
    return [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)]


def to_quaternion(m: Vec) -> Vec:
    """Unit quaternion xyzw of a matrix, by its largest component."""
    t = m[0] + m[4] + m[8]
    squares = [1 + 2 * m[0] - t, 1 + 2 * m[4] - t, 1 + 2 * m[8] - t, 1 + t]  # 4 x^2, 4 y^2, 4 z^2, 4 w^2
    sums = {(0, 1): m[1] + m[3], (0, 2): m[2] + m[6], (1, 2): m[5] + m[7], (0, 3): m[7] - m[5], (1, 3): m[2] - m[6], (2, 3): m[3] - m[1]}
    best = F.greatest(*squares)
    root = 2 * F.sqrt(best)
    out = []
    for k in range(4):
        value = F.lit(None).cast("double")
        for lead in range(4):
            own = best / root if k == lead else sums[tuple(sorted((k, lead)))] / root
            value = F.coalesce(value, F.when(squares[lead] == best, own))
        out.append(value)
    return out


def euler(e: Vec) -> Vec:
    """Rz Ry Rx of roll, pitch and yaw."""
    (cx, cy, cz), (sx, sy, sz) = [F.cos(v) for v in e], [F.sin(v) for v in e]
    return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]


def to_euler(m: Vec) -> Vec:
    """Roll, pitch and yaw in (-pi, pi]; at the pole yaw is 0."""
    c = F.sqrt(m[0] * m[0] + m[3] * m[3])
    pole = c < 1e-6
    wrap = lambda a: F.when(a <= -math.pi, a + 2 * math.pi).otherwise(a)
    return [wrap(F.when(pole, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8]))), wrap(F.atan2(-m[6], c)), wrap(F.when(pole, F.lit(0.0)).otherwise(F.atan2(m[3], m[0])))]


def hybrid_relative(xyz: Vec, rot: Vec, ref_xyz: Vec, ref_rot: Vec) -> Vec:
    """9 numbers: the shift in the world's frame and R_ref^T R as six."""
    return [*[a - b for a, b in zip(xyz, ref_xyz, strict=True)], *to_rot6d(matmul(transpose(ref_rot), rot))]


def local_relative(xyz: Vec, rot: Vec, ref_xyz: Vec, ref_rot: Vec, scale: float = 1.0) -> Vec:
    """6 numbers: the shift in the reference's own frame and the angles of R_ref^T R, times ``scale``."""
    back = transpose(ref_rot)
    return [v * scale for v in [*apply(back, [a - b for a, b in zip(xyz, ref_xyz, strict=True)]), *to_euler(matmul(back, rot))]]


def scaled_angle(m: Vec, factor: float) -> Vec:
    """The rotation about the same axis by ``factor`` times the angle (Rodrigues); of the two axes of a half turn the one whose
    largest part is positive."""
    cos = F.least(F.greatest((m[0] + m[4] + m[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0))
    axis = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
    n = norm(axis)
    turn = F.atan2(n / 2, cos) * factor
    most = F.greatest(m[0], m[4], m[8])  # at a half turn m + 1 = 2 a a^T: its columns are multiples of the axis
    column = [F.when(m[0] == most, a).when(m[4] == most, b).otherwise(c) for a, b, c in ((m[0] + 1, m[1], m[2]), (m[3], m[4] + 1, m[5]), (m[6], m[7], m[8] + 1))]
    length = norm(column)
    x, y, z = [F.when(n > 1e-9, v / n).when(cos < 0, w / length).otherwise(F.lit(0.0)) for v, w in zip(axis, column, strict=True)]
    s, c = F.sin(turn), 1 - F.cos(turn)
    return [1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x, c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)]


def represented(value: Column, kind: Column, episode: str, order: str) -> Column:
    """An action as its key's configuration asks: ``relative`` to the episode's first step, ``delta`` to the step before (the first is 0),
    or as it is."""
    w = Window.partitionBy(episode).orderBy(order)
    return F.when(kind == "relative", value - F.first(value).over(w)).when(kind == "delta", F.coalesce(value - F.lag(value).over(w), F.lit(0.0))).otherwise(value)


def wired_motion(value: Column, engaged: Column, scale: float, window: str, order: str) -> Column:
    """Motion since a window's first step, scaled; one flag for the whole window, the first step's: disengaged it is 0."""
    w = Window.partitionBy(window).orderBy(order)
    return F.when(F.first(engaged).over(w), scale * (value - F.first(value).over(w))).otherwise(F.lit(0.0))


def product_in_order(matrices: Column) -> Column:
    """Ordered product of an array of 9-element arrays; rotations don't commute, so this is a fold and no window sum."""
    start = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    return F.aggregate(matrices, start, lambda acc, m: F.array(*matmul(parts(acc, 9), parts(m, 9))))


def look_at_inverse(m: Vec, t: Vec) -> tuple[Vec, Vec]:
    """Inverse of a rigid transform: R^T and -R^T t."""
    back = transpose(m)
    return back, [-v for v in apply(back, t)]


def plucker(origin: Vec, direction: Vec) -> Vec:
    """Ray as moment o x d and unit direction d."""
    n = norm(direction)
    d = [v / n for v in direction]
    return [*cross(origin, d), *d]


def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """Camera point of a pixel at its depth."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def resized(width: Column, height: Column, to_w: int, to_h: int, smallest: bool = True) -> Vec:
    """Size that keeps the aspect and covers (smallest side) or fits (largest side) the target: int(ratio * side + 0.5)."""
    pick = F.greatest if smallest else F.least
    ratio = pick(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)
    return [F.floor(ratio * width + 0.5), F.floor(ratio * height + 0.5)]
