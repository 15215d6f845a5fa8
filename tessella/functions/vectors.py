"""Vector expressions: slices, padding, normalization and its inverse, expansions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vslice(v: Column, start: int, end: int) -> Column:
    """Components [start, end)."""
    return F.slice(v, start + 1, end - start)


def pad(v: Column, dims: int) -> Column:
    """Zeros up to ``dims``; longer vectors stay as they are."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dims) - F.size(v)).cast("int")))


def resize(v: Column, length: int, fill: float = 0.0) -> tuple[Column, Column]:
    """The vector cut or filled to ``length``, and its mask (1 where a component is its own)."""
    own = F.least(F.size(v), F.lit(length))
    filled = F.concat(F.slice(v, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - own).cast("int")))
    return filled, F.concat(F.array_repeat(F.lit(1), own.cast("int")), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - own).cast("int")))


def concat_checked(parts: list[tuple[Column, int]]) -> Column:
    """Parts in order; a part whose size isn't the declared one is an error."""
    return F.concat(*[F.when(F.size(v) == n, v).otherwise(F.raise_error(F.lit(f"expected {n} dimensions")).cast("array<double>")) for v, n in parts])


def split(v: Column, sizes: list[int]) -> list[Column]:
    """The inverse of concatenation: consecutive parts of these sizes."""
    out, at = [], 0
    for n in sizes:
        out.append(vslice(v, at, at + n))
        at += n
    return out


def _each(v: Column, stats: Column, f) -> Column:
    return F.transform(v, lambda x, i: f(x, lambda name: F.get(stats[name], i)))


def normalize(v: Column, stats: Column, mode: str) -> Column:
    """Normalize by statistics (struct of arrays min, max, mean, std, q01, q99).

    ``min_max`` and ``q99`` map the range to [-1, 1], ``scale`` divides by the largest size, ``mean_std`` standardizes,
    ``binary`` tests > 0.5.  Constant dimensions become 0 under ``min_max`` and ``scale`` and pass unchanged under
    ``q99`` and ``mean_std``; ``q99`` is clamped to [-1, 1].
    """
    if mode == "binary":
        return F.transform(v, lambda x: (x > 0.5).cast("double"))
    if mode == "mean_std":
        return _each(v, stats, lambda x, s: F.when(s("std") == 0, x).otherwise((x - s("mean")) / s("std")))
    if mode == "scale":
        size = lambda s: F.greatest(F.abs(s("min")), F.abs(s("max")))
        return _each(v, stats, lambda x, s: F.when(size(s) == 0, F.lit(0.0)).otherwise(x / size(s)))
    low, high = ("min", "max") if mode == "min_max" else ("q01", "q99")
    line = lambda x, s: 2 * (x - s(low)) / (s(high) - s(low)) - 1
    if mode == "min_max":
        return _each(v, stats, lambda x, s: F.when(s(low) == s(high), F.lit(0.0)).otherwise(line(x, s)))
    if mode == "q99":
        return _each(v, stats, lambda x, s: F.least(F.greatest(F.when(s(low) == s(high), x).otherwise(line(x, s)), F.lit(-1.0)), F.lit(1.0)))
    raise ValueError(f"unknown mode {mode}")


def denormalize(v: Column, stats: Column, mode: str) -> Column:
    """The inverse of ``normalize`` on dimensions that aren't constant; ``scale`` has none."""
    if mode == "binary":
        return v
    if mode == "mean_std":
        return _each(v, stats, lambda x, s: F.when(s("std") == 0, x).otherwise(x * s("std") + s("mean")))
    if mode in ("min_max", "q99"):
        low, high = ("min", "max") if mode == "min_max" else ("q01", "q99")
        return _each(v, stats, lambda x, s: (x + 1) / 2 * (s(high) - s(low)) + s(low))
    raise ValueError(f"{mode} has no inverse")


def sin_cos(v: Column) -> Column:
    """All sines, then all cosines."""
    return F.concat(F.transform(v, F.sin), F.transform(v, F.cos))


def combine(a: Column, b: Column, op: str) -> Column:
    """Element-wise add, sub, mul or div."""
    f = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}[op]
    return F.zip_with(a, b, f)


def dequantise(bins: Column, low: float, high: float, n: int) -> Column:
    """Continuous value at the middle of each of ``n`` equal bins over [low, high]."""
    return F.transform(bins, lambda b: low + (b + 0.5) * (high - low) / n)


def picked(v: Column, at: list[int]) -> Column:
    """Components at fixed positions, null beyond the end."""
    return F.transform(F.array(*map(F.lit, at)), lambda i: F.get(v, i))


def sincos_embedding(position: Column, dims: int) -> Column:
    """Positional embedding: sines then cosines of position / 10000^(k / (dims / 2))."""
    half = dims // 2
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: position / F.pow(F.lit(10000.0), k / float(half)))
    return F.concat(F.transform(angle, F.sin), F.transform(angle, F.cos))


def perturbed(v: Column, seed: Column, std: float) -> Column:
    """Seeded noise, clamped to the vector's own range before it (a uniform sum stands for the normal)."""
    low, high = F.array_min(v), F.array_max(v)
    unit = lambda i, k: F.pmod(F.xxhash64(seed, i, F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    noise = lambda i: (sum((unit(i, k) for k in range(1, 12)), unit(i, 0)) - 6.0) * std
    return F.transform(v, lambda x, i: F.least(F.greatest(x + noise(i), low), high))


def dropped(v: Column, seed: Column, p: float) -> Column:
    """All zeros with probability p, by a hash of ``seed``."""
    unit = F.pmod(F.xxhash64(seed), F.lit(1 << 20)) / float(1 << 20)
    return F.when(unit < p, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
