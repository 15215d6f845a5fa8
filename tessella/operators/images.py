"""Masks and frames: instances by morphology and run-length components, and anchored consistency by shifted correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels that one numpy pass works on.
PASS_PIXELS = 1 << 22


def disc(radius: int) -> list[tuple[int, int]]:
    """Rows (dy, half width) of a round neighbourhood; radius 1 is a cross."""
    return [(dy, int(np.rint(np.sqrt(radius * radius - dy * dy)))) for dy in range(-radius, radius + 1)]


def dilated(masks: np.ndarray, radius: int) -> np.ndarray:
    """Masks (frames, height, width) grown by a disc; what lies outside a frame counts as unset.

    A row of the disc is a window of counts, so a pixel costs one difference a row whatever the disc's width.
    """
    if radius <= 0:
        return masks
    n, h, w = masks.shape
    count = np.zeros((n, h, w + 1), np.int32)
    np.cumsum(masks, axis=2, out=count[:, :, 1:])
    out = np.zeros_like(masks)
    x = np.arange(w)
    for dy, half in disc(radius):
        near = count[:, :, np.minimum(x + half + 1, w)] > count[:, :, np.maximum(x - half, 0)]
        if abs(dy) < h:
            out[:, max(0, -dy) : h - max(0, dy)] |= near[:, max(0, dy) : h - max(0, -dy)]
    return out


def eroded(masks: np.ndarray, radius: int) -> np.ndarray:
    """Masks shrunk by a disc; what lies outside a frame counts as set."""
    return ~dilated(~masks, radius)


def components(masks: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected components of every mask, numbered from 1 in scan order.

    All frames at once: rows become runs of set pixels, runs of neighbouring rows that touch are found by two searches in their sorted
    ends, and joined by hooking the larger root under the smaller and halving paths until nothing moves.
    """
    n, h, w = masks.shape
    flat = np.zeros((n, h, w + 2), np.int8)
    flat[:, :, 1:-1] = masks
    step = np.diff(flat.ravel())
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    row, reach = start // (w + 2), int(diagonal)
    lo = np.searchsorted(end, start + (w + 2) - reach, "right")
    hi = np.searchsorted(start, end + (w + 2) + reach, "left")
    count = np.where((row + 1) % h == 0, 0, np.maximum(hi - lo, 0))
    a = np.repeat(np.arange(len(start)), count)
    b = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
    root = np.arange(len(start))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    kinds, number = np.unique(root, return_inverse=True)
    frame = row // h
    before = np.searchsorted(frame[kinds], np.arange(n))  # components of earlier frames
    label = number + 1 - before[frame] if len(start) else number
    mark = np.zeros(n * h * (w + 2) + 1, np.int64)
    mark[start] += label
    mark[end] -= label
    return np.cumsum(mark[:-1]).reshape(n, h, w + 2)[:, :, 1:-1]


def grown(labels: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Labels spread inside their masks a pixel at a time, up and sideways; where several meet the highest wins.

    A frame takes as many steps as its longer side at most; mask pixels that no label reaches stay 0.
    """
    out = labels.copy()
    for _ in range(max(masks.shape[1:])):
        near = np.zeros_like(out)
        near[:, 1:] = out[:, :-1]
        near[:, :-1] = np.maximum(near[:, :-1], out[:, 1:])
        near[:, :, 1:] = np.maximum(near[:, :, 1:], out[:, :, :-1])
        near[:, :, :-1] = np.maximum(near[:, :, :-1], out[:, :, 1:])
        fill = masks & (out == 0) & (near > 0)
        if not fill.any():
            break
        out[fill] = near[fill]
    return out


def instances(masks: np.ndarray, radius: int = 3) -> np.ndarray:
    """Labels of the parts of every mask that are one after erosion by a disc, grown back over the mask.

    A mask that erosion wipes out is taken as it is.
    """
    seeds = eroded(masks, radius)
    seeds = np.where(seeds.any(axis=(1, 2), keepdims=True), seeds, masks)
    return grown(components(seeds), masks)


def centroids(labels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frame, label, area, x, y) of the labels with ``least`` pixels or more, by frame and label."""
    n, h, w = labels.shape
    f, y, x = np.nonzero(labels)
    most = int(labels.max(initial=0)) + 1
    key = f * most + labels[f, y, x]
    area = np.bincount(key, minlength=n * most)
    sums = [np.bincount(key, weights=v, minlength=n * most) for v in (x, y)]
    keep = np.flatnonzero(area >= max(1, least))
    return keep // most, keep % most, area[keep], sums[0][keep] / area[keep], sums[1][keep] / area[keep]


def _slices(rows: int, pixels: int) -> Iterator[tuple[int, int]]:
    size = max(1, PASS_PIXELS // max(1, pixels))
    for i in range(0, rows, size):
        yield i, min(rows, i + size)


def _stack(col: pa.Array, height: int, width: int) -> np.ndarray:
    """A list column of height * width values as frames; another length is an error."""
    if (np.asarray(col.value_lengths()) != height * width).any():
        raise ValueError(f"a frame doesn't have {height} x {width} pixels")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)


def mask_instances(frames: DataFrame, by: list[str], mask: str, height: int, width: int, radius: int = 3, least: int = 50) -> DataFrame:
    """(by..., instance, area, x, y): the instances of every frame's mask with ``least`` pixels or more, and their centroids.

    ``mask`` is an array of height * width values by rows, non-zero where set.  Frames with a null or empty mask give no rows.  A task
    labels all frames of a batch together; nothing is shuffled.
    """
    own = frames.where(F.col(mask).isNotNull()).select(*by, F.transform(mask, lambda v: v.cast("double") != 0).alias("_mask"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            for i, j in _slices(batch.num_rows, height * width):
                part = batch.slice(i, j - i)
                frame, label, area, x, y = centroids(instances(_stack(part.column(part.num_columns - 1), height, width), radius), least)
                at = pa.array(frame)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(by))), pa.array(label.astype(np.int32)), pa.array(area), pa.array(x), pa.array(y)], names=[*by, "instance", "area", "x", "y"])

    return own.mapInArrow(run, ", ".join([*fields, "instance int", "area long", "x double", "y double"]))


def gradient(grey: np.ndarray) -> np.ndarray:
    """Magnitude of the 3 x 3 smoothed differences along both axes of one image, mirrored at its borders."""
    p = np.pad(grey, 1, "reflect") if min(grey.shape) > 1 else np.pad(grey, 1, "edge")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2])


def shifted_correlation(x: np.ndarray, y: np.ndarray, mask: np.ndarray, k: int, eps: float = 1e-6) -> np.ndarray:
    """Zero-mean normalized correlation under ``mask`` of x with y moved by every (dy, dx) from -k to k, edges repeated.

    Sums of y and of its squares under the moved mask come from summed rows: each run of set pixels is one difference for
    every shift.  Products are one contraction over a sliding window of the padded image.  Fewer than 10 pixels give NaN.
    """
    size = 2 * k + 1
    n = int(mask.sum())
    if n < 10:
        return np.full((size, size), np.nan)
    h, w = x.shape
    middle = y.mean()
    p = np.pad(y - middle, k, "edge")
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    shift = np.arange(k, -k - 1, -1)  # moving an image down by one reads the row above
    rows, lo, hi = row + k + shift[:, None], begin + k + shift[:, None], end + k + shift[:, None]

    def under(image: np.ndarray) -> np.ndarray:
        table = np.pad(np.cumsum(image, axis=1), ((0, 0), (1, 0)))
        return (table[rows[:, None], hi[None]] - table[rows[:, None], lo[None]]).sum(-1)

    a = np.where(mask, x, 0.0)
    mean_x = a.sum() / n
    a = np.where(mask, x - mean_x, 0.0)
    windows = np.lib.stride_tricks.sliding_window_view(p, (h, w))[::-1, ::-1]
    cross = np.einsum("hw,abhw->ab", a, windows) / n
    mean, square = under(p) / n, under(p * p) / n
    return cross / (np.sqrt((a * a).sum() / n) * np.sqrt(np.maximum(square - mean * mean, 0.0)) + eps)


def presence(grad_x: np.ndarray, grad_y: np.ndarray, mask: np.ndarray, eps: float = 1e-6) -> float:
    """How much of x's mean gradient under the mask y has, at most 1; NaN for fewer than 10 pixels."""
    return float("nan") if mask.sum() < 10 else min(1.0, float(grad_y[mask].mean()) / (float(grad_x[mask].mean()) + eps))


def anchored_consistency(frames: DataFrame, by: list[str], t: str, height: int, width: int, k: int = 3, radius: int = 10, least: int = 50, steps: tuple[int, ...] = (-1, 0, 1), by_gradient: bool = False) -> DataFrame:
    """(by..., t, score, valid): how well generated frames show what the true frames show under their masks.

    ``frames`` has for each video (``by``) and time ``t`` the grey images ``gt`` and ``gen`` (0 to 1) and ``mask``, arrays of height *
    width values.  The mask is grown by a disc; under it the true frame is correlated with the generated frames ``steps`` before or
    after, moved by up to k pixels; the best counts, times the share of gradient that the generated frame has there.  Frames
    whose grown mask has fewer than ``least`` pixels, or that compare with nothing, aren't valid and have no score.
    One sort by video brings neighbouring frames together; then frames are scored alone, whatever their video's length.
    """
    order = Window.partitionBy(*by).orderBy(t)
    near = [F.col("gen") if d == 0 else (F.lead("gen", d) if d > 0 else F.lag("gen", -d)).over(order) for d in steps]
    rows = frames.select(*by, t, "gt", "gen", F.transform("mask", lambda v: v.cast("double") != 0).alias("mask"), F.array(*near).alias("near"))
    keys = [*by, t]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]]
    image = lambda v: np.asarray(v.values if isinstance(v, pa.ListScalar) else v, float).reshape(height, width)

    def run(batches):
        for batch in batches:
            score, valid = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, bool)
            for i, j in _slices(batch.num_rows, height * width):
                masks = dilated(_stack(batch.column("mask").slice(i, j - i), height, width), radius)
                for r in np.flatnonzero(masks.sum((1, 2)) >= least):
                    gt, gen = image(batch.column("gt")[i + r]), image(batch.column("gen")[i + r])
                    grad_gt, grad_gen = gradient(gt), gradient(gen)
                    x = grad_gt if by_gradient else gt
                    best = -np.inf
                    for other in batch.column("near")[i + r].values:
                        if other.is_valid:
                            y = image(other)
                            s = shifted_correlation(x, gradient(y) if by_gradient else y, masks[r], k)
                            best = max(best, np.nanmax(s)) if not np.isnan(s).all() else best
                    if best > -np.inf:
                        valid[i + r], score[i + r] = True, best * presence(grad_gt, grad_gen, masks[r])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(score, mask=~(valid & ~np.isnan(score))), pa.array(valid)], names=[*keys, "score", "valid"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double", "valid boolean"]))


def consistency_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by..., frames, score, coverage): the median score of the valid frames, and their share in percent."""
    return scores.groupBy(*by).agg(F.count("*").alias("frames"), F.median("score").alias("score"), (100 * F.avg(F.col("valid").cast("double"))).alias("coverage"))
