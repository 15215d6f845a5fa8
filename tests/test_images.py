"""Morphology, components and shifted correlation against direct loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import evaluation as E
from tessella.operators import images as I


def direct_components(mask):
    h, w = mask.shape
    out, n = np.zeros(mask.shape, int), 0
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not out[y, x]:
                n += 1
                stack = [(y, x)]
                out[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for d in range(max(0, b - 1), min(w, b + 2)):
                            if mask[c, d] and not out[c, d]:
                                out[c, d] = n
                                stack.append((c, d))
    return out


def direct_erode(mask, r):
    out = mask.copy()
    for y, x in np.argwhere(mask):
        for dy, half in I.disc(r):
            for dx in range(-half, half + 1):
                if 0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1] and not mask[y + dy, x + dx]:
                    out[y, x] = False
    return out


def direct_instances(mask, r):
    seeds = direct_erode(mask, r)
    lab = direct_components(seeds if seeds.any() else mask)
    h, w = mask.shape
    for _ in range(max(h, w)):
        new = lab.copy()
        for y, x in np.argwhere(mask & (lab == 0)):
            new[y, x] = max([lab[a, b] for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < h and 0 <= b < w])
        lab = new
    return lab


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 13), st.integers(1, 13), st.integers(0, 3), st.floats(0.2, 0.95), st.integers(0, 10**6))
def test_instances_of_random_masks(n, h, w, r, p, seed):
    masks = np.random.default_rng(seed).random((n, h, w)) < p
    assert (I.components(masks) == np.stack([direct_components(m) for m in masks])).all()
    assert (I.eroded(masks, r) == np.stack([direct_erode(m, r) for m in masks])).all()
    assert (I.instances(masks, r) == np.stack([direct_instances(m, r) for m in masks])).all()


def test_shapes_that_are_hard_to_label():
    spiral = np.zeros((1, 41, 41), bool)
    y, x, dy, dx, run = 20, 20, 0, 1, 2
    while 0 <= y < 41 and 0 <= x < 41:
        for _ in range(2):
            for _ in range(run):
                if 0 <= y < 41 and 0 <= x < 41:
                    spiral[0, y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        run += 2
    assert I.components(spiral).max() == 1
    comb = np.zeros((1, 30, 61), bool)
    comb[:, :, ::2] = True
    assert I.components(comb).max() == 31
    comb[:, -1] = True
    assert I.components(comb).max() == 1
    two = np.zeros((2, 20, 40), bool)
    two[:, 2:18, 2:18] = two[:, 2:18, 20:36] = two[0, 9, 18:20] = True  # a thin bridge in the first frame
    f, label, area, cx, cy = I.centroids(I.instances(two, 3), 50)
    assert f.tolist() == [0, 0, 1, 1] and label.tolist() == [1, 2, 1, 2] and sum(area[:2]) == 2 * 256 + 2
    assert cx[2:].tolist() == [9.5, 27.5] and cy[2:].tolist() == [9.5, 9.5]
    assert I.components(np.zeros((3, 4, 4), bool)).max() == 0


def direct_correlation(x, y, mask, k, eps=1e-6):
    h, w = x.shape
    out = np.full((2 * k + 1, 2 * k + 1), np.nan)
    for dy in range(-k, k + 1):
        for dx in range(-k, k + 1):
            moved = y[np.clip(np.arange(h) - dy, 0, h - 1)][:, np.clip(np.arange(w) - dx, 0, w - 1)]
            a, b = x[mask] - x[mask].mean(), moved[mask] - moved[mask].mean()
            out[dy + k, dx + k] = (a * b).mean() / (np.sqrt((a * a).mean()) * np.sqrt((b * b).mean()) + eps)
    return out


@pytest.mark.parametrize("seed,h,w,k", [(0, 12, 9, 3), (1, 8, 8, 3), (2, 5, 17, 1), (3, 30, 20, 3), (4, 6, 6, 0)])
def test_correlation_over_the_grid(seed, h, w, k):
    rng = np.random.default_rng(seed)
    x, y, mask = rng.random((h, w)), 5 + rng.random((h, w)), rng.random((h, w)) < 0.6
    assert np.allclose(I.shifted_correlation(x, y, mask, k), direct_correlation(x, y, mask, k), atol=1e-9)
    assert np.isnan(I.shifted_correlation(x, y, np.zeros((h, w), bool), k)).all()
    moved = np.roll(x, (1, 0), (0, 1))
    if k:
        best = np.unravel_index(np.argmax(I.shifted_correlation(x, moved, np.pad(np.ones((h - 4, w - 4), bool), 2), k)), (2 * k + 1,) * 2)
        assert best == (k - 1, k)  # moved back up by one


def test_gradient_of_a_slope():
    assert np.allclose(I.gradient(np.add.outer(3.0 * np.arange(6), 4.0 * np.arange(7)))[1:-1, 1:-1], 8 * 5)


def direct_consistency(gt, gen, masks, k, radius, least):
    for t in range(len(gt)):
        m = I.dilated(masks[t][None], radius)[0]
        best = -np.inf
        if m.sum() >= least:
            for d in (-1, 0, 1):
                if 0 <= t + d < len(gt) and not np.isnan(s := direct_correlation(gt[t], gen[t + d], m, k)).all() and m.sum() >= 10:
                    best = max(best, s.max())
        if best == -np.inf:
            yield None, False
        else:
            yield best * min(1.0, I.gradient(gen[t])[m].mean() / (I.gradient(gt[t])[m].mean() + 1e-6)), True


def test_consistency_of_videos(spark):
    rng, rows, want = np.random.default_rng(6), [], {}
    for v in range(4):
        n = [1, 2, 5, 7][v]
        gt, gen = rng.random((2, n, 10, 12))
        gen = 0.5 * gt + 0.5 * gen
        masks = rng.random((n, 10, 12)) < [0.0, 0.1, 0.3, 0.02][v]
        for t, (s, ok) in enumerate(direct_consistency(gt, gen, masks, 2, 1, 30)):
            want[v, t] = s, ok
            rows.append((v, t, gt[t].ravel().tolist(), gen[t].ravel().tolist(), masks[t].ravel().astype(int).tolist()))
    df = spark.createDataFrame(rows, "v int, t int, gt array<double>, gen array<double>, mask array<int>").repartition(3)
    scores = I.anchored_consistency(df, ["v"], "t", 10, 12, k=2, radius=1, least=30)
    for r in scores.collect():
        s, ok = want[r.v, r.t]
        assert r.valid == ok and (r.score is None if s is None else r.score == pytest.approx(s, rel=1e-8))
    assert {ok for _, ok in want.values()} == {True, False}
    for r in I.consistency_summary(scores, ["v"]).collect():
        own = [x for (v, _), x in want.items() if v == r.v]
        some = [s for s, ok in own if ok]
        assert r.frames == len(own) and r.coverage == pytest.approx(100 * len(some) / len(own))
        assert r.score == (pytest.approx(np.median(some)) if some else None)


def test_mask_rows_without_pixels(spark):
    df = spark.createDataFrame([(1, None), (2, [0, 0, 0, 0]), (3, [1, 0, 0, 1])], "id int, m array<int>")
    got = I.mask_instances(df, ["id"], "m", 2, 2, radius=0, least=1).collect()
    assert [tuple(r) for r in got] == [(3, 1, 2, 0.5, 0.5)]
    with pytest.raises(Exception, match="pixels"):
        I.mask_instances(df, ["id"], "m", 2, 3).collect()


def test_centroid_distance_by_hand(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 0, 10.0, 0.0), (0, 1, 10.0, 3.0), (1, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 0.0, 4.0), (3, 1, 0.0, 1.0)]
    got = {r.f: r.distance for r in E.centroid_distance(spark.createDataFrame(rows, "f int, side int, x double, y double"), ["f"], 7.0).collect()}
    assert got[0] == pytest.approx((3 + 7) / 2) and got[1] == 7 and (got[2] is None or np.isnan(got[2])) and got[3] == 1  # surplus generated points don't count
