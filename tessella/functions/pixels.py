"""Pixel operations on flattened images, a batch at a time."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def normalize(x: np.ndarray, mean: float = 0.5, std: float = 0.5) -> np.ndarray:
    return (x / 255.0 - mean) / std


def flip(x: np.ndarray) -> np.ndarray:
    return x[:, ::-1]


def crop(x: np.ndarray, share: float) -> np.ndarray:
    """The centre, ``share`` of each side."""
    h, w = int(x.shape[0] * share), int(x.shape[1] * share)
    a, b = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
    return x[a : a + h, b : b + w]


def grey(x: np.ndarray) -> np.ndarray:
    """Luma of the last axis (red, green, blue), kept in three channels."""
    y = x @ np.array([0.299, 0.587, 0.114])
    return np.repeat(y[..., None], 3, -1)


def posterize(x: np.ndarray, bits: int) -> np.ndarray:
    return x.astype(np.uint8) & np.uint8(256 - (1 << (8 - bits)))


def jitter(x: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    return np.clip((x - x.mean()) * contrast + x.mean() + 255 * (brightness - 1), 0, 255)


def reflect_pad(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Centred in height x width; mirrored where the margin is smaller than the image, else its edge goes on."""
    a, b = height - x.shape[0], width - x.shape[1]
    pads = [(a // 2, a - a // 2), (b // 2, b - b // 2)] + [(0, 0)] * (x.ndim - 2)
    small = max(pads[0]) < x.shape[0] and max(pads[1]) < x.shape[1]
    return np.pad(x, pads, "reflect" if small else "edge")


def per_image(f, shape: tuple[int, ...], **args):
    """A vectorized function over flattened images of one shape."""

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda v: None if v is None else np.asarray(f(np.asarray(v, float).reshape(shape), **args), float).ravel())

    return run


def best_correlation(a: np.ndarray, b: np.ndarray, mask: np.ndarray, reach: int = 3, eps: float = 1e-8) -> float:
    """Highest zero-mean normalized correlation over the mask when b is shifted by up to ``reach`` pixels; NaN if the
    mask is empty."""
    if not mask.any():
        return float("nan")
    best = -1.0
    x = a[mask] - a[mask].mean()
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            y = np.roll(b, (dy, dx), (0, 1))[mask]
            y = y - y.mean()
            best = max(best, float((x * y).sum() / (np.sqrt((x * x).sum() * (y * y).sum()) + eps)))
    return best


def load_npz(raw: bytes, name: str) -> np.ndarray:
    """One array of an npz archive; archives with pickled objects are refused."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return z[name]


def filled_depth(x: np.ndarray) -> np.ndarray:
    """NaN depths become the largest depth."""
    return np.where(np.isnan(x), np.nanmax(x) if np.isfinite(x).any() else 0.0, x)
