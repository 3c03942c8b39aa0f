"""Window descriptors and their hashes: a 4 x 8 cosine transform of a second, sign bits against random planes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .dsp import BANDS, int8

# Fixed values.
WINDOW, STEP = 20, 10
TIME, FREQ = 4, 8
DIM = TIME * FREQ
TABLES, BITS, MAX_BUCKET = 8, 20, 256
SCALE = 127


def basis(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(k))


@lru_cache(maxsize=4)
def planes(seed: int) -> np.ndarray:
    """Random directions (tables, bits, dimensions)."""
    return np.random.default_rng(seed).normal(size=(TABLES, BITS, DIM)).astype(np.float32)


def descriptors(frames: np.ndarray) -> np.ndarray:
    """Unit descriptors (float32) of the windows that begin at each frame but the last 19; silence gives zeros."""
    if len(frames) < WINDOW:
        return np.zeros((0, DIM), np.float32)
    rows = frames.astype(np.float64) @ basis(BANDS, FREQ)
    windows = np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=0)
    d = np.einsum("nfw,wt->ntf", windows, basis(WINDOW, TIME)).reshape(len(windows), DIM)
    norm = np.sqrt((d * d).sum(1, keepdims=True))
    return np.divide(d, norm, out=np.zeros_like(d), where=norm > 0).astype(np.float32)


def hashes(d: np.ndarray, seed: int) -> np.ndarray:
    """(n, tables): bit b is set where the product with plane b is not negative."""
    bits = np.einsum("nd,tbd->ntb", d, planes(seed), optimize=True) >= 0
    return (bits * (1 << np.arange(BITS))).sum(2).astype(np.int32)


def quantised(d: np.ndarray) -> np.ndarray:
    return int8(d.astype(np.float64) * SCALE)


def distance(d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of descriptors and quantised ones, row by row."""
    x = d.astype(np.float64) - q / SCALE
    return np.sqrt((x * x).sum(-1))
