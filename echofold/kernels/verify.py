"""Checking a seed frame by frame: best lag, growth both ways, and the gate that skips what is known."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import descriptor as ds
from .axis import Axis

# Fixed values.
SCORE = 10
SHORT_SIM = 0.70
PER_FRAME = 6
CHUNK = 72_000
REACH = ds.STEP // 2 + 1
STRIDE = 256


@dataclass(frozen=True)
class Bounds:
    """Limits of a search, in frames."""

    min_len: int
    max_len: int
    min_lag: int
    seed_distance: float
    high: float
    low: float
    max_dip: int
    seed: int


def refined(axis: Axis, a: int, b: int, high: float) -> int | None:
    """The lag near a - b under which the seed's second agrees best; None below the bar. Ties: the smallest."""
    best, at = -2.0, None
    for lag in range(a - b - REACH, a - b + REACH + 1):
        if lag > 0 and 0 <= a - lag and a + ds.WINDOW <= axis.n and a - lag + ds.WINDOW <= axis.n:
            s = float(axis.cosines(a, a - lag, ds.WINDOW).mean())
            if s > best:
                best, at = s, lag
    return at if best >= high else None


def grown(axis: Axis, start: int, lag: int, way: int, ring: np.ndarray, limits: Bounds) -> int:
    """The last frame from start on, in direction way (+1, -1), at which the trailing mean of ten cosines agreed.

    Growth ends where the mean falls under the lower bar, after a dip longer than allowed, at an end of the
    axis, and where either stream would step over a break.
    """
    last = start - way
    dip, trail = 0, list(ring)
    at = start
    run_a, run_b = axis.run(start - way), axis.run(start - way - lag)
    while True:
        if way > 0:
            n = min(STRIDE, axis.n - at)
            lo = at
        else:
            n = min(STRIDE, at - lag + 1)
            lo = at - n + 1
        if n <= 0:
            return last
        c = axis.cosines(lo, lo - lag, n)
        frames = np.arange(lo, lo + n)
        whole = (axis.run(frames) == run_a) & (axis.run(frames - lag) == run_b)
        if way < 0:
            c, whole = c[::-1], whole[::-1]
        total = np.cumsum(np.concatenate([trail, c]))
        mean = (total[SCORE:] - np.concatenate([[0], total])[1 : n + 1]) / SCORE
        for k in range(n):
            if not whole[k]:
                return last
            if mean[k] >= limits.high:
                last, dip = at + way * k, 0
            else:
                dip += 1
                if mean[k] < limits.low or dip > limits.max_dip:
                    return last
        trail = list(np.concatenate([trail, c])[-SCORE:])
        at += way * n


def verified(axis: Axis, a: int, b: int, limits: Bounds) -> tuple[int, int, int, float] | None:
    """(start, end, lag, mean cosine) of the match around a seed, or None."""
    lag = refined(axis, a, b, limits.high)
    if lag is None:
        return None
    seed = axis.cosines(a, a - lag, ds.WINDOW)
    left = grown(axis, a - 1, lag, -1, seed[:SCORE][::-1], limits)
    right = grown(axis, a + ds.WINDOW, lag, 1, seed[-SCORE:], limits)
    start, end = left, right + 1
    if end - start < limits.min_len:
        return None
    if end - start > limits.max_len:
        start, end = max(start, a - limits.max_len // 2), min(end, a + limits.max_len // 2)
    sim = float(axis.cosines(start, start - lag, end - start).mean())
    if end - start < 2 * limits.min_len and sim < SHORT_SIM:
        return None
    return start, end, lag, sim


class Gate:
    """What a chunk has confirmed: matches per frame, and intervals per lag (in tenths)."""

    def __init__(self, low: int, n: int):
        self.low, self.count, self.known = low, np.zeros(n, np.int16), {}

    @staticmethod
    def key(lag: int) -> int:
        return (lag + 5) // 10

    def covers(self, q: int, lag: int) -> bool:
        if self.count[q - self.low] >= PER_FRAME:
            return True
        k = self.key(lag)
        return any(s <= q < e for x in (k - 1, k, k + 1) for s, e in self.known.get(x, ()))

    def add(self, start: int, end: int, lag: int) -> None:
        a, b = max(0, start - self.low), min(len(self.count), end - self.low)
        self.count[a:b] = np.minimum(self.count[a:b] + 1, 255)
        self.known.setdefault(self.key(lag), []).append((start, end))


def near(axis: Axis, q: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which candidates (windows at q and b) have descriptors within the seed distance."""
    if not len(q):
        return np.zeros(0, bool)
    kept: dict[int, np.ndarray] = {}
    for f in np.unique(np.concatenate([q, b]) // 1000):
        low = int(f) * 1000
        kept[int(f)] = ds.descriptors(axis.frames(low, min(axis.n, low + 1000 + ds.WINDOW - 1)))
    at = lambda x: np.stack([kept[i // 1000][i % 1000] for i in x.tolist()])
    out = np.zeros(len(q), bool)
    for k in range(0, len(q), 50_000):
        s = slice(k, k + 50_000)
        out[s] = ds.distance(at(q[s]), ds.quantised(at(b[s]))) <= limit
    return out


def searched(axis: Axis, chunk: int, q: np.ndarray, b: np.ndarray, limits: Bounds) -> tuple[list[tuple[int, int, int, float]], int, int]:
    """Matches of a chunk's candidates, in order of (q, b), each seed that the gate covers skipped; seeds and verifications."""
    ok = near(axis, q, b, limits.seed_distance)
    gate = Gate(chunk * CHUNK, CHUNK)
    out, tried = [], 0
    for x, y in zip(q[ok].tolist(), b[ok].tolist(), strict=True):
        if not gate.covers(x, x - y):
            tried += 1
            m = verified(axis, x, y, limits)
            if m:
                gate.add(m[0], m[1], m[2])
                out.append(m)
    return out, int(ok.sum()), tried
