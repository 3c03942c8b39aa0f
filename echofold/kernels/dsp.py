"""Spectral features of audio: 32 mel bands at 20 frames a second, as small integers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values.
RATE, SIZE, HOP, SMOOTH = 8000, 512, 400, 10
FPS, BANDS = 20, 32
LOW_HZ, HIGH_HZ = 100.0, 3800.0
STEP_DB, FLOOR_DB, EPSILON = 0.5, -80.0, 1e-3
HALF_MEAN = 15


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    return np.trunc(x + np.copysign(0.5, x))


def int8(x: np.ndarray) -> np.ndarray:
    return np.clip(half_away(x), -127, 127).astype(np.int8)


@lru_cache(maxsize=1)
def hann() -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / (SIZE - 1))


@lru_cache(maxsize=1)
def mel() -> np.ndarray:
    """Triangular filters (bands, bins), evenly spaced in mel."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(LOW_HZ), to_mel(HIGH_HZ), BANDS + 2) / 2595) - 1)
    f = np.arange(SIZE // 2 + 1) * RATE / SIZE
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)


def powers(samples: np.ndarray) -> np.ndarray:
    """Mel powers (transforms, bands) of samples in [-1, 1]."""
    if len(samples) < SIZE:
        return np.zeros((0, BANDS))
    windows = np.lib.stride_tricks.sliding_window_view(samples, SIZE)[::HOP]
    out = [np.abs(np.fft.rfft(windows[k : k + 4096] * hann(), axis=1)) ** 2 @ mel().T for k in range(0, len(windows), 4096)]
    return np.concatenate(out)


def raw_frames(power: np.ndarray) -> np.ndarray:
    """Frames (n, bands): dB of ten transforms' mean, less the mean over the bands, in half dB."""
    if len(power) < SMOOTH:
        return np.zeros((0, BANDS), np.int8)
    mean = np.lib.stride_tricks.sliding_window_view(power, SMOOTH, axis=0).sum(-1) / SMOOTH
    db = np.maximum(10 * np.log10(mean + EPSILON), FLOOR_DB)
    return int8((db - db.mean(1, keepdims=True)) / STEP_DB)


def without_mean(frames: np.ndarray) -> np.ndarray:
    """Each band less its running mean over 15 frames to either side, shorter at the ends."""
    n = len(frames)
    if not n:
        return frames
    total = np.concatenate([np.zeros((1, BANDS), np.int64), np.cumsum(frames, axis=0, dtype=np.int64)])
    at = np.arange(n)
    low, high = np.maximum(at - HALF_MEAN, 0), np.minimum(at + HALF_MEAN + 1, n)
    return int8(frames - (total[high] - total[low]) / (high - low)[:, None])


def features(samples: np.ndarray) -> np.ndarray:
    """Frames of one file: int8 (n, bands)."""
    return without_mean(raw_frames(powers(samples)))


class Stream:
    """Frames of a file fed in pieces: the tail of one piece is kept for the next; memory does not grow with the sound."""

    def __init__(self):
        self.samples, self.power, self.out = np.zeros(0), np.zeros((0, BANDS)), []

    def feed(self, samples: np.ndarray) -> None:
        self.samples = np.concatenate([self.samples, samples])
        n = max(0, (len(self.samples) - SIZE) // HOP + 1)
        if n:
            self.power = np.concatenate([self.power, powers(self.samples[: (n - 1) * HOP + SIZE])])
            self.samples = self.samples[n * HOP :]
            self.out.append(raw_frames(self.power))
            self.power = self.power[max(0, len(self.power) - SMOOTH + 1) :] if len(self.power) >= SMOOTH else self.power

    def frames(self) -> np.ndarray:
        return without_mean(np.concatenate(self.out)) if self.out else np.zeros((0, BANDS), np.int8)
