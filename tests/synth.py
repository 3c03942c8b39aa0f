"""Generated broadcasts with known repeats: seeded voices and jingles, written as mono WAV at 8 kHz."""

from __future__ import annotations

import datetime as dt
import wave
from pathlib import Path

import numpy as np

RATE = 8000
BASE = dt.datetime(2026, 9, 1, 8, 0, 0, tzinfo=dt.timezone.utc)


def sound(seed: int, seconds: float) -> np.ndarray:
    """Syllables of a few random partials each, with noise: no two seeds are alike."""
    rng = np.random.default_rng(seed)
    n = int(seconds * RATE)
    out, at = np.zeros(n), 0
    while at < n:
        size = min(n - at, int(rng.uniform(0.08, 0.35) * RATE))
        t = np.arange(size) / RATE
        x = sum(rng.uniform(0.2, 1) * np.sin(2 * np.pi * f * t * (1 + rng.uniform(-0.1, 0.1) * t) + rng.uniform(0, 6)) for f in rng.uniform(120, 3600, rng.integers(2, 6)))
        out[at : at + size] = x * np.hanning(size) ** 0.3 * rng.uniform(0.3, 1)
        at += size
    return 0.2 * out / np.abs(out).max() + 0.002 * rng.normal(size=n)


def broadcast(seed: int, seconds: float, airings: list[tuple[int, float, float, float]]) -> np.ndarray:
    """Programme with airings (repeat's seed, its length, start, gain in dB) laid over it."""
    out = sound(seed * 7919, seconds)
    for repeat, length, start, gain in airings:
        x = sound(repeat, length)
        a = int(start * RATE)
        out[a : a + len(x)] = x[: len(out) - a] * 10 ** (gain / 20)
    return out


def write(folder: Path, samples: np.ndarray, minutes: float, base: dt.datetime = BASE) -> list[Path]:
    """Consecutive WAV files named by their start."""
    size, out = int(minutes * 60 * RATE), []
    for k in range(0, len(samples), size):
        start = base + dt.timedelta(seconds=k / RATE)
        path = folder / f"{start:%Y-%m-%d_%H-%M-%S}.{start.microsecond // 1000:03d}_test.wav"
        with wave.open(str(path), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes((np.clip(samples[k : k + size], -1, 1) * 32767).astype("<i2").tobytes())
        out.append(path)
    return out


def seconds(us: int) -> float:
    return us / 1e6 - BASE.timestamp()
