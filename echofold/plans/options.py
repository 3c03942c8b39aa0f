"""Options of a mining run, checked when they are made, and the library's errors."""

from __future__ import annotations

from dataclasses import dataclass, fields

from ..kernels.dsp import FPS
from ..kernels.verify import Bounds


class MiningError(Exception):
    """A run that cannot be carried out."""


class NoInputs(MiningError):
    """No input, or none that could be read."""


class BadOptions(MiningError):
    """Options that contradict each other."""


@dataclass(frozen=True)
class Options:
    """Lengths in seconds. Zero stands for the default; union_coverage is checked and has no effect."""

    min_repeat: float = 3.0
    max_repeat: float = 300.0
    min_lag: float = 300.0
    seed: int = 1
    seed_distance: float = 0.45
    sim_high: float = 0.60
    sim_low: float = 0.40
    max_dip: float = 2.0
    union_coverage: float = 0.6
    timeout: float = 900.0
    zone: str = "UTC"
    representatives: bool = True

    def __post_init__(self):
        for f in fields(self):
            if f.name != "representatives" and not getattr(self, f.name):
                object.__setattr__(self, f.name, f.default)
        if self.timeout < 0:
            object.__setattr__(self, "timeout", type(self).timeout)
        wrong = [
            (self.min_lag < 0, "min_lag is negative"),
            (self.min_repeat <= 0 or self.min_repeat >= self.max_repeat, "min_repeat must be positive and below max_repeat"),
            (self.sim_low >= self.sim_high or self.sim_high > 1, "sim_low must be below sim_high, and that at most 1"),
            (not 0 < self.union_coverage <= 1, "union_coverage must lie in (0, 1]"),
            (self.seed_distance <= 0, "seed_distance must be positive"),
        ]
        for bad, why in wrong:
            if bad:
                raise BadOptions(why)

    @property
    def min_len(self) -> int:
        return int(self.min_repeat * FPS) - 5

    def bounds(self, min_lag: float | None = None) -> Bounds:
        lag = self.min_lag if min_lag is None else min_lag
        return Bounds(self.min_len, int(self.max_repeat * FPS), int(lag * FPS), self.seed_distance, self.sim_high, self.sim_low, int(self.max_dip * FPS), self.seed)
