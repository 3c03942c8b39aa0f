"""The global axis of frames, laid over the files of a shared folder.

An Axis is small (one entry a span) and travels to tasks; frames are read by range, file by file, with a
bounded number of files held.
"""

from __future__ import annotations

import bisect
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

from .dsp import BANDS, FPS

HELD_FILES = 48


@dataclass(frozen=True)
class Span:
    """n frames of a file from offset on, at first on the axis; start: microseconds of frame first since 1970."""

    file: str
    offset: int
    first: int
    n: int
    start: int
    path: str
    run: int


@dataclass
class Axis:
    folder: str
    spans: list[Span]
    _held: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __post_init__(self):
        self.firsts = [s.first for s in self.spans]
        self.n = self.spans[-1].first + self.spans[-1].n if self.spans else 0
        self.breaks = np.array([b.first for a, b in zip(self.spans, self.spans[1:], strict=False) if a.run != b.run], np.int64)

    def __getstate__(self):
        return {"folder": self.folder, "spans": self.spans}

    def __setstate__(self, state):
        self.folder, self.spans, self._held = state["folder"], state["spans"], OrderedDict()
        self.__post_init__()

    def span(self, frame: int) -> Span:
        """The span that holds a frame; the last one beyond the end."""
        return self.spans[max(0, bisect.bisect_right(self.firsts, frame) - 1)]

    def run(self, frame) -> np.ndarray:
        """How many breaks lie at or before each frame; equal numbers: none between."""
        return np.searchsorted(self.breaks, frame, "right")

    def time(self, frame: int) -> int:
        """Microseconds since 1970."""
        s = self.span(frame)
        return s.start + (frame - s.first) * 1_000_000 // FPS

    def file(self, name: str) -> np.ndarray:
        if name not in self._held:
            fs, root = pafs.FileSystem.from_uri(self.folder)
            with fs.open_input_file(f"{root}/{name}") as f:
                self._held[name] = np.frombuffer(f.read(), np.int8).reshape(-1, BANDS)
            while len(self._held) > HELD_FILES:
                self._held.popitem(last=False)
        self._held.move_to_end(name)
        return self._held[name]

    def frames(self, low: int, high: int) -> np.ndarray:
        """Frames [low, high) of the axis."""
        out, at = [], low
        while at < high:
            s = self.span(at)
            end = min(high, s.first + s.n)
            if end <= at:
                break
            data = self.file(s.file)
            out.append(data[s.offset + at - s.first : s.offset + end - s.first])
            at = end
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros((0, BANDS), np.int8)

    def cosines(self, a: int, b: int, n: int) -> np.ndarray:
        """Cosine of the n frames from a with those from b, one by one; 0 where either is silent."""
        x, y = self.frames(a, a + n).astype(np.float32), self.frames(b, b + n).astype(np.float32)
        dot = np.einsum("ij,ij->i", x, y)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0).astype(np.float64)

    def excerpts(self, pieces: list[tuple[int, int]]) -> "Axis":
        """An axis of stretches [low, high) of this one, a break before each."""
        spans, at = [], 0
        for k, (low, high) in enumerate(pieces):
            f = low
            while f < high:
                s = self.span(f)
                end = min(high, s.first + s.n)
                spans.append(Span(s.file, s.offset + f - s.first, at, end - f, self.time(f), s.path, k))
                at += end - f
                f = end
        return Axis(self.folder, spans)
