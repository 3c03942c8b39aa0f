import math

import numpy as np
import pytest

from echofold.kernels import descriptor as ds
from echofold.kernels import dsp
from echofold.kernels.axis import Axis, Span
from echofold.plans.mine import lay
from echofold.plans.options import BadOptions, Options
from echofold.sources.audio import Resampler


def test_mel_covers_its_range():
    m = dsp.mel()
    f = np.arange(m.shape[1]) * dsp.RATE / dsp.SIZE
    assert m.shape == (32, 257) and (m.sum(1) > 0).all()
    assert (m[:, (f > 200) & (f < 3600)].sum(0) > 0).all() and not m[:, f < 100].any()


def test_power_is_a_dft():
    x = np.sin(0.37 * np.arange(512)) + 0.5 * np.cos(1.9 * np.arange(512))
    w = x * dsp.hann()
    dft = np.array([abs(sum(w * np.exp(-2j * math.pi * k * np.arange(512) / 512))) ** 2 for k in range(257)])
    assert np.allclose(dsp.powers(x)[0], dft @ dsp.mel().T)


def test_mean_removal_kills_constants():
    b = np.arange(32)
    frames = np.tile(20 + (b % 3) * 10, (200, 1))
    frames[:, 5] += np.arange(200) % 7
    out = dsp.without_mean(frames.astype(np.int8))
    assert not np.delete(out[15:185], 5, axis=1).any() and out[15:185, 5].any()


def test_halves_round_away():
    assert dsp.half_away(np.array([0.5, -0.5, 1.5, 2.4, -2.5])).tolist() == [1, -1, 2, 2, -3]


def test_stream_equals_whole_and_counts_frames():
    x = np.random.default_rng(0).normal(size=8000 * 40) * 0.1
    s = dsp.Stream()
    for k in range(0, len(x), 7777):
        s.feed(x[k : k + 7777])
    whole = dsp.features(x)
    assert (s.frames() == whole).all() and len(whole) == (len(x) - 512) // 400 + 1 - 9
    assert len(dsp.features(x[:100])) == 0


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 44100, 48000])
def test_resampling(rate):
    t = np.arange(rate * 2) / rate
    r = Resampler(rate)
    x = np.sin(2 * np.pi * 440 * t)
    y = np.concatenate([*[r.feed(x[k : k + 5001]) for k in range(0, len(x), 5001)], r.feed(np.zeros(0), True)])
    assert len(y) == 16000
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16000) / 8000))[200:-200].max() < 1e-3


def test_descriptors_and_hashes():
    f = np.random.default_rng(1).integers(-50, 50, (60, 32)).astype(np.int8)
    d = ds.descriptors(f)
    slow = []
    for at in range(41):
        row = [sum(float(f[at + n, m]) * math.cos(math.pi / 32 * (m + 0.5) * kf) * math.cos(math.pi / 20 * (n + 0.5) * kt) for n in range(20) for m in range(32)) for kt in range(4) for kf in range(8)]
        slow.append(np.array(row) / math.sqrt(sum(v * v for v in row)))
    assert np.allclose(d, slow, atol=1e-5)
    h = ds.hashes(d, 1)
    bits = (np.einsum("d,tbd->tb", d[3], ds.planes(1)) >= 0).astype(int)
    assert h[3].tolist() == [sum(int(x) << b for b, x in enumerate(t)) for t in bits]
    assert ds.distance(d, ds.quantised(d)).max() < 0.05
    silent = ds.descriptors(np.zeros((20, 32), np.int8))
    assert not silent.any() and set(ds.hashes(silent, 1)[0].tolist()) == {(1 << 20) - 1}


HOUR = 3_600_000_000


def files(*parts):
    return [{"path": f"p{k}", "start_us": int(s), "file": f"f{k}", "n": n} for k, (s, n) in enumerate(parts)]


def test_axis_gaps():
    axis = lay("", files((0, 72000), (HOUR, 72000), (3 * HOUR, 72000), (4 * HOUR + 500_000, 72000)))
    assert axis.n == 4 * 72000 and axis.breaks.tolist() == [144000]
    assert axis.run(143999) == 0 and axis.run(144000) == 1
    assert axis.span(3 * 72000 + 200).path == "p3" and axis.time(3 * 72000 + 200) == 4 * HOUR + 500_000 + 10_000_000
    assert axis.span(10**9).path == "p3"


def test_axis_overlap_is_dropped():
    axis = lay("", files((0, 3660 * 20), (HOUR, 3660 * 20)))
    assert axis.n == (3600 + 3660) * 20 and not len(axis.breaks)
    assert axis.span(3600 * 20 + 5).path == "p1" and axis.time(3600 * 20 + 5) == HOUR + 250_000


def test_excerpts_have_breaks():
    axis = Axis("", [Span("f0", 0, 0, 100, 0, "p0", 0), Span("f1", 0, 100, 100, 5_000_000, "p1", 0)])
    e = axis.excerpts([(90, 110), (10, 20)])
    assert [(s.file, s.offset, s.first, s.n, s.run) for s in e.spans] == [("f0", 90, 0, 10, 0), ("f1", 0, 10, 10, 0), ("f0", 10, 20, 10, 1)]
    assert e.breaks.tolist() == [20]


@pytest.mark.parametrize("wrong", [{"min_repeat": 400}, {"sim_high": 0.3, "sim_low": 0.5}, {"min_lag": -1}, {"sim_high": 1.5}, {"union_coverage": 1.5}])
def test_options(wrong):
    with pytest.raises(BadOptions):
        Options(**wrong)
    assert Options().min_len == 55 and Options().bounds(0).min_lag == 0
    assert Options(min_lag=0, seed=0, union_coverage=0) == Options()
