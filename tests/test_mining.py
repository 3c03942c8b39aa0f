"""Whole runs over generated broadcasts."""

import json
import os

import numpy as np
import pytest
import synth
from pyspark.sql import functions as F

from echofold import cli
from echofold.operators.search import find_matches
from echofold.plans import evaluate, report
from echofold.plans.mine import STAGES, mine
from echofold.plans.options import NoInputs, Options
from echofold.sources import audio, results
from echofold.streaming import live

SPOTS = [(101, 20, 30, 0), (102, 12, 70, 0), (101, 20, 130, -6), (102, 12, 200, 3), (101, 20, 260, 2), (103, 30, 300, 0), (102, 12, 350, 0), (103, 30, 420, -3)]
OPTIONS = Options(min_lag=30)


def found(mined):
    """{cluster: sorted [(start, end)]} in seconds from the base."""
    out = {}
    for r in mined.occurrences.collect():
        out.setdefault(r.cluster_id, []).append((synth.seconds(r.start_us), synth.seconds(r.end_us)))
    return {k: sorted(v) for k, v in out.items()}


def agrees(got, starts, length, slack=0.8):
    return len(got) == len(starts) and all(abs(a - s) < slack and abs(b - s - length) < slack for (a, b), s in zip(got, sorted(starts), strict=True))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("radio")
    synth.write(d, synth.broadcast(1, 480, SPOTS), 4)
    (d / "notes.txt").write_text("x")
    (d / "unstamped.wav").write_text("x")
    (d / "2026-09-01_09-00-00_bad.wav").write_text("junk")
    (d / ".hidden").mkdir()
    return d


@pytest.fixture(scope="module")
def run(spark, folder):
    good, bad = audio.scan(spark, str(folder))
    assert [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == ["unstamped.wav"]
    seen = []
    out = mine(spark, good, OPTIONS, lambda *x: seen.append(x))
    assert [s for s, *_ in seen] == list(STAGES) and seen[-1][1:] == (len(STAGES), len(STAGES))
    return out


def test_every_repeat_is_one_cluster(run):
    got = found(run)
    assert len(got) == 3 and run.stats["files"] == 2
    assert run.stats["seeds"] >= run.stats["verified"] >= run.stats["matches"] > 0
    assert agrees(got[1], [30, 130, 260], 20) and agrees(got[2], [70, 200, 350], 12) and agrees(got[3], [300, 420], 30)
    assert [r.is_spot for r in run.clusters.orderBy("cluster_id").collect()] == [True] * 3
    assert [r.path.rsplit("/", 1)[-1] for r in run.skipped.collect()] == ["2026-09-01_09-00-00_bad.wav"]


def test_partitions_do_not_matter(spark, run):
    want = sorted(map(tuple, run.matches.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, find_matches(spark, run.axis, OPTIONS.bounds()).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sinks_and_evaluation(spark, run, tmp_path):
    cuts = {r.cluster_id: r.file for r in report.representatives(run, f"{tmp_path}/cuts").collect() if not r.error}
    assert len(cuts) == 3 and audio.probe(cuts[1])["rate"] == 8000
    report.as_json(run, f"{tmp_path}/clusters.json", cuts)
    whole = json.loads((tmp_path / "clusters.json").read_text())
    assert [c["ID"] for c in whole["Clusters"]] == [1, 2, 3] and len(whole["Clusters"][0]["Occurrences"]) == 3
    text = report.report(run)
    assert text.count("cluster ") == 3 and "airings alone" in text
    assert "3 clusters, 3 spots with 8 airings" in report.summary(run)
    report.tables(run, f"{tmp_path}/tables")
    report.dump_matches(run, f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == run.stats["matches"]

    lists = tmp_path / "lists"
    lists.mkdir()
    head = "id\tresult_id\tname\tdur\trecord_path\tstart_time\tend_time\n"
    stamp = "rec/2026-09-01_08-00-00_x.mp3"
    for k, (name, seed) in enumerate([("one", 101), ("two", 102), ("three", 103), ("none", 0)]):
        rows = [(s, n) for r, n, s, _ in SPOTS if r == seed] or [(10, 15)]
        (lists / f"{k + 1}.tsv").write_text(head + "".join(f"{i}\t{10 * k + i}\t{name}\t{n}\t{stamp}\t{s}\t{s + n}\n" for i, (s, n) in enumerate(rows)))
    listed, mined = results.listed(spark, str(lists)), results.result(spark, f"{tmp_path}/clusters.json")
    rows = evaluate.covered(listed, mined)
    t = evaluate.totals(rows).first()
    assert (t.listed, t.covered, t.partial, t.flagged) == (9, 8, 0, 8)
    assert {(r.name, r.clusters) for r in evaluate.fragmentation(rows).collect()} == {("one", 1), ("two", 1), ("three", 1)}
    verdicts = evaluate.verdicts(listed, mined)
    assert {r.name: r.share for r in evaluate.per_file(verdicts).collect()} == {"one": 1.0, "two": 1.0, "three": 1.0, "none": 0.0}
    assert {r.level: r.files for r in evaluate.levels(evaluate.per_file(verdicts)).collect()} == {100: 3, 95: 3, 90: 3, 80: 3, 50: 3}
    assert evaluate.profile(rows, "two").first().n == 3
    assert evaluate.per_day(mined).first().airings == 8
    assert sum(r.n for r in evaluate.histogram(run.clusters, "duration", [0, 8, 15, 25]).collect()) == 3
    assert evaluate.reasons(mined).first().reason == "Ns, all N airings alone"
    evaluate.write_report(verdicts, f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report/missed").count() == 1


def test_pairs_and_gaps(spark, tmp_path):
    """Two spots back to back four times, one of them also alone; an outage parts the files."""
    airs = [(201, 15, s, 0) for s in (20, 120, 220, 320)] + [(202, 18, s + 15, 0) for s in (20, 120, 220, 320)] + [(202, 18, s, 0) for s in (70, 170, 270)]
    synth.write(tmp_path, synth.broadcast(5, 400, airs), 10)
    good, _ = audio.scan(spark, str(tmp_path))
    got = found(mine(spark, good, OPTIONS))
    assert any(agrees(v, [s + 15 for s in (20, 120, 220, 320)] + [70, 170, 270], 18) for v in got.values())
    assert any(agrees(v, [20, 120, 220, 320], 15) for v in got.values())
    assert len(got) == 2


def test_nothing_readable(spark, folder):
    bad = spark.createDataFrame([(f"file:{folder}/2026-09-01_09-00-00_bad.wav",)], "path string").withColumn("start", F.timestamp_seconds(F.lit(0)))
    with pytest.raises(NoInputs):
        mine(spark, bad, OPTIONS)


def test_names_and_manifest(spark, tmp_path):
    for n in ("2026-08-30_15-00-00.836_rec.mp3", "2026-08-30-14-00-00_106fm_merged.flac", "2026-08-30-16-00-00.mp3", "notes.txt", "unstamped.mp3", "_2026.ogg", "2026-08-30-17-00-00", "2026-08-30-17-00-00.a.b.mp3", "2026-08-30-17-00-00x.mp3"):
        (tmp_path / n).write_text("")
    good, bad = audio.scan(spark, str(tmp_path))
    rows = good.select(F.unix_micros("start").alias("u")).collect()
    assert len(rows) == 3 and rows == sorted(rows) and rows[1].u % 1_000_000 == 836_000
    assert sorted(r.path.rsplit("/", 1)[-1] for r in bad.collect()) == ["2026-08-30-17-00-00.a.b.mp3", "2026-08-30-17-00-00x.mp3", "_2026.ogg", "unstamped.mp3"]
    times = ["2026-08-30T15:00:00Z", "2026-08-30T15:00:00.5+02:00", "2026-08-30 15:00:01", "2026-08-30T15:00:02", "2026-08-30-15-00-03"]
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"path": f"f{k}.wav", "start": t} for k, t in enumerate(times)]}))
    got = audio.manifest(spark, f"{tmp_path}/m.json").select("path", F.unix_micros("start").alias("u")).collect()
    base = 1_788_102_000_000_000
    assert [(r.path.rsplit("/", 1)[-1], r.u - base) for r in got] == [("f1.wav", -7_199_500_000), ("f0.wav", 0), ("f2.wav", 1_000_000), ("f3.wav", 2_000_000), ("f4.wav", 3_000_000)]
    (tmp_path / "bad.json").write_text(json.dumps({"files": [{"path": "a.wav", "start": "noon"}]}))
    with pytest.raises(Exception, match="manifest entry 0"):
        audio.manifest(spark, f"{tmp_path}/bad.json").collect()


def test_arrivals(spark, folder, tmp_path):
    stream = live.decode_arrivals(live.arrivals(spark, str(folder)), f"file://{tmp_path}/frames", f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert stream.awaitTermination(120)
    axis = live.axis_so_far(spark, f"file://{tmp_path}/frames", f"{tmp_path}/table")
    assert len(axis.spans) == 2 and axis.frames(0, 5).shape == (5, 32)


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "a" if m % 2 else "b") for h in range(4) for m in range(0, 60, 7)]
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, k string").json(f"{tmp_path}/in")
    for name, df in {"tumbling": live.coverage(source, "ts", F.col("k")), "sessions": live.sessions(source, "ts", F.col("k")), "once": live.once(source, "ts", ["k"])}.items():
        q = df.writeStream.format("memory").queryName(f"live_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        assert q.awaitTermination(120)
    assert sum(r.n for r in spark.table("live_tumbling").collect()) == 27
    assert spark.table("live_once").count() == 2


def test_command_line():
    a = cli.parser().parse_args(["mine", "--in", "x", "--out", "y", "--min-lag", "30"])
    assert a.min_lag == 30 and a.tz == "UTC"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["mine", "--in", "x", "--manifest", "m", "--out", "y"])


def test_shared_tail_and_song(spark, tmp_path):
    """Two spots that both end in one jingle, and a song that airs three times."""
    places = [15, 75, 135, 195]
    airs = [a for k, s in enumerate(places) for a in ((301 + k % 2, 15, s, 0), (310, 3, s + 15, 0))]
    airs += [(320, 130, s, 0) for s in (260, 420, 580)]
    synth.write(tmp_path, synth.broadcast(9, 720, airs), 12)
    good, _ = audio.scan(spark, str(tmp_path))
    mined = mine(spark, good, OPTIONS)
    spot = {r.cluster_id: r.is_spot for r in mined.clusters.collect()}
    got = found(mined)
    assert any(agrees(v, [15, 135], 18) and spot[k] for k, v in got.items())
    assert any(agrees(v, [75, 195], 18) and spot[k] for k, v in got.items())
    assert any(agrees(v, [260, 420, 580], 130) and not spot[k] for k, v in got.items())
    assert len(got) == 3


def test_gain_and_trim(spark, tmp_path):
    airs = [(401, 20, 20 + 55 * k, g) for k, g in enumerate((0, -18, 4, -12, -6, 2))]
    synth.write(tmp_path, synth.broadcast(11, 360, airs), 10)
    good, _ = audio.scan(spark, str(tmp_path))
    got = found(mine(spark, good, OPTIONS))
    assert len(got) == 1 and agrees(got[1], [20 + 55 * k for k in range(6)], 20, 1.0)


FAKE = """#!/usr/bin/env python3
import sys
a = sys.argv
data = sys.stdin.buffer.read() if "pipe:0" in a else open(a[a.index("-i") + 1], "rb").read()
if data == b"bad":
    sys.exit("not audio")
if "-ss" in a:
    low, n, rate = float(a[a.index("-ss") + 1]), float(a[a.index("-t") + 1]), int(a[a.index("-ar") + 1])
    data = data[int(low * rate) * 4 :][: int(n * rate) * 4]
sys.stdout.buffer.write(data)
"""


def test_tool_reads_what_is_not_local(tmp_path, monkeypatch):
    """The tool gets a local file's name, and any other file as a stream."""
    tool = tmp_path / "bin" / "ffmpeg"
    tool.parent.mkdir()
    tool.write_text(FAKE)
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tool.parent}:{os.environ['PATH']}")
    samples = np.arange(-40_000, 40_000, 2, dtype="<i4").clip(-32768, 32767).astype("<i2")
    (tmp_path / "x.mp3").write_bytes(samples.tobytes() * 40)
    (tmp_path / "y.mp3").write_bytes(b"bad")
    for hidden in (False, True):
        if hidden:
            monkeypatch.setattr(audio, "local_path", lambda path: None)
        got = np.concatenate(list(audio.tool_pieces(f"file://{tmp_path}/x.mp3", 60)))
        assert len(got) == 40 * len(samples) and np.allclose(got[: len(samples)] * 32768, samples)
        params, data = audio.cut(f"file://{tmp_path}/x.mp3", 1.0, 2.0, 60)
        assert (params.nchannels, params.framerate, len(data)) == (2, audio.CUT_RATE, 4 * 2 * audio.CUT_RATE)
        with pytest.raises(RuntimeError, match="not audio"):
            list(audio.tool_pieces(f"file://{tmp_path}/y.mp3", 60))
