"""Sinks: tables, result JSON, text reports, match dump, representative cuts."""

from __future__ import annotations

import datetime as dt
import json
import resource
import wave
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audio import cut
from .mine import Mined

REASONS = {
    "long unit": "{duration:.1f}s, one of {pieces} pieces that air as a unit of {unit:.0f}s, too long for a spot",
    "short": "{duration:.1f}s, too short for a spot",
    "long": "{duration:.1f}s, too long for a spot",
    "hourly": "airs {top} of {n} times at one minute of the hour",
    "accompanied": "{duration:.1f}s, {n_beside} of {n} airings beside others",
    "alone": "{duration:.1f}s, all {n} airings alone",
}


def stamp(us: int) -> str:
    """RFC 3339 in UTC, with microseconds where there are some."""
    t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return t.isoformat(timespec="microseconds" if t.microsecond else "seconds") + "Z"


def reason(row: dict) -> str:
    """The rule in words. Python rounds ties to even, as lengths in twentieths need."""
    return REASONS[row["rule"]].format(**row)


def tables(mined: Mined, folder: str) -> None:
    """Parquet tables clusters, occurrences, matches and skipped: the primary sink, at any size."""
    for name in ("clusters", "occurrences", "matches", "skipped"):
        getattr(mined, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def ordered(mined: Mined) -> Iterator[tuple[dict, list[dict]]]:
    """Clusters in order, each with its airings; streamed from one sorted join, a cluster at a time."""
    rows = mined.clusters.join(mined.occurrences.drop("duration"), "cluster_id").orderBy("cluster_id", "start_us").toLocalIterator()
    now, held = None, []
    for r in map(lambda r: r.asDict(), rows):
        if now and r["cluster_id"] != now["cluster_id"]:
            yield now, held
            held = []
        now = r
        held.append(r)
    if now:
        yield now, held


def best(airings: list[dict], duration: float) -> dict:
    """The airing whose length is nearest to the cluster's, the first of such."""
    return min(airings, key=lambda o: abs((o["end_us"] - o["start_us"]) / 1e6 - duration))


def result(mined: Mined, cuts: dict[int, str] | None = None) -> dict:
    """The whole run as one document of clusters, skipped files, warnings and counts."""
    clusters = [
        {
            "ID": c["cluster_id"], "DurationSec": c["duration"], "Representative": (cuts or {}).get(c["cluster_id"], ""), "IsSpot": c["is_spot"], "Reason": reason(c),
            "Occurrences": [{"Start": stamp(o["start_us"]), "End": stamp(o["end_us"]), "File": o["path"], "OffsetSec": o["offset_sec"]} for o in airings],
        }
        for c, airings in ordered(mined)
    ]
    skipped = [{"Path": r["path"], "Reason": r["reason"]} for r in mined.skipped.orderBy("path").toLocalIterator()]
    stats = {"Files": mined.stats["files"], "AudioSec": mined.stats["audio_sec"], "Frames": mined.stats["frames"], "Windows": mined.stats["windows"], "SeedPairs": mined.stats["seeds"], "VerifiedPairs": mined.stats["verified"], "Matches": mined.stats["matches"]}
    stats |= {"PeakRSSBytes": peak_bytes(), "FeatureBytes": mined.stats["feature_bytes"], "IndexBytes": mined.stats["index_bytes"], "WallSec": mined.stats["seconds"]}
    return {"Clusters": clusters, "Skipped": skipped, "Warnings": mined.stats.get("warnings", []), "Stats": stats}


def save(path: str, text: str) -> None:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(name, compression=None) as f:
        f.write(text.encode())


def as_json(mined: Mined, path: str, cuts: dict[int, str] | None = None) -> None:
    save(path, json.dumps(result(mined, cuts), indent=2, ensure_ascii=False))


def report(mined: Mined) -> str:
    """For each cluster its length, verdict and airings."""
    out = []
    for c, airings in ordered(mined):
        out.append(f"cluster {c['cluster_id']}: {c['duration']:.1f}s, {len(airings)} airings, {'spot' if c['is_spot'] else 'not a spot'} ({reason(c)})")
        out += [f"  {stamp(o['start_us'])} - {stamp(o['end_us'])}  {o['path'].rsplit('/', 1)[-1]} +{o['offset_sec']:.1f}s" for o in airings]
    return "\n".join(out) + "\n"


def peak_bytes() -> int:
    """The driver's peak of resident memory."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def summary(mined: Mined) -> str:
    c = mined.clusters.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_spot").alias("spots"), F.sum(F.when(F.col("is_spot"), F.col("n")).otherwise(0)).alias("airings")).first()
    lines = [f"{mined.stats['files']} files, {mined.stats['audio_sec'] / 3600:.2f} h", f"{c.n} clusters, {c.spots} spots with {c.airings or 0} airings", f"driver peak {peak_bytes() >> 20} MB"]
    lines += [f"skipped {r['path']}: {r['reason']}" for r in mined.skipped.orderBy("path").toLocalIterator()]
    return "\n".join(lines + mined.stats.get("warnings", [])) + "\n"


def dump_matches(mined: Mined, folder: str) -> None:
    """One line a match, as broadcast times of both sides."""
    held = mined.matches.sparkSession.sparkContext.broadcast(mined.axis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = lambda f: stamp(held.value.time(f))
            lines = [f"{t(a)} {t(e)} {t(a - lag)} {sim:.3f}" for a, e, lag, sim in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    mined.matches.orderBy("a_start", "lag").select("a_start", "a_end", "lag", "sim").mapInArrow(run, "value string").write.mode("overwrite").text(folder)


CUTS = "cluster_id long, file string, error string"


def representatives(mined: Mined, folder: str, timeout: float = 900.0) -> DataFrame:
    """Cuts each cluster's representative airing out of its recording into folder, as WAV, in parallel; a failure is a row with an error."""
    o = mined.occurrences
    off = F.abs((F.col("end_us") - F.col("start_us")) / 1e6 - F.col("duration"))
    rows = o.groupBy("cluster_id").agg(F.min(F.struct(off.alias("off"), "start_us", "end_us", "path", "offset_sec")).alias("m"))
    rows = rows.select("cluster_id", "m.path", "m.offset_sec", ((F.col("m.end_us") - F.col("m.start_us")) / 1e6).alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for k, path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, error = f"{root}/cluster_{k:05d}.wav", None
                try:
                    params, data = cut(path, offset, length, timeout)
                    with fs.open_output_stream(name, compression=None) as raw, wave.open(Unseekable(raw), "wb") as out:
                        out.setparams(params)
                        out.setnframes(len(data) // (params.sampwidth * params.nchannels))
                        out.writeframesraw(data)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((k, pa.int64()), (None if error else name, pa.string()), (error, pa.string()))], names=["cluster_id", "file", "error"])

    return rows.mapInArrow(run, CUTS)


class Unseekable:
    """A stream that the WAV writer takes as one that cannot go back."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def write(self, data: bytes) -> int:
        self.raw.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass
