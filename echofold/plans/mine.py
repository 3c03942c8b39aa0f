"""The mining run: recordings to frames, matches, groups and judged clusters.

Stages are functions from tables to tables over an axis, so that the join of same audio runs them again on an
axis of excerpts. Tables are written to the shared folder after decoding, matching, grouping and at the end.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import storage
from ..functions.storage import shared_dir
from ..kernels.axis import Axis, Span
from ..kernels.descriptor import STEP, TABLES, WINDOW
from ..kernels.dsp import BANDS, FPS
from ..operators import boundaries, chains, refine, timeline
from ..operators.classify import ladder
from ..operators.grouping import each
from ..operators.relational import connected_components
from ..operators.search import counters, find_matches
from ..sources.audio import decoded
from .options import NoInputs, Options

UNIT_SHARE, UNIT_BEFORE, UNIT_AFTER, COMPANY, COMPANY_REACH = 0.8, 1_000_000, 5_000_000, 2_000_000, 120_000_000
TOLERANCE = 1_000_000
#: Bytes of an index row: table, hash and place.
INDEX_ENTRY = 16


@dataclass
class Mined:
    """clusters, occurrences, matches and skipped are tables; axis has the spans; stats: counts of the run."""

    axis: Axis
    matches: DataFrame
    clusters: DataFrame
    occurrences: DataFrame
    skipped: DataFrame
    stats: dict


def lay(folder: str, rows: list) -> Axis:
    """Files (path, start_us, file, n) by start on one axis.

    Where a file starts over a second before the last one ends, that one's overlapping end goes; where it starts
    over a second after, a break lies.
    """
    spans: list[Span] = []
    first = run = 0
    kept: list[list] = []
    for r in sorted(rows, key=lambda r: (r["start_us"], r["path"])):
        if kept:
            last = kept[-1]
            gap = r["start_us"] - (last[1] + last[3] * 1_000_000 // FPS)
            if gap < -TOLERANCE:
                last[3] -= min(last[3], int(-gap * FPS / 1_000_000))
            elif gap > TOLERANCE:
                run += 1
        kept.append([r["path"], r["start_us"], r["file"], r["n"], run])
    for path, start, file, n, k in kept:
        if n > 0:
            spans.append(Span(file, 0, first, n, start, path, k))
            first += n
    return Axis(folder, spans)


Progress = Callable[[str, int, int], None]
STAGES = ("decode", "match", "cut", "chain", "join", "chain again", "align", "join again", "check", "extend", "join last", "classify")


def mine(spark: SparkSession, inputs: DataFrame, options: Options | None = None, progress: Progress | None = None) -> Mined:
    """inputs: (path, start). A file that cannot be read is skipped and reported; if none can, NoInputs is raised.

    progress, if given, is called with a stage's name when it is done, the number of stages done, and of all.
    """
    options = options or Options()
    began = time.time()
    folder = shared_dir(spark, "frames")
    files = storage.written(decoded(inputs, folder, options.timeout), "decoded")
    skipped = files.where("error is not null").select("path", F.col("error").alias("reason"))
    rows = [r.asDict() for r in files.where("error is null").toLocalIterator()]  # one row a file
    if not rows:
        raise NoInputs("no input could be read")
    axis = lay(folder, rows)
    if progress:
        progress("decode", 1, len(STAGES))
    out = mine_axis(spark, axis, options, skipped, progress)
    out.stats["seconds"] = time.time() - began
    return out


def mine_axis(spark: SparkSession, axis: Axis, options: Options, skipped: DataFrame | None = None, progress: Progress | None = None) -> Mined:
    """The run over an axis that is laid already."""
    began = time.time()
    limits, excerpts, counts = options.bounds(), options.bounds(0), counters(spark)
    done = 1

    def written(df: DataFrame, name: str) -> DataFrame:
        nonlocal done
        out = storage.written(df, name)
        if progress and done < len(STAGES):
            progress(STAGES[done], done + 1, len(STAGES))
        done += 1
        return out

    found = written(find_matches(spark, axis, limits, counts), "matches")
    several = F.col("n") >= 2
    groups = written(boundaries.atomic_groups(found), "atomic")
    groups = written(chains.chain(groups, 10, several & (F.col("med") > 10)), "chained")
    groups = written(refine.same_audio(spark, axis, groups, excerpts), "joined")
    long = several & (F.col("med") >= options.min_len)
    groups = written(chains.chain(groups, 40, long), "chained")
    groups = groups.join(chains.sizes(groups).where(long).select("gid"), "gid", "left_semi")
    groups = written(refine.aligned(axis, groups), "aligned")
    groups = written(refine.same_audio(spark, axis, groups, excerpts), "joined")
    groups = written(refine.checked(axis, groups, options.sim_high), "checked")
    groups = written(refine.extended(axis, groups, options.sim_high), "extended")
    groups = written(refine.same_audio(spark, axis, groups, excerpts), "joined")
    occurrences = storage.written(emitted(axis, groups), "occurrences")
    clusters = written(classified(occurrences, options.zone), "clusters")
    skipped = skipped if skipped is not None else spark.createDataFrame([], "path string, reason string")
    stats = {"files": len({s.path for s in axis.spans}), "audio_sec": axis.n / FPS, "frames": axis.n, "windows": max(0, axis.n - WINDOW + 1), "seeds": counts["seeds"].value, "verified": counts["verified"].value, "matches": found.count(), "clusters": clusters.count(), "skipped": skipped.count()}
    windows = stats["windows"]
    stats |= {"feature_bytes": axis.n * BANDS, "index_bytes": windows // STEP * TABLES * INDEX_ENTRY, "seconds": time.time() - began}
    return Mined(axis, found, clusters, occurrences, skipped, stats)


def emitted(axis: Axis, groups: DataFrame) -> DataFrame:
    """cluster_id (by first start, then longer first), duration, start_us, end_us, path, offset_sec of every airing."""
    held = groups.sparkSession.sparkContext.broadcast(axis)
    info = chains.sizes(groups).where("n >= 2")
    ids = info.withColumn("cluster_id", F.row_number().over(Window.orderBy("first", F.desc("med"), "gid")).cast("long"))
    rows = groups.join(ids.select("gid", "cluster_id", "med"), "gid")

    def place(r: dict):
        axis = held.value
        s, start = axis.span(r["start"]), axis.time(r["start"])
        length = (r["end"] - r["start"]) * 1_000_000 // FPS
        yield r["cluster_id"], r["med"] / FPS, start, start + length, s.path, (s.offset + r["start"] - s.first) / FPS, r["start"], r["end"]

    return each(rows, place, "cluster_id long, duration double, start_us long, end_us long, path string, offset_sec double, frame long, frame_end long")


def classified(occurrences: DataFrame, zone: str = "UTC") -> DataFrame:
    """One row a cluster: n, duration, unit (seconds), pieces, top (airings in its commonest minute), accompanied, n_beside (airings beside others), rule, is_spot."""
    o = occurrences.withColumn("occ", F.struct("cluster_id", "start_us", "frame"))
    base = o.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("duration").alias("duration"), F.min("start_us").alias("first_us"))
    minute = F.minute(F.from_utc_timestamp(F.timestamp_micros("start_us"), zone))
    top = o.groupBy("cluster_id", minute.alias("m")).agg(F.count(F.lit(1)).alias("k")).groupBy("cluster_id").agg(F.max("k").alias("top"))
    near = timeline.accompanied(o, "occ", "cluster_id", "start_us", "end_us", COMPANY, COMPANY_REACH).groupBy("occ.cluster_id").agg(F.count(F.lit(1)).alias("n_beside"))
    joined = timeline.mostly_followed(o, "cluster_id", "start_us", "end_us", UNIT_BEFORE, UNIT_AFTER, UNIT_SHARE)
    parts = connected_components(joined.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("node", "cluster_id")
    rows = base.join(parts, "cluster_id", "left").withColumn("component", F.coalesce("component", "cluster_id"))
    units = rows.groupBy("component").agg(F.sum("duration").alias("unit"), F.count(F.lit(1)).alias("pieces"))
    rows = rows.join(units, "component").join(top, "cluster_id").join(near, "cluster_id", "left")
    beside = F.coalesce("n_beside", F.lit(0).cast("long"))
    out = ladder(rows.withColumn("n_beside", beside).withColumn("accompanied", F.col("n_beside") > 0).withColumn("d", F.col("duration")))
    return out.select("cluster_id", "n", "duration", "first_us", "unit", "pieces", "top", "accompanied", "n_beside", "rule", "is_spot")
