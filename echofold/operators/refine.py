"""Placing airings against their group's reference: alignment, checking, joining of same audio, extending of edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels.axis import Axis
from ..kernels.verify import SCORE, Bounds
from .boundaries import with_b
from .chains import sizes
from .grouping import each, fold
from .relational import connected_components, range_join
from .search import find_matches

# Fixed values, in frames and shares.
TOL = 10
SHIFT = 20
SLACK, COARSE = 120, 5
SAME_SHARE, SHORT, LEAST = 0.8, 160, 20
EXTEND_SHARE, EXTEND_MAX, STEP = 0.9, 1200, 10
SPOT_MIN = 160
LOOK_BACK = 8
GROUP = "gid long, run long, start long, end long"


def references(groups: DataFrame) -> DataFrame:
    """gid, n, med, ref_run, ref_start, ref_end: the airing whose length is nearest to the upper median, the earliest of such."""
    info = sizes(groups)
    off = F.abs(F.col("end") - F.col("start") - F.col("med"))
    best = F.min(F.struct(off.alias("off"), "start", "end", "run"))
    rows = groups.join(info, "gid").groupBy("gid").agg(best.alias("m"), F.first("n").alias("n"), F.first("med").alias("med"))
    return rows.select("gid", "n", "med", F.col("m.run").alias("ref_run"), F.col("m.start").alias("ref_start"), F.col("m.end").alias("ref_end"))


def run_of(axis: Axis, frame: int) -> int:
    return int(axis.run(frame))


def aligned(axis: Axis, groups: DataFrame) -> DataFrame:
    """Every airing shifted by up to a second to where it agrees best with its reference; all get the median length.

    Groups of one airing, and references too short to have an interior, stay as they are.
    """
    held = groups.sparkSession.sparkContext.broadcast(axis)

    def place(r: dict):
        axis = held.value
        low, high = r["ref_start"] + SCORE, r["ref_start"] + r["med"] - SCORE
        if r["n"] < 2 or high <= low:
            return [(r["gid"], r["run"], r["start"], r["end"])]
        start = r["ref_start"]
        if (r["start"], r["end"]) != (r["ref_start"], r["ref_end"]):
            best, shift = -2.0, 0
            for d in range(-SHIFT, SHIFT + 1):
                base = r["start"] + d - r["ref_start"]
                if low + base >= 0 and high + base <= axis.n:
                    s = float(axis.cosines(low, low + base, high - low).sum())
                    if s > best:
                        best, shift = s, d
            start = max(0, r["start"] + shift)
        return [(r["gid"], run_of(axis, start), start, min(axis.n, start + r["med"]))]

    return each(groups.join(references(groups), "gid"), place, GROUP)


def checked(axis: Axis, groups: DataFrame, high: float) -> DataFrame:
    """Drops airings that do not agree with their reference, looked for up to six seconds away; then groups of one."""
    held = groups.sparkSession.sparkContext.broadcast(axis)

    def test(r: dict):
        axis, n = held.value, r["ref_end"] - r["ref_start"]

        def score(start: int) -> float:
            if start < 0 or start + n > axis.n:
                return -2.0
            return float(axis.cosines(r["ref_start"], start, n).mean())

        own = (r["gid"], r["run"], r["start"], r["end"])
        if r["start"] == r["ref_start"] or score(r["start"]) >= high:
            return [own]
        best = max(range(-SLACK, SLACK + 1, COARSE), key=lambda d: (score(r["start"] + d), -abs(d)))
        best = max(range(best - COARSE, best + COARSE + 1), key=lambda d: (score(r["start"] + d), -abs(d)))
        start = r["start"] + best
        return [(r["gid"], run_of(axis, start), start, start + r["end"] - r["start"])] if score(start) >= high else []

    kept = each(groups.join(references(groups), "gid"), test, GROUP)
    several = kept.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gid")
    return kept.join(several, "gid", "left_semi")


def spaced(rows: list[dict]) -> list[tuple]:
    """Airings of one group in order; one that starts before the middle of the last kept one goes."""
    out: list[tuple] = []
    for r in rows:
        if not out or r["start"] >= (out[-1][2] + out[-1][3]) // 2:
            out.append((r["gid"], r["run"], r["start"], r["end"]))
    return out


def weighted_union(rows: list[dict]) -> list[tuple]:
    """idx, root, off of a component's groups, from its pairs: the best pairs first; the root with more airings stays.

    off places a group's reference start in its root's.
    """
    parent: dict[int, tuple[int, int]] = {}
    size = {k: n for r in rows for k, n in ((r["i"], r["ni"]), (r["j"], r["nj"]))}

    def find(k: int) -> tuple[int, int]:
        off = 0
        while k in parent:
            k, d = parent[k]
            off += d
        return k, off

    for r in sorted(rows, key=lambda r: (-r["shared"], r["i"], r["j"])):
        (a, oa), (b, ob) = find(r["i"]), find(r["j"])
        if a == b:
            continue
        d = r["shift"] + oa - ob
        if (-size[a], a) <= (-size[b], b):
            parent[b] = (a, d)
        else:
            parent[a] = (b, -d)
    return [(k, *find(k)) for k in sorted(size)]


def same_audio(spark: SparkSession, axis: Axis, groups: DataFrame, limits: Bounds) -> DataFrame:
    """Joins groups whose references are the same audio, found by mining the references among themselves.

    References lie on an axis of excerpts with breaks in between; the pairs of groups are united within
    connected components. Airings of a joined group are placed anew on its root.
    """
    refs = references(groups).where((F.col("n") >= 2) & (F.col("med") >= LEAST)).orderBy("ref_start", F.desc("med"), "gid")
    table = [r.asDict() for r in refs.toLocalIterator()]  # one row a group: what the axis of excerpts is made of
    if len(table) < 2:
        return groups
    pieces, own, at = [], [], 0
    for k, r in enumerate(table):
        low, high = r["ref_start"], r["ref_start"] + r["med"]
        high = min(high, axis.n)
        before = TOL if low >= TOL and run_of(axis, low - TOL) == run_of(axis, low) else 0
        after = TOL if high + TOL <= axis.n and run_of(axis, high + TOL - 1) == run_of(axis, high - 1) else 0
        pieces.append((low - before, high + after))
        own.append((k, r["gid"], r["n"], at + before, at + before + high - low))
        at += high + after - low + before
    found = with_b(find_matches(spark, axis.excerpts(pieces), limits))
    places = spark.createDataFrame(own, "idx long, gid long, n long, lo long, hi long")
    side = lambda s: places.select(*[F.col(c).alias(f"{c}_{s}") for c in places.columns])
    met = found.where("ra <> rb").join(side("i"), F.col("ra") == F.col("idx_i")).join(side("j"), F.col("rb") == F.col("idx_j"))
    met = met.withColumn("shared", F.least(F.least("a_end", "hi_i") - F.greatest("a_start", "lo_i"), F.least("b_end", "hi_j") - F.greatest("b_start", "lo_j")))
    met = met.where("shared > 0").withColumn("shift", F.col("lag") + F.col("lo_j") - F.col("lo_i"))
    best = met.groupBy("idx_i", "idx_j").agg(F.min(F.struct((-F.col("shared")).alias("s"), "a_start", "shift", (F.col("hi_i") - F.col("lo_i")).alias("li"), (F.col("hi_j") - F.col("lo_j")).alias("lj"), "n_i", "n_j")).alias("m"))
    pairs = best.select(F.col("idx_i").alias("i"), F.col("idx_j").alias("j"), (-F.col("m.s")).alias("shared"), "m.shift", "m.li", "m.lj", F.col("m.n_i").alias("ni"), F.col("m.n_j").alias("nj"))
    longer, shorter = F.greatest("li", "lj"), F.least("li", "lj")
    pairs = pairs.where((F.col("shared") >= SAME_SHARE * longer) | ((longer < SHORT) & (F.col("shared") >= SAME_SHARE * shorter)))
    parts = connected_components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    united = fold(pairs.join(parts, pairs["i"] == parts["node"]), ["component"], ["i", "j"], weighted_union, "idx long, root long, off long")
    to = united.join(places.select("idx", "gid"), "idx").join(places.select(F.col("idx").alias("root"), F.col("gid").alias("root_gid"), (F.col("hi") - F.col("lo")).alias("size")), "root").select("gid", "root_gid", "off", "size")
    held = spark.sparkContext.broadcast(axis)

    def place(r: dict):
        axis, start = held.value, r["start"] - r["off"]
        end = start + r["size"]
        if start < 0 or end > axis.n or run_of(axis, start) != run_of(axis, end - 1):
            return []
        return [(r["root_gid"], run_of(axis, start), start, end)]

    moved = aligned(axis, each(groups.join(to, "gid"), place, GROUP))
    return fold(moved, ["gid"], ["start", "end"], spaced, GROUP).unionByName(groups.join(to.select("gid"), "gid", "left_anti"))


def extended(axis: Axis, groups: DataFrame, high: float) -> DataFrame:
    """Moves both edges of a group outwards by half a second at a time, while nine tenths of its other airings still agree with the reference.

    No edge enters an airing of another group of spots, if that group has at least as many airings. Of all spots'
    airings that begin before a step's end, the last LOOK_BACK count: each knows the start of the one that many later
    in its run, up to which it counts. All airings of a group move alike, at most a minute.
    """
    held = groups.sparkSession.sparkContext.broadcast(axis)
    refs = references(groups)
    reach = refs.select("gid", "n", (F.col("ref_start") - EXTEND_MAX).alias("lo"), (F.col("ref_end") + EXTEND_MAX).alias("hi"))
    spots = groups.join(sizes(groups).where(F.col("med") >= SPOT_MIN).select("gid", F.col("n").alias("n_other")), "gid")
    later = F.lead("start", LOOK_BACK).over(Window.partitionBy("run").orderBy("start", "end", "gid"))
    spots = spots.withColumn("until", later).select(F.col("gid").alias("other"), "n_other", F.col("start").alias("s"), F.col("end").alias("e"), "until")
    near = range_join(reach, spots, ("lo", "hi"), ("s", "e"), 6000).where("gid <> other and n_other >= n")
    guard = near.groupBy("gid").agg(F.collect_set(F.struct("s", "e", "until")).alias("guard"))

    def grow(rows: list[dict]):
        axis, r = held.value, rows[0]
        others = [x for x in rows if x["start"] != r["ref_start"]]
        need = math.floor(EXTEND_SHARE * len(others) + 0.999)
        guard = [(g["s"], g["e"], g["until"]) for g in r["guard"] or []]

        def free(lo: int, hi: int) -> bool:
            return not any(s < hi and e > lo and (until is None or hi <= until) for s, e, until in guard)

        def agrees(lo: int, whole: int) -> bool:
            if lo < 0 or lo + STEP > axis.n or run_of(axis, lo) != run_of(axis, whole) or run_of(axis, lo + STEP - 1) != run_of(axis, whole) or not free(lo, lo + STEP):
                return False
            n = 0
            for x in others:
                at = x["start"] + lo - r["ref_start"]
                n += at >= 0 and at + STEP <= axis.n and float(axis.cosines(lo, at, STEP).mean()) >= high
            return n >= need

        left = right = 0
        if others:
            while right < EXTEND_MAX and agrees(r["ref_end"] + right, r["ref_end"] - 1):
                right += STEP
            while left < EXTEND_MAX and agrees(r["ref_start"] - left - STEP, r["ref_start"]):
                left += STEP
        return [(x["gid"], run_of(axis, max(0, x["start"] - left)), max(0, x["start"] - left), min(axis.n, x["end"] + right)) for x in rows]

    full = groups.join(refs.drop("n", "med"), "gid").join(guard, "gid", "left")
    return fold(full, ["gid"], ["start", "end"], grow, GROUP)
