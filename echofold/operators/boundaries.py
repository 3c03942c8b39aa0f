"""Where repeats begin and end: votes of match edges, cuts, atomic segments, and their union into groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import drop_tables, written
from . import timeline
from .grouping import fold
from .relational import connected_components, islands, range_join

# Fixed values, in frames and shares.
TOL = 10
HOST_MIN = 1200
BUCKET = 6000
HOST_BUCKET = 600
SUPPORT, PEAK_SHARE, PEAK_REACH = 0.05, 0.3, 60
TRIMMED = 0.8


def lag_at(p: Column) -> Column:
    """The lag at a place on side A."""
    return F.when((F.col("split") > 0) & (p >= F.col("split")), F.col("lag2")).otherwise(F.col("lag"))


def lag_at_b(p: Column) -> Column:
    """The lag at a place on side B."""
    return F.when((F.col("split") > 0) & (p >= F.col("split") - F.col("lag2")), F.col("lag2")).otherwise(F.col("lag"))


def with_b(found: DataFrame) -> DataFrame:
    return found.withColumn("b_start", F.col("a_start") - F.col("lag")).withColumn("b_end", F.col("a_end") - lag_at(F.col("a_end") - 1)).withColumn("len", F.col("a_end") - F.col("a_start"))


def without_internal(found: DataFrame) -> DataFrame:
    """Anti-join: drops matches that a match of a minute or more, half as long again, covers on both sides at another lag.

    Matches that are too long for the longest match of their runs to cover them are kept without being compared.
    """
    m = with_b(found)
    h = m.where(F.col("len") >= HOST_MIN).select(*[F.col(c).alias(f"h_{c}") for c in ("a_start", "a_end", "b_start", "b_end", "len", "lag", "ra", "rb")])
    h = h.withColumn("h_bucket", F.explode(F.sequence(F.floor(F.col("h_a_start") / HOST_BUCKET), F.floor(F.col("h_a_end") / HOST_BUCKET))))
    longest = m.where(F.col("len") >= HOST_MIN).groupBy(F.col("ra").alias("l_ra"), F.col("rb").alias("l_rb")).agg(F.max("len").alias("_longest"))
    m = m.join(longest, (F.col("ra") == F.col("l_ra")) & (F.col("rb") == F.col("l_rb")), "left").drop("l_ra", "l_rb")
    # null, so met by nothing, where no host is long enough
    place = F.when(F.floor(F.col("len") * 3 / 2) <= F.col("_longest"), F.floor(F.col("a_start") / HOST_BUCKET))
    m = m.withColumn("_bucket", place)
    covers = (F.col("_bucket") == F.col("h_bucket")) & (F.col("ra") == F.col("h_ra")) & (F.col("rb") == F.col("h_rb"))
    covers &= (F.col("h_a_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("h_a_end"))
    covers &= (F.col("h_b_start") <= F.col("b_start")) & (F.col("b_end") <= F.col("h_b_end"))
    covers &= (F.col("h_len") >= F.floor(F.col("len") * 3 / 2)) & (F.abs(F.col("h_lag") - F.col("lag")) > TOL)
    return m.join(h, covers, "left_anti").drop("_bucket", "_longest")


def sides(m: DataFrame) -> DataFrame:
    """run, start, end of both sides."""
    return m.select(F.col("ra").alias("run"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).unionByName(
        m.select(F.col("rb").alias("run"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    )


def votes(m: DataFrame) -> DataFrame:
    """run, pos, near, far: both edges on both sides; near is the vote's own place, far the other side's."""
    vote = lambda run, near, far: F.struct(F.col(run).alias("run"), F.col(near).alias("pos"), F.col(near).alias("near"), F.col(far).alias("far"))
    four = F.array(vote("ra", "a_start", "b_start"), vote("ra", "a_end", "b_end"), vote("rb", "b_start", "a_start"), vote("rb", "b_end", "a_end"))
    return m.select(F.explode(four).alias("v")).select("v.*")


def bins(rows: list[dict]) -> list[tuple]:
    """Greedy bins of votes in order of place: all within TOL of a bin's first. A bin stands at the floor of its mean."""
    out, held = [], []

    def close():
        pos = math.floor(sum(r["pos"] for r in held) / len(held))
        out.append((held[0]["run"], pos, [{"near": a, "far": b} for a, b in sorted({(r["near"], r["far"]) for r in held})]))
        held.clear()

    for r in rows:
        if held and r["pos"] - held[0]["pos"] > TOL:
            close()
        held.append(r)
    close()
    return out


CUTS = "run long, pos long, events array<struct<near: long, far: long>>"


def binned(rows: DataFrame) -> DataFrame:
    """Cuts of votes. No bin spans a gap of more than TOL, so the stretches between such gaps are folded apart."""
    spans = islands(rows.distinct().withColumn("_end", F.col("pos")), "pos", "_end", ["run"], TOL)
    return fold(spans, ["run", "island"], ["pos", "near", "far"], bins, CUTS)


def insides(m: DataFrame) -> DataFrame:
    """run, lo, hi of both sides, well inside, with what moves a place to the other side: other, lag, lag2, split, to."""
    inside = lambda run, a, b, other, to: m.select(F.col(run).alias("run"), (F.col(a) + TOL + 1).alias("lo"), (F.col(b) - TOL).alias("hi"), F.col(other).alias("other"), "lag", "lag2", "split", F.lit(to).alias("to")).where("lo < hi")
    return inside("ra", "a_start", "a_end", "rb", 0).unionByName(inside("rb", "b_start", "b_end", "ra", 1))


def moved(p: Column) -> Column:
    """A place inside, on the other side."""
    return F.when(F.col("to") == 0, p - lag_at(p)).otherwise(p + lag_at_b(p))


def carried(cuts: DataFrame, m: DataFrame) -> DataFrame:
    """Votes that cuts well inside one side of a match cast on the other side, a row for each such match."""
    p = F.col("pos")
    met = range_join(insides(m), cuts.withColumn("_pos1", p + 1), ("lo", "hi"), ("pos", "_pos1"), BUCKET, ["run"])
    return met.select(F.col("other").alias("run"), moved(p).alias("pos"), F.explode("events").alias("e")).select("run", "pos", "e.near", "e.far")


def borrowed(cuts: DataFrame, m: DataFrame) -> DataFrame:
    """run, pos, src, at: the places to which matches carry the cuts (src, at), each once.

    All matches of a lag between two runs carry a cut to the same place, so their insides are united first.
    """
    how = ["run", "other", "lag", "lag2", "split", "to"]
    spans = islands(insides(m), "lo", "hi", how).groupBy(*how, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = range_join(spans, cuts.select("run", "pos", (F.col("pos") + 1).alias("_pos1")), ("lo", "hi"), ("pos", "_pos1"), BUCKET, ["run"])
    return met.select(F.col("other").alias("run"), moved(F.col("pos")).alias("pos"), F.col("run").alias("src"), F.col("pos").alias("at")).distinct()


def firsts(rows: list[dict]) -> Iterator[tuple]:
    """The first place of each place's greedy bin."""
    first = None
    for r in rows:
        if first is None or r["pos"] - first > TOL:
            first = r["pos"]
        yield r["run"], r["pos"], first


def weighed(votes: DataFrame, cuts: DataFrame, m: DataFrame) -> DataFrame:
    """run, pos, n, free: cuts of the votes and of those that cuts cast over the matches; how many events, and whether they are independent.

    The same as binned(votes and carried), but a cut's events go once to a stretch of the axis, with the places to which they are
    carried there, and are laid out bin by bin.
    """
    own = written(votes.distinct(), "votes")
    lent = written(borrowed(cuts, m), "borrowed")
    places = own.select("run", "pos").union(lent.select("run", "pos")).distinct().withColumn("_end", F.col("pos"))
    places = written(fold(islands(places, "pos", "_end", ["run"], TOL), ["run", "island"], ["pos"], firsts, "run long, pos long, first long"), "places")
    stretch, place = F.floor(F.col("first") / BUCKET).alias("g"), F.struct("first", "pos")
    mine = own.groupBy("run", "pos").agg(F.collect_list(F.struct("near", "far")).alias("events")).join(places, ["run", "pos"])
    theirs = lent.join(places, ["run", "pos"]).groupBy("run", stretch, "src", "at").agg(F.collect_list(place).alias("places"))
    theirs = theirs.join(cuts.select(F.col("run").alias("src"), F.col("pos").alias("at"), "events"), ["src", "at"])
    rows = mine.select("run", stretch, F.array(place).alias("places"), "events").unionByName(theirs.select("run", "g", "places", "events"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            runs, stretches = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = [*(np.flatnonzero(np.diff(runs) | np.diff(stretches)) + 1).tolist(), len(runs)] if len(runs) else []
            for a, b in zip([0, *ends], ends, strict=False):
                if now != (runs[a], stretches[a]):
                    yield from laid(now, held)
                    now, held = (runs[a], stretches[a]), []
                held.append(batch.slice(a, b - a))
        yield from laid(now, held)

    n = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = written(rows.repartition(n, "run", "g").sortWithinPartitions("run", "g").mapInArrow(run, "run long, pos long, n long, free boolean"), "weighed")
    drop_tables(own, lent, places)
    return out


def laid(key: tuple | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of a stretch of a run: rows of places (first of the bin, pos) and of the events that stand at each of them."""
    if not held:
        return
    parts = [(x.column(2).value_lengths().to_numpy(), x.column(2).flatten(), x.column(3).value_lengths().to_numpy(), x.column(3).flatten()) for x in held]
    whole = lambda k, field=None: np.concatenate([(p[k] if field is None else p[k].field(field).to_numpy()) for p in parts])
    size, first, pos = whole(0), whole(1, "first"), whole(1, "pos")
    count, near, far = whole(2).astype(np.int64), whole(3, "near"), whole(3, "far")
    row, begin = np.repeat(np.arange(len(size)), size), np.cumsum(count) - count
    order = np.argsort(first, kind="stable")
    out: tuple[list, list, list] = ([], [], [])
    for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        n = count[row[at]]
        where = np.repeat(begin[row[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p, a, b = np.repeat(pos[at], n), near[where], far[where]
        by = np.lexsort((p, b, a))
        p, a, b = p[by], a[by], b[by]
        event = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])
        vote = event | np.concatenate([[True], np.diff(p) != 0])
        mean = math.floor(int(p[vote].sum()) / int(vote.sum()))
        out[0].append(mean)
        out[1].append(int(event.sum()))
        out[2].append(free(a[event], b[event], mean))
    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["run", "pos", "n", "free"])


def free(near: np.ndarray, far: np.ndarray, pos: int) -> bool:
    """independent(), of sorted events."""
    shared = lambda x: abs(x - pos) > TOL and bool(((np.abs(near[1:] - x) <= TOL) | (np.abs(far[1:] - x) <= TOL)).all())
    return len(near) >= 2 and not shared(int(near[0])) and not shared(int(far[0]))


def independent(events: Column, pos: Column) -> Column:
    """Not all events share an anchor other than the cut's own place."""
    near = lambda a, b: F.abs(a - b) <= TOL
    first = F.element_at(events, 1)
    rest = F.slice(events, 2, F.greatest(F.size(events) - 1, F.lit(1)))
    shared = lambda x: ~near(x, pos) & F.forall(rest, lambda e: near(e["near"], x) | near(e["far"], x))
    return (F.size(events) >= 2) & ~shared(first["near"]) & ~shared(first["far"])


def kept_cuts(cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """Cuts over which nothing passes, or that enough independent events of their neighbourhood support."""
    return supported(cuts.select("run", "pos", F.size("events").cast("long").alias("n"), independent(F.col("events"), F.col("pos")).alias("free")), spans)


def supported(cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """kept_cuts() of cuts that are weighed."""
    rows = timeline.spanning(cuts, spans, ["run"], "pos", "start", "end", TOL)
    rows = timeline.neighbourhood(rows, ["run"], "pos", "n", PEAK_REACH)
    enough = (F.col("n") >= F.greatest(F.lit(2), F.ceil(SUPPORT * F.col("n_spanning")))) & (F.col("n") >= PEAK_SHARE * F.col("n_near"))
    return rows.where((F.col("n_spanning") <= 0) | (enough & F.col("free"))).select("run", "pos")


def segments(cuts: DataFrame, spans: DataFrame) -> DataFrame:
    """id, run, start, end: stretches between consecutive cuts of one island of coverage."""
    found = islands(spans, "start", "end", ["run"]).groupBy("run", "island").agg((F.min("start") - TOL).alias("lo"), (F.max("end") + TOL + 1).alias("hi"))
    met = range_join(found, cuts.distinct().withColumn("_pos1", F.col("pos") + 1), ("lo", "hi"), ("pos", "_pos1"), BUCKET, ["run"])
    w = Window.partitionBy("run", "island").orderBy("pos")
    rows = met.withColumn("end", F.lead("pos").over(w)).where("end is not null").select("run", F.col("pos").alias("start"), "end").distinct()
    return rows.select((F.shiftleft("start", 20) + F.least(F.col("end") - F.col("start"), F.lit((1 << 20) - 1))).alias("id"), "run", "start", "end")


def edges(m: DataFrame, segs: DataFrame) -> DataFrame:
    """a, b: segments that a match lays on each other: equal within tolerance, else a container, else contained."""
    spans = m.withColumn("_lo", F.col("a_start") - F.floor(F.col("len") / 4)).withColumnRenamed("ra", "run")
    met = range_join(spans, segs, ("_lo", "a_end"), ("start", "end"), BUCKET, ["run"])
    shared = F.least("end", "a_end") - F.greatest("start", "a_start")
    met = met.where((F.col("start") >= F.col("_lo")) & (F.col("start") < F.col("a_end") - TOL) & (shared >= TRIMMED * (F.col("end") - F.col("start"))))
    to = met.select("id", F.col("rb").alias("run"), (F.col("start") - lag_at(F.col("start"))).alias("ts"), (F.col("end") - lag_at(F.col("end") - 1)).alias("te")).where("ts < te").distinct()
    n = F.col("te") - F.col("ts")
    to = to.withColumn("tol", F.greatest(F.lit(TOL), F.floor(n / 20))).withColumn("_a", F.col("ts") - F.col("tol")).withColumn("_b", F.col("te") + F.col("tol"))
    other = segs.select(F.col("id").alias("to"), "run", F.col("start").alias("s"), F.col("end").alias("e"))
    near = range_join(to, other, ("_a", "_b"), ("s", "e"), BUCKET, ["run"])
    size, tol = F.col("e") - F.col("s"), F.col("tol")
    tier = (
        F.when((F.abs(F.col("s") - F.col("ts")) <= tol) & (F.abs(F.col("e") - F.col("te")) <= tol), 1)
        .when((F.col("s") >= F.col("te") - F.floor(5 * n / 4)) & (F.col("s") <= F.col("ts") + tol) & (F.col("e") >= F.col("te") - tol) & (n >= TRIMMED * size), 2)
        .when((F.col("s") >= F.col("ts") - tol) & (F.col("s") < F.col("te")) & (F.col("e") <= F.col("te") + tol) & (size >= TRIMMED * n), 3)
    )
    near = near.withColumn("tier", tier).where("tier is not null")
    w = Window.partitionBy("id", "run", "ts", "te").orderBy("tier", "s", "e")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1 and id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()


def cut(m: DataFrame) -> DataFrame:
    """run, pos: the cuts that are kept, of the votes of matches and of those carried over them."""
    first = votes(m)
    return supported(weighed(first, written(binned(first), "binned"), m), sides(m))


def atomic_groups(found: DataFrame) -> DataFrame:
    """gid, run, start, end: segments that matches lay on each other, by component."""
    m = written(without_internal(found), "outer")
    spans = sides(m)
    segs = written(segments(cut(m), spans), "segments")
    parts = connected_components(edges(m, segs))
    return segs.join(parts, segs["id"] == parts["node"]).select(F.col("component").alias("gid"), "run", "start", "end")
