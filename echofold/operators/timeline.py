"""The ordered axis: gaps, runs, locating, cuts. Every operator works within the groups ``by``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import written

#: Airings that a task of mostly_followed holds, and that another block of them streams past those; places counted at once.
HELD, STREAMED, COUNTED = 2_000_000, 500_000, 1 << 22


def contiguity(spans: DataFrame, by: list[str], start: str, end: str, order: list[str], tolerance: float) -> DataFrame:
    """Adds gap (to the previous span's end; null for the first) and kind: first, break, overlap or continuous."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    gap = F.col(start) - F.lag(end).over(w)
    kind = F.when(F.col("gap").isNull(), "first").when(F.col("gap") > tolerance, "break").when(F.col("gap") < -tolerance, "overlap").otherwise("continuous")
    return spans.withColumn("gap", gap).withColumn("kind", kind)


def runs(spans: DataFrame, by: list[str], start: str, end: str, order: list[str], tolerance: float) -> DataFrame:
    """Adds run_id: how many breaks lie before a span. Two places are without a break iff their run_id is equal."""
    w = Window.partitionBy(*by).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = contiguity(spans, by, start, end, order, tolerance)
    return rows.withColumn("run_id", F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(w)).drop("gap", "kind")


def locate(left: DataFrame, right: DataFrame, by: list[str], at: str, value: Column, order: str, out: str = "located") -> DataFrame:
    """As-of join: to each row of left the value of the last row of right at or before it.

    Both sides are unioned and carried forward in one window, so no theta join is planned. Among right rows
    of one place that with the greatest ``order`` counts.
    """
    cols = left.columns
    marks = right.select(*by, F.col(at), F.col(order).alias("_order"), value.alias(out))
    both = left.withColumn("_order", F.lit(None).cast(marks.schema["_order"].dataType)).withColumn(out, F.lit(None).cast(marks.schema[out].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(w)).where("_side = 1").select(*cols, out)


def spanning(cuts: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, margin: float, out: str = "n_spanning") -> DataFrame:
    """Adds how many spans of the group pass over each cut: starts at most at - margin, less ends at most at + margin.

    Starts, ends and cuts are one ordered stream of +1, -1 and 0.
    """
    cols = cuts.columns
    plus = spans.select(*by, (F.col(start) + margin).alias("_at"), F.lit(1).alias("_d"))
    minus = spans.select(*by, (F.col(end) - margin).alias("_at"), F.lit(-1).alias("_d"))
    both = cuts.withColumn("_at", F.col(at)).withColumn("_d", F.lit(0)).withColumn("_cut", F.lit(1))
    both = both.unionByName(plus.unionByName(minus).withColumn("_cut", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.sum("_d").over(w)).where("_cut = 1").select(*cols, out)


def neighbourhood(votes: DataFrame, by: list[str], at: str, n: str, reach: int, out: str = "n_near") -> DataFrame:
    """Adds the sum of n over the places within reach."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-reach, reach)
    return votes.withColumn(out, F.sum(n).over(w))


def followed(airings: DataFrame, cluster: str, start: str, end: str, before: int, after: int) -> DataFrame:
    """i, j, n: how often an airing of cluster i is followed by one of another cluster j that starts in [end - before, end + after].

    A band join by buckets of the axis; pairs are counted before they leave the join's task.
    """
    size = before + after + 1
    left = airings.select(F.col(cluster).alias("i"), (F.col(end) - before).alias("lo"), (F.col(end) + after).alias("hi"))
    left = left.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    right = airings.select(F.col(cluster).alias("j"), F.col(start).alias("s")).withColumn("b", F.floor(F.col("s") / size))
    pairs = left.join(right, "b").where((F.col("i") != F.col("j")) & F.col("s").between(F.col("lo"), F.col("hi")))
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def mostly_followed(airings: DataFrame, cluster: str, start: str, end: str, before: int, after: int, share: float) -> DataFrame:
    """i, j: the pairs of followed() whose n is at least ``share`` (over 0) of the airings of i, and of those of j.

    Nearly all pairs follow each other a few times where the axis is crowded, so pairs are counted where all airings
    of both clusters are, and only those that reach the share leave the task. Clusters are dealt to blocks, twice, and every two
    blocks meet in a group of their own; of a group the airings that may follow are held, in order of start, and the others
    stream past them. A task holds HELD airings and a cluster.
    """
    spark = airings.sparkSession
    known = airings.where(F.col(cluster).isNotNull())
    rows = written(known.groupBy(F.col(cluster).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(start).alias("starts"), F.collect_list(end).alias("ends")), "followed")
    total = rows.agg(F.sum("n")).first()[0] or 0
    held, streamed = max(1, math.ceil(total / HELD)), max(1, math.ceil(total / STREAMED))
    block = lambda n, seed: F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(block(streamed, 1).alias("a"), every(held).alias("b"), F.lit(1).alias("side"), "c", "n", F.col("ends").alias("at"))
    right = rows.select(every(streamed).alias("a"), block(held, 2).alias("b"), F.lit(0).alias("side"), "c", "n", F.col("starts").alias("at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, axis = None, [], None
        for batch in batches:
            a, b, side, c, n = (batch.column(k).to_numpy() for k in range(5))
            places = batch.column(5).flatten().to_numpy()
            ends = np.cumsum(batch.column(5).value_lengths().to_numpy())
            cuts = np.flatnonzero(np.diff(a) | np.diff(b) | np.diff(side)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if x == y:
                    continue
                if now != (a[x], b[x]):
                    now, parts, axis = (a[x], b[x]), [], None
                low = ends[x - 1] if x else 0
                mine, stops = places[low : ends[y - 1]], ends[x:y] - low
                if not side[x]:
                    parts.append((c[x:y], n[x:y], np.diff(stops, prepend=0), mine))
                    continue
                if axis is None and parts:
                    names, sizes, lengths, starts = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(starts, kind="stable")
                    axis, parts = (names, sizes, starts[order], np.repeat(np.arange(len(names), dtype=np.int32), lengths)[order]), []
                if axis is not None:
                    i, j = followers(axis, c[x:y], n[x:y], stops, mine, before, after, share)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["i", "j"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(max(parts, held * streamed), "a", "b").sortWithinPartitions("a", "b", "side")
    return met.mapInArrow(count, "i long, j long")


def followers(axis: tuple, c: np.ndarray, n: np.ndarray, stops: np.ndarray, ends: np.ndarray, before: int, after: int, share: float) -> tuple[list[int], list[int]]:
    """(i, j) of the clusters c (of n airings, whose ends end at stops) and those of the axis (clusters, their sizes, starts in order, cluster of each)."""
    names, sizes, starts, owner = axis
    low, high = np.searchsorted(starts, ends - before, "left"), np.searchsorted(starts, ends + after, "right")
    out: tuple[list[int], list[int]] = ([], [])
    first = 0
    for k, stop in enumerate(stops.tolist()):
        spans = list(zip(low[first:stop].tolist(), high[first:stop].tolist(), strict=True))
        first = stop
        least = max(1, math.floor(share * int(n[k])))
        if sum(y - x for x, y in spans) <= COUNTED:
            met = np.sort(np.concatenate([owner[x:y] for x, y in spans])) if spans else owner[:0]
            often = met[: max(0, len(met) - least + 1)][met[least - 1 :] == met[: max(0, len(met) - least + 1)]]
            if not len(often):
                continue
            which = np.unique(often)
            times = np.searchsorted(met, which, "right") - np.searchsorted(met, which, "left")
        else:
            total = np.zeros(len(names), np.int64)
            for x, y in spans:
                for z in range(x, y, COUNTED):
                    part, times = np.unique(owner[z : min(y, z + COUNTED)], return_counts=True)
                    total[part] += times
            which = np.flatnonzero(total)
            times = total[which]
        fit = (times >= share * n[k]) & (times >= share * sizes[which]) & (names[which] != c[k])
        out[0].extend([int(c[k])] * int(fit.sum()))
        out[1].extend(names[which[fit]].tolist())
    return out


def accompanied(airings: DataFrame, key: str, cluster: str, start: str, end: str, slack: int, reach: int) -> DataFrame:
    """key of the airings beside which another cluster's airing ends, in (start - slack, start + slack], or starts, in [end - slack, end + slack].

    Only airings that start at most ``reach`` before this one count. Edges are gathered by place and cluster first, with
    the latest start, and of a place the two clusters that start last are kept, one of which is another cluster's if any is, so
    that a crowded second is two rows; a semi-join then meets edge and place in buckets as wide as the slack.
    """
    size = 2 * slack + 1
    edges = airings.select(F.col(cluster).alias("c"), F.col(end).alias("at"), F.lit(0).alias("k"), F.col(start).alias("s")).union(airings.select(cluster, start, F.lit(1), start))
    edges = edges.where("c is not null").groupBy("c", "at", "k").agg(F.max("s").alias("s"))
    latest = Window.partitionBy("at", "k").orderBy(F.desc("s"), "c")
    edges = edges.withColumn("_r", F.row_number().over(latest)).where("_r <= 2").drop("_r").withColumn("b", F.floor(F.col("at") / size))
    oldest = (F.col(start) - reach).alias("oldest")
    want = airings.select(key, F.col(cluster).alias("own"), (F.col(start) - slack + 1).alias("lo"), (F.col(start) + slack).alias("hi"), F.lit(0).alias("kind"), oldest)
    want = want.union(airings.select(key, cluster, F.col(end) - slack, F.col(end) + slack, F.lit(1), oldest))
    want = want.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    near = (F.col("bucket") == F.col("b")) & (F.col("kind") == F.col("k")) & (F.col("c") != F.col("own")) & F.col("at").between(F.col("lo"), F.col("hi")) & (F.col("s") >= F.col("oldest"))
    return want.join(edges, near, "left_semi").select(key).distinct()
