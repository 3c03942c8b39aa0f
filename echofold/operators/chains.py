"""Sequence chaining: groups that always air side by side become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import upper_median

# Shares, neighbours, frames.
FIRM_SHARE, MAX_FAMILY, LONG, SMALL = 0.7, 8, 2400, 160


def sizes(groups: DataFrame) -> DataFrame:
    """gid, n, med (upper median of lengths), first (start of the first airing)."""
    rows = groups.withColumn("_len", F.col("end") - F.col("start"))
    return rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), upper_median("_len").cast("long").alias("med"), F.min("start").alias("first"))


def piece(size: Column, host: Column) -> Column:
    return (size < host) | ((size < SMALL) & (2 * host >= size))


def junctions(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """gid, nxt, code: how strongly nxt follows gid: both, right (nxt belongs to gid) or left (gid to nxt).

    pairs: one row for each airing of gid that an airing of nxt follows.
    """
    t = pairs.groupBy("gid", "nxt").agg(F.count(F.lit(1)).alias("k"))
    before = t.groupBy("nxt").agg(F.count(F.lit(1)).alias("n_before"))
    after = t.groupBy("gid").agg(F.count(F.lit(1)).alias("n_after"))
    a = info.select("gid", F.col("n").alias("na"), F.col("med").alias("ma"))
    b = info.select(F.col("gid").alias("nxt"), F.col("n").alias("nb"), F.col("med").alias("mb"))
    rows = t.join(a, "gid").join(b, "nxt").join(before, "nxt").join(after, "gid")
    rows = rows.where((F.col("gid") != F.col("nxt")) & (F.col("ma") < LONG) & (F.col("mb") < LONG))
    ab, ba = F.col("k") >= FIRM_SHARE * F.col("na"), F.col("k") >= FIRM_SHARE * F.col("nb")
    code = (
        F.when(ab & ba, "both")
        .when(ab & (F.col("n_before") <= MAX_FAMILY) & piece(F.col("mb"), F.col("ma")), "right")
        .when(~ab & ba & (F.col("n_after") <= MAX_FAMILY) & piece(F.col("ma"), F.col("mb")), "left")
    )
    return rows.select("gid", "nxt", code.alias("code")).where("code is not null")


def chain(groups: DataFrame, gap: int, takes: Column) -> DataFrame:
    """One pass of chaining over the groups that takes (a predicate on n and med) admits; the others stay as they are.

    An airing is adjacent to the next one of its run if that starts at most gap after its end and ends later.
    A run of airings is cut where a junction is missing, and at a left one right after a right one; airings of
    equal words (sequences of groups) are one group.
    """
    info = sizes(groups).where(takes)
    mine = groups.join(info.select("gid"), "gid", "left_semi")
    rest = groups.join(info.select("gid"), "gid", "left_anti")
    w = Window.partitionBy("run").orderBy("start", "gid", "end")
    nxt = F.lead(F.struct("gid", "start", "end")).over(w)
    rows = mine.withColumn("_n", nxt)
    adjacent = (F.col("_n.start") <= F.col("end") + gap) & (F.col("_n.end") > F.col("end"))
    rows = rows.withColumn("nxt", F.when(adjacent, F.col("_n.gid"))).drop("_n")
    codes = junctions(rows.where("nxt is not null").select("gid", "nxt"), info)
    rows = rows.join(codes, ["gid", "nxt"], "left")
    parted = F.col("code").isNull() | ((F.col("code") == "left") & (F.lag("code").over(w) == "right"))
    rows = rows.withColumn("_cut", F.when(F.coalesce(parted, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_word", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = F.transform(F.array_sort(F.collect_list(F.struct("start", "gid", "end"))), lambda x: x["gid"])
    words = rows.groupBy("run", "_word").agg(names.alias("names"), F.min("start").alias("start"), F.max("end").alias("end"))
    gid = F.when(F.size("names") == 1, F.element_at("names", 1)).otherwise(F.xxhash64("names"))
    return words.select(gid.alias("gid"), "run", "start", "end").unionByName(rest)
