"""Relational helpers that the other operators are composed of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import drop_tables, written


def range_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], bucket: float, keys: list[str] = (), how: str = "inner") -> DataFrame:
    """Joins rows whose half-open spans overlap (and whose keys are equal), by buckets of the axis.

    Each side is repeated for the buckets that it touches, which makes the join an equi-join that shuffles
    and can be split; a pair is reported in the first bucket that both touch, so once. Choose the bucket
    near the usual length. Columns of both sides must differ but for the keys. how: inner or left_semi, which
    gives distinct rows.
    """
    (a, b), (c, d) = left_span, right_span
    first = lambda s: F.floor(F.col(s) / bucket).cast("long")
    last = lambda s, e: F.greatest(first(s), F.ceil(F.col(e) / bucket).cast("long") - 1)
    lt = left.withColumn("_lf", first(a)).withColumn("_bucket", F.explode(F.sequence("_lf", last(a, b))))
    rt = right.withColumn("_rf", first(c)).withColumn("_bucket", F.explode(F.sequence("_rf", last(c, d))))
    on = ["_bucket", *keys]
    overlap = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    if how == "left_semi":
        cond = [lt[k] == rt[k] for k in on]
        cond += [F.col(a) < F.col(d), F.col(c) < F.col(b)]
        return lt.join(rt, cond, "left_semi").drop("_bucket", "_lf").distinct()
    out = lt.join(rt, on).where(overlap & (F.col("_bucket") == F.greatest("_lf", "_rf")))
    return out.drop("_bucket", "_lf", "_rf")


def islands(df: DataFrame, start: str, end: str, by: list[str], gap: float = 0, out: str = "island") -> DataFrame:
    """Numbers the islands of overlapping or touching spans (at most gap apart) within each group, from 0."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach + gap, 0).otherwise(1)
    df = df.withColumn("_new", new)
    return df.withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def upper_median(column: str) -> Column:
    """The upper median of a group: of an even number of values the greater middle one.

    ``percentile_disc`` has the lower one; taken over negated values it is the upper one.
    """
    return -F.expr(f"percentile_disc(0.5) within group (order by -{column})")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges.

    Alternates large-star and small-star steps, which keep the number of edges linear and converge in a
    logarithmic number of rounds. Each round is a table in the shared folder; nothing is collected but
    its count and checksum. Hubs meet partial aggregations and joins that AQE can split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = written(e, "edges"), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(small, "edges")
        got = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_tables(now)
        now = nxt
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
