"""Queries over the star schema: interval and band joins, a baseline join."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_overlap(spark, sf_dir):
    """Per order the line whose thirty days from shipping overlap most with sixty days from ordering; ties: first line."""
    day = lambda c: F.expr(f"timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("a"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), day("l_shipdate").alias("c"))
    shared = F.least(F.col("a") + 60, F.col("c") + 30) - F.greatest("a", "c")
    rows = o.join(li, "k").withColumn("shared", shared).where("shared > 0")
    w = Window.partitionBy("k").orderBy(F.desc("shared"), "line", "part")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("k").alias("orderkey"), F.col("line").cast("long").alias("line"), "part", F.col("shared").cast("long").alias("shared"))


OVERLAP = """WITH o AS (SELECT o_orderkey AS k, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS a FROM orders),
l AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS c FROM lineitem),
j AS (SELECT o.k, line, part, least(a + 60, c + 30) - greatest(a, c) AS shared FROM o JOIN l ON o.k = l.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, line, part) AS n FROM j WHERE shared > 0)
SELECT k AS orderkey, CAST(line AS BIGINT) AS line, part, CAST(shared AS BIGINT) AS shared FROM r WHERE n = 1"""


def near_length(spark, sf_dir):
    """Pairs of parts of one brand and size whose prices lie within 0.4, by a banded self-join in cents."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    left = p.select(F.col("p_partkey").alias("x"), "p_brand", "p_size", F.col("c").alias("cx"), F.explode(F.expr("sequence((c - 40) div 41, (c + 40) div 41)")).alias("b"))
    right = p.select(F.col("p_partkey").alias("y"), "p_brand", "p_size", F.col("c").alias("cy"), F.expr("c div 41").alias("b"))
    pairs = left.join(right, ["p_brand", "p_size", "b"]).where("x < y and abs(cx - cy) <= 40")
    return pairs.groupBy("p_brand").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs(F.col("cx") - F.col("cy"))).alias("sum_cents"))


NEAR = """WITH p AS (SELECT p_partkey, p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)
SELECT a.p_brand, count(*) AS pairs, CAST(sum(abs(a.c - b.c)) AS BIGINT) AS sum_cents FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.c - b.c) <= 40 GROUP BY ALL"""


def star_join(spark, sf_dir):
    t = lambda n, *c: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c)
    li = t("lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    o = t("orders", "o_orderkey", "o_custkey")
    c = t("customer", "c_custkey", "c_nationkey").join(t("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("r_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


STAR = """SELECT r_name, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""

QUERIES = {
    "ord_interval_best_overlap": (best_overlap, OVERLAP),
    "part_near_price_pairs": (near_length, NEAR),
    "ref_star_join": (star_join, STAR),
}
