"""Queries over events: event as airing, ts as start, value as length, user as channel or cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timeparse import epoch_us
from ..operators import timeline
from ..operators.classify import ladder
from ..operators.relational import connected_components, islands, range_join, upper_median

#: Seconds that are a break between one channel's airings.
TOLERANCE = 14_400


def airings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, us, s, d, e: whole seconds since 1970, lengths of a minute and up."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = epoch_us("ts")
    d = (F.floor(F.col("value") * 600) + 60).cast("long")
    return e.select("event_id", "user_id", "event_type", us.alias("us"), F.floor(us / 1_000_000).cast("long").alias("s"), d.alias("d")).withColumn("e", F.col("s") + F.col("d"))


AIRINGS = """a AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s,
  CAST(floor(value * 600) AS BIGINT) + 60 AS d, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) + 60 AS e FROM events)"""


def contiguity_breaks(spark, sf_dir):
    return timeline.contiguity(airings(spark, sf_dir), ["user_id"], "s", "e", ["event_id"], TOLERANCE).select("event_id", "gap", "kind")


CONTIGUITY = f"""WITH {AIRINGS}, g AS (SELECT event_id, s - lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM a)
SELECT event_id, gap, CASE WHEN gap IS NULL THEN 'first' WHEN gap > {TOLERANCE} THEN 'break' WHEN gap < -{TOLERANCE} THEN 'overlap' ELSE 'continuous' END AS kind FROM g"""


def run_ids(spark, sf_dir):
    return timeline.runs(airings(spark, sf_dir), ["user_id"], "s", "e", ["event_id"], TOLERANCE).select("event_id", "run_id")


RUNS = f"""WITH {AIRINGS}, g AS (SELECT event_id, user_id, s, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) > {TOLERANCE} THEN 1 ELSE 0 END AS b FROM a)
SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM g"""


def coverage_islands(spark, sf_dir):
    found = islands(airings(spark, sf_dir), "s", "e", ["user_id"])
    return found.groupBy("user_id", "island").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.count(F.lit(1)).alias("n"))


ISLANDS = f"""WITH {AIRINGS}, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, CAST(sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM r)
SELECT user_id, island, min(s) AS start_s, max(e) AS end_s, count(*) AS n FROM i GROUP BY ALL"""


def locate_span(spark, sf_dir):
    a = airings(spark, sf_dir)
    marks = a.where("event_type = 'signup'")
    found = timeline.locate(a, marks, ["user_id"], "us", F.struct("event_id", "us"), "event_id")
    return found.select("event_id", F.col("located.event_id").alias("span_event"), (F.col("us") - F.col("located.us")).alias("offset_us"))


LOCATE = f"""WITH {AIRINGS}, m AS (SELECT user_id, us, max(event_id) AS span_event FROM a WHERE event_type = 'signup' GROUP BY ALL)
SELECT a.event_id, m.span_event, a.us - m.us AS offset_us FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.us >= m.us"""


def minute_counts(a: DataFrame, cluster: str) -> DataFrame:
    """cluster, n, top: airings, and those of the commonest minute of the hour."""
    per = a.groupBy(cluster, F.floor(F.col("s") % 3600 / 60).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(cluster).agg(F.sum("c").alias("n"), F.max("c").alias("top"))


def minute_share(spark, sf_dir):
    m = minute_counts(airings(spark, sf_dir), "user_id")
    return m.select("user_id", "n", "top", F.round(F.col("top") / F.col("n"), 9).alias("share"), ((F.col("n") >= 4) & (F.col("top") >= 0.8 * F.col("n"))).alias("hourly"))


MINUTE = f"""WITH {AIRINGS}, c AS (SELECT user_id, (s % 3600) // 60 AS minute, count(*) AS c FROM a GROUP BY ALL),
m AS (SELECT user_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM c GROUP BY ALL)
SELECT user_id, n, top, round(top / n, 9) AS share, n >= 4 AND top >= 0.8 * n AS hourly FROM m"""


def company(spark, sf_dir):
    a = airings(spark, sf_dir)
    met = timeline.accompanied(a, "event_id", "event_type", "s", "e", 2, 120).withColumn("accompanied", F.lit(True))
    return a.select("event_id").join(met, "event_id", "left").select("event_id", F.coalesce("accompanied", F.lit(False)).alias("accompanied"))


COMPANY = f"""WITH {AIRINGS} SELECT event_id,
 EXISTS (SELECT 1 FROM a b WHERE b.event_type <> a.event_type AND b.e > a.s - 2 AND b.e <= a.s + 2 AND b.s >= a.s - 120)
 OR EXISTS (SELECT 1 FROM a b WHERE b.event_type <> a.event_type AND b.s BETWEEN a.e - 2 AND a.e + 2 AND b.s >= a.s - 120) AS accompanied FROM a"""


def followed_pairs(spark, sf_dir):
    return timeline.followed(airings(spark, sf_dir), "event_type", "s", "e", 1, 120)


FOLLOWED = f"""WITH {AIRINGS} SELECT x.event_type AS i, y.event_type AS j, count(*) AS n FROM a x JOIN a y
 ON y.s BETWEEN x.e - 1 AND x.e + 120 AND x.event_type <> y.event_type GROUP BY ALL"""

GAP = 7200


def adjacent(a: DataFrame) -> DataFrame:
    """Per user: this event's type and the next's, if it starts within GAP of the end and ends later."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    nxt = F.lead(F.struct("event_type", "s", "e")).over(w)
    rows = a.withColumn("nxt", nxt)
    return rows.where((F.col("nxt.s") <= F.col("e") + GAP) & (F.col("nxt.e") > F.col("e"))).select(F.col("event_type").alias("g"), F.col("nxt.event_type").alias("h"))


def next_transition(spark, sf_dir):
    return adjacent(airings(spark, sf_dir)).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))


ADJACENT = f"""{AIRINGS}, l AS (SELECT event_type AS g, e, lead(event_type) OVER w AS h, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM a WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
t AS (SELECT g, h, count(*) AS n FROM l WHERE ns <= e + {GAP} AND ne > e GROUP BY ALL)"""
TRANSITION = f"WITH {ADJACENT} SELECT g, h, n FROM t"


def firm_share(spark, sf_dir):
    a = airings(spark, sf_dir)
    t = adjacent(a).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    size = a.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
    before = t.groupBy("h").agg(F.count(F.lit(1)).alias("n_before"))
    after = t.groupBy("g").agg(F.count(F.lit(1)).alias("n_after"))
    out = t.join(F.broadcast(size.withColumnsRenamed({"event_type": "g", "size": "size_g"})), "g").join(F.broadcast(size.withColumnsRenamed({"event_type": "h", "size": "size_h"})), "h")
    out = out.join(before, "h").join(after, "g")
    return out.select("g", "h", "n", "n_before", "n_after", (F.col("n") >= 0.1 * F.col("size_g")).alias("firm_after"), (F.col("n") >= 0.1 * F.col("size_h")).alias("firm_before"))


FIRM = f"""WITH {ADJACENT}, z AS (SELECT event_type, count(*) AS size FROM a GROUP BY ALL)
SELECT t.g, t.h, t.n, (SELECT count(*) FROM t u WHERE u.h = t.h) AS n_before, (SELECT count(*) FROM t u WHERE u.g = t.g) AS n_after,
 t.n >= 0.1 * x.size AS firm_after, t.n >= 0.1 * y.size AS firm_before FROM t JOIN z x ON x.event_type = t.g JOIN z y ON y.event_type = t.h"""


def unit_components(spark, sf_dir):
    a = airings(spark, sf_dir)
    pairs = timeline.followed(a, "user_id", "s", "e", 1, 30).where("n >= 2").select(F.col("i").alias("a"), F.col("j").alias("b"))
    found = connected_components(pairs)
    lone = a.select(F.col("user_id").alias("node")).distinct()
    return lone.join(found, "node", "left").select(F.col("node").alias("user_id"), F.coalesce("component", "node").alias("root"))


UNITS = f"""WITH RECURSIVE {AIRINGS}, p AS (SELECT x.user_id AS i, y.user_id AS j FROM a x JOIN a y ON y.s BETWEEN x.e - 1 AND x.e + 30 AND x.user_id <> y.user_id GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r(n, m) AS (SELECT DISTINCT user_id, user_id FROM a UNION SELECT r.n, g.j FROM r JOIN g ON g.i = r.m)
SELECT n AS user_id, min(m) AS root FROM r GROUP BY n"""


def lengths(a: DataFrame) -> DataFrame:
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), upper_median("d").cast("long").alias("d"))


def upper_median_len(spark, sf_dir):
    return lengths(airings(spark, sf_dir)).select("user_id", "n", F.col("d").alias("median_d"))


MEDIAN = f"WITH {AIRINGS} SELECT user_id, count(*) AS n, list_sort(list(d))[len(list(d)) // 2 + 1] AS median_d FROM a GROUP BY ALL"


def reference_airing(spark, sf_dir):
    a = airings(spark, sf_dir)
    med = lengths(a).select("user_id", F.col("d").alias("med"))
    best = F.min(F.struct(F.abs(F.col("d") - F.col("med")).alias("off"), "us", "event_id", "d"))
    return a.join(med, "user_id").groupBy("user_id").agg(best.alias("m")).select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.d").alias("d"))


REFERENCE = f"""WITH {AIRINGS}, m AS (SELECT user_id, list_sort(list(d))[len(list(d)) // 2 + 1] AS med FROM a GROUP BY ALL),
r AS (SELECT a.user_id, event_id, d, row_number() OVER (PARTITION BY a.user_id ORDER BY abs(d - med), us, event_id) AS k FROM a JOIN m ON a.user_id = m.user_id)
SELECT user_id, event_id, d FROM r WHERE k = 1"""


def histogram(spark, sf_dir):
    edges = [60, 600, 1800, 3600, 7200, 14400, 28800]
    a = airings(spark, sf_dir)
    bucket = sum((F.when(F.col("d") >= x, 1).otherwise(0) for x in edges[1:]), F.lit(0))
    return a.groupBy("event_type", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total_d"))


HISTOGRAM = f"""WITH {AIRINGS} SELECT event_type, CAST((d >= 600)::INT + (d >= 1800)::INT + (d >= 3600)::INT + (d >= 7200)::INT + (d >= 14400)::INT + (d >= 28800)::INT AS BIGINT) AS bucket,
 count(*) AS n, CAST(sum(d) AS BIGINT) AS total_d FROM a GROUP BY ALL"""


def spanning_count(spark, sf_dir):
    a = airings(spark, sf_dir)
    return timeline.spanning(a.select("user_id", "event_id", "s"), a, ["user_id"], "s", "s", "e", 10).select("event_id", F.col("n_spanning").cast("long").alias("n_spanning"))


SPANNING = f"""WITH {AIRINGS} SELECT event_id, (SELECT count(*) FROM a b WHERE b.user_id = a.user_id AND b.s <= a.s - 10) -
 (SELECT count(*) FROM a b WHERE b.user_id = a.user_id AND b.e <= a.s + 10) AS n_spanning FROM a"""


def neighbourhood_votes(spark, sf_dir):
    votes = airings(spark, sf_dir).groupBy("user_id", F.floor(F.col("s") / 3600).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.neighbourhood(votes, ["user_id"], "hour", "n", 6)


VOTES = f"""WITH {AIRINGS}, v AS (SELECT user_id, s // 3600 AS hour, count(*) AS n FROM a GROUP BY ALL)
SELECT user_id, hour, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS BIGINT) AS n_near FROM v"""


def top_spots(spark, sf_dir):
    per = airings(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.floor(F.col("s") / 86400)).alias("days"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    return per.orderBy(F.desc("n"), "user_id").limit(15)


TOP = f"WITH {AIRINGS} SELECT user_id, count(*) AS n, count(DISTINCT s // 86400) AS days, min(s) AS first_s, max(s) AS last_s FROM a GROUP BY ALL ORDER BY n DESC, user_id LIMIT 15"


def props_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.from_json("props", "k long")["k"]
    return e.groupBy("event_type", F.floor(k / 10).cast("long").alias("k10")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"))


JSON = """WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, CAST(floor(k / 10) AS BIGINT) AS k10, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM p GROUP BY ALL"""


def classify(spark, sf_dir):
    """The verdict ladder over (user, type) as cluster, a minute of the data as a second of the rule."""
    a = airings(spark, sf_dir).withColumn("cluster", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).withColumn("d", F.floor(F.col("d") / 60).cast("long"))
    units = a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), upper_median("d").cast("long").alias("d"))
    near = timeline.accompanied(a, "event_id", "cluster", "s", "e", 2, 120)
    met = a.join(near, "event_id", "left_semi").select("cluster").distinct().withColumn("accompanied", F.lit(True))
    rows = units.join(minute_counts(a, "cluster").select("cluster", "top"), "cluster").join(met, "cluster", "left")
    rows = rows.select("cluster", "n", "d", F.col("d").alias("unit"), "top", F.coalesce("accompanied", F.lit(False)).alias("accompanied"))
    return ladder(rows).select("cluster", "n", "d", "is_spot", "rule")


CLASSIFY = f"""WITH {AIRINGS}, c AS (SELECT event_id, CAST(user_id AS VARCHAR) || '/' || event_type AS cluster, s, e, d // 60 AS d FROM a),
u AS (SELECT cluster, count(*) AS n, list_sort(list(d))[len(list(d)) // 2 + 1] AS d FROM c GROUP BY ALL),
m AS (SELECT cluster, max(k) AS top FROM (SELECT cluster, (s % 3600) // 60 AS minute, count(*) AS k FROM c GROUP BY ALL) GROUP BY ALL),
w AS (SELECT DISTINCT cluster FROM c WHERE EXISTS (SELECT 1 FROM c b WHERE b.cluster <> c.cluster AND b.e > c.s - 2 AND b.e <= c.s + 2 AND b.s >= c.s - 120) OR EXISTS (SELECT 1 FROM c b WHERE b.cluster <> c.cluster AND b.s BETWEEN c.e - 2 AND c.e + 2))
SELECT u.cluster, u.n, u.d, NOT (u.d > 120 OR u.d < 8 OR (u.n >= 4 AND m.top >= 0.8 * u.n)) AS is_spot,
 CASE WHEN u.d > 120 THEN 'long unit' WHEN u.d < 8 THEN 'short' WHEN u.n >= 4 AND m.top >= 0.8 * u.n THEN 'hourly' WHEN w.cluster IS NOT NULL THEN 'accompanied' ELSE 'alone' END AS rule
FROM u JOIN m ON u.cluster = m.cluster LEFT JOIN w ON u.cluster = w.cluster"""


def overlap_pairs(spark, sf_dir):
    """Range join: pairs of one user's events of different types whose airings overlap, counted."""
    a = airings(spark, sf_dir)
    left = a.where("event_type = 'purchase'").select("user_id", F.col("s").alias("a"), F.col("e").alias("b"))
    right = a.where("event_type <> 'purchase'").select("user_id", F.col("s").alias("c"), F.col("e").alias("d"), "event_type")
    shared = F.least("b", "d") - F.greatest("a", "c")
    return range_join(left, right, ("a", "b"), ("c", "d"), 14_400, ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(shared).alias("shared_s"))


OVERLAP = f"""WITH {AIRINGS} SELECT y.event_type, count(*) AS n, CAST(sum(least(x.e, y.e) - greatest(x.s, y.s)) AS BIGINT) AS shared_s FROM a x JOIN a y
 ON x.user_id = y.user_id AND x.event_type = 'purchase' AND y.event_type <> 'purchase' AND x.s < y.e AND y.s < x.e GROUP BY ALL"""


QUERIES = {
    "ev_contiguity_breaks": (contiguity_breaks, CONTIGUITY),
    "ev_run_ids": (run_ids, RUNS),
    "ev_coverage_islands": (coverage_islands, ISLANDS),
    "ev_locate_span": (locate_span, LOCATE),
    "ev_minute_share": (minute_share, MINUTE),
    "ev_company_semi": (company, COMPANY),
    "ev_followed_pairs": (followed_pairs, FOLLOWED),
    "ev_next_transition": (next_transition, TRANSITION),
    "ev_firm_share": (firm_share, FIRM),
    "ev_unit_components": (unit_components, UNITS),
    "ev_classify": (classify, CLASSIFY),
    "ev_upper_median_len": (upper_median_len, MEDIAN),
    "ev_reference_airing": (reference_airing, REFERENCE),
    "ev_histogram": (histogram, HISTOGRAM),
    "ev_spanning_count": (spanning_count, SPANNING),
    "ev_neighbourhood_votes": (neighbourhood_votes, VOTES),
    "ev_top_spots": (top_spots, TOP),
    "ev_props_json": (props_json, JSON),
    "ev_overlap_pairs": (overlap_pairs, OVERLAP),
}
