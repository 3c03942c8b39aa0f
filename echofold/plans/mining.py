"""Queries over the operators of a mining run: on matches, cuts and airings that stand for events, and on a generated broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import shared_dir, written
from ..functions.timeparse import NAME_PATTERNS, name_time
from ..kernels.dsp import BANDS, FPS
from ..operators import boundaries, chains, refine, search
from ..operators.grouping import fold
from ..operators.relational import connected_components
from . import evaluate
from .events import AIRINGS, airings
from .mine import classified, emitted, lay, mine_axis
from .options import Options

TOL = boundaries.TOL


# ---- matches that stand for events: ten minutes of the data are a frame
def pieces(spark, sf_dir) -> DataFrame:
    """Verified pieces of 40 pairs of runs."""
    a = airings(spark, sf_dir)
    start = F.floor(F.col("s") / 600).cast("long")
    run = F.col("user_id") % 40
    return a.select(
        start.alias("a_start"), (start + 60 + F.col("event_id") % 140).alias("a_end"), (700 + 3 * (F.col("event_id") % 12)).alias("lag"),
        ((50 + F.col("event_id") % 50) / 100).alias("sim"), run.alias("ra"), run.alias("rb"),
    )


PIECES = f"""{AIRINGS}, pc AS (SELECT s // 600 AS a_start, s // 600 + 60 + event_id % 140 AS a_end, 700 + 3 * (event_id % 12) AS lag, (50 + event_id % 50) / 100 AS sim, user_id % 40 AS ra, user_id % 40 AS rb FROM a)"""


def dedupe(spark, sf_dir):
    return search.deduped(pieces(spark, sf_dir)).select("a_start", "a_end", "lag", "sim", "ra", "rb")


DEDUPE = f"""WITH {PIECES}, r AS (SELECT *, floor((lag + 5) / 10) AS key FROM pc),
e AS (SELECT *, max(a_end) OVER (PARTITION BY key, ra, rb ORDER BY a_start, a_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN a_start <= reach + {search.TOL} THEN 0 ELSE 1 END) OVER (PARTITION BY key, ra, rb ORDER BY a_start, a_end ROWS UNBOUNDED PRECEDING) AS island FROM e),
f AS (SELECT ra, rb, key, island, max(a_end) AS top, min({{'s': a_start, 'l': lag, 'e': a_end, 'm': sim}}) AS m FROM i GROUP BY ALL)
SELECT m.s AS a_start, top AS a_end, m.l AS lag, m.m AS sim, ra, rb FROM f"""


def parted(spark, sf_dir) -> DataFrame:
    """Each event a repeat of its own runs that a dropout has parted in two or three; every fifth piece lies at another lag."""
    a = airings(spark, sf_dir).select("event_id", F.floor(F.col("s") / 600).cast("long").alias("x"))
    rows = a.select("event_id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)).alias("k"))
    start = F.col("x") + F.col("k") * (230 + F.col("event_id") % 60)
    shift = F.when((F.col("k") > 0) & (F.col("event_id") % 5 == 0), 26).otherwise(F.col("k") * 2)
    zero = F.lit(0).cast("long")
    return rows.select(start.alias("a_start"), (start + 200).alias("a_end"), (1000 + shift).cast("long").alias("lag"), zero.alias("split"), zero.alias("lag2"), F.lit(0.5).alias("sim"), F.col("event_id").alias("ra"), F.col("event_id").alias("rb"))


def bridge(spark, sf_dir):
    found = search.bridged(parted(spark, sf_dir), 6000)
    return found.select("ra", "a_start", "a_end", "lag", "split", "lag2", F.round("sim", 6).alias("sim"))


BRIDGE = f"""WITH {AIRINGS}, x AS (SELECT event_id AS ra, s // 600 AS x, event_id % 3 AS n, 230 + event_id % 60 AS step, event_id % 5 = 0 AND event_id % 3 > 0 AS late FROM a)
SELECT ra, x AS a_start, x + n * step + 200 AS a_end, 1000::BIGINT AS lag, CASE WHEN late THEN x + step ELSE 0 END AS split, CASE WHEN late THEN 1026 ELSE 0 END::BIGINT AS lag2, 0.5::DOUBLE AS sim FROM x"""


# ---- matches that vote for cuts
def matched(spark, sf_dir) -> DataFrame:
    """Matches between 30 runs; every eleventh is long."""
    a = airings(spark, sf_dir)
    start = (F.col("s") / 300).cast("long")
    size = F.when(F.col("event_id") % 11 == 0, 1500).otherwise(60 + F.col("event_id") % 140)
    zero = F.lit(0).cast("long")
    return a.select(
        start.alias("a_start"), (start + size).cast("long").alias("a_end"), (700 + 40 * (F.col("event_id") % 12)).alias("lag"), zero.alias("split"), zero.alias("lag2"),
        F.lit(0.9).alias("sim"), (F.col("user_id") % 30).alias("ra"), (F.col("user_id") % 30 + F.col("event_id") % 2).alias("rb"),
    ).distinct()


MATCHED = f"""{AIRINGS}, q AS (SELECT DISTINCT s // 300 AS a_start, s // 300 + CASE WHEN event_id % 11 = 0 THEN 1500 ELSE 60 + event_id % 140 END AS a_end, 700 + 40 * (event_id % 12) AS lag,
 user_id % 30 AS ra, user_id % 30 + event_id % 2 AS rb FROM a),
m0 AS (SELECT *, a_start - lag AS b_start, a_end - lag AS b_end, a_end - a_start AS len FROM q),
m AS (SELECT * FROM m0 WHERE NOT EXISTS (SELECT 1 FROM m0 h WHERE h.len >= {boundaries.HOST_MIN} AND h.ra = m0.ra AND h.rb = m0.rb AND h.a_start <= m0.a_start AND m0.a_end <= h.a_end
 AND h.b_start <= m0.b_start AND m0.b_end <= h.b_end AND h.len >= floor(m0.len * 3 / 2) AND abs(h.lag - m0.lag) > {TOL}))"""


def internal(spark, sf_dir):
    return boundaries.without_internal(matched(spark, sf_dir)).select("ra", "rb", "a_start", "a_end", "lag", "len")


def binning(votes: str, name: str) -> str:
    """SQL: greedy bins of the distinct votes, as name(run, pos, events): the next bin begins at the first vote beyond a bin's reach."""
    return f"""{name}v AS (SELECT DISTINCT run, pos, near, far FROM {votes}),
{name}f(run, first) AS (SELECT run, min(pos) FROM {name}v GROUP BY run UNION ALL SELECT f.run, min(v.pos) FROM {name}f f JOIN {name}v v ON v.run = f.run AND v.pos > f.first + {TOL} GROUP BY f.run, f.first),
{name} AS (SELECT v.run, CAST(floor(avg(v.pos)) AS BIGINT) AS pos, list_sort(list(DISTINCT {{'near': v.near, 'far': v.far}})) AS events FROM {name}v v ASOF JOIN {name}f f ON v.run = f.run AND v.pos >= f.first GROUP BY v.run, f.first)"""


VOTES = """w AS (SELECT ra AS run, a_start AS pos, a_start AS near, b_start AS far FROM m UNION ALL SELECT ra, a_end, a_end, b_end FROM m UNION ALL SELECT rb, b_start, b_start, a_start FROM m UNION ALL SELECT rb, b_end, b_end, a_end FROM m)"""
SIDES = """sd AS (SELECT ra AS run, a_start AS s, a_end AS e FROM m UNION ALL SELECT rb, b_start, b_end FROM m)"""
BINNED = f"{MATCHED}, {VOTES}, {binning('w', 'c1')}"
CARRIED = f"""{BINNED}, cr AS (SELECT rb AS run, pos - lag AS pos, unnest(events, recursive := true) FROM m JOIN c1 ON c1.run = ra AND pos >= a_start + {TOL} + 1 AND pos < a_end - {TOL}
 UNION ALL SELECT ra, pos + lag, unnest(events, recursive := true) FROM m JOIN c1 ON c1.run = rb AND pos >= b_start + {TOL} + 1 AND pos < b_end - {TOL}),
w2 AS (SELECT * FROM w UNION ALL SELECT * FROM cr), {binning('w2', 'c2')}"""
APART = f"""len(events) >= 2 AND NOT (abs(events[1].near - pos) > {TOL} AND len(list_filter(events[2:], lambda e: abs(e.near - events[1].near) <= {TOL} OR abs(e.far - events[1].near) <= {TOL})) = len(events) - 1)
 AND NOT (abs(events[1].far - pos) > {TOL} AND len(list_filter(events[2:], lambda e: abs(e.near - events[1].far) <= {TOL} OR abs(e.far - events[1].far) <= {TOL})) = len(events) - 1)"""
KEPT = f"""{CARRIED}, {SIDES},
cn AS (SELECT run, pos, events, len(events) AS n, (SELECT count(*) FROM sd WHERE sd.run = c2.run AND sd.s + {TOL} <= pos) - (SELECT count(*) FROM sd WHERE sd.run = c2.run AND sd.e - {TOL} <= pos) AS span,
 sum(len(events)) OVER (PARTITION BY run ORDER BY pos RANGE BETWEEN {boundaries.PEAK_REACH} PRECEDING AND {boundaries.PEAK_REACH} FOLLOWING) AS n_near FROM c2),
kc AS (SELECT run, pos FROM cn WHERE span <= 0 OR (n >= greatest(2, ceil({boundaries.SUPPORT} * span)) AND n >= {boundaries.PEAK_SHARE} * n_near AND {APART}))"""
SEGMENTS = f"""{KEPT}, se AS (SELECT *, max(e) OVER (PARTITION BY run ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sd),
si AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM se),
sl AS (SELECT run, island, min(s) - {TOL} AS lo, max(e) + {TOL} + 1 AS hi FROM si GROUP BY ALL),
sp AS (SELECT DISTINCT sl.run, island, pos AS s, lead(pos) OVER (PARTITION BY sl.run, island ORDER BY pos) AS e FROM sl JOIN (SELECT DISTINCT run, pos FROM kc) k ON k.run = sl.run AND pos >= lo AND pos < hi),
sg AS (SELECT DISTINCT run, s, e, s * 1048576 + least(e - s, 1048575) AS id FROM sp WHERE e IS NOT NULL)"""
EDGES = f"""{SEGMENTS}, et AS (SELECT DISTINCT id, rb AS run, sg.s - lag AS ts, sg.e - lag AS te FROM m JOIN sg ON sg.run = m.ra AND sg.s < a_end AND a_start - len // 4 < sg.e
 WHERE sg.s >= a_start - len // 4 AND sg.s < a_end - {TOL} AND least(sg.e, a_end) - greatest(sg.s, a_start) >= {boundaries.TRIMMED} * (sg.e - sg.s)),
en AS (SELECT *, te - ts AS n, greatest({TOL}, (te - ts) // 20) AS tol FROM et),
em AS (SELECT en.id, en.run, ts, te, g.id AS dest, g.s, g.e, CASE WHEN abs(g.s - ts) <= tol AND abs(g.e - te) <= tol THEN 1
  WHEN g.s >= te - floor(5 * n / 4) AND g.s <= ts + tol AND g.e >= te - tol AND n >= {boundaries.TRIMMED} * (g.e - g.s) THEN 2
  WHEN g.s >= ts - tol AND g.s < te AND g.e <= te + tol AND g.e - g.s >= {boundaries.TRIMMED} * n THEN 3 END AS tier
  FROM en JOIN sg g ON g.run = en.run AND ts - tol < g.e AND g.s < te + tol),
eb AS (SELECT *, row_number() OVER (PARTITION BY id, run, ts, te ORDER BY tier, s, e) AS k FROM em WHERE tier IS NOT NULL),
ed AS (SELECT DISTINCT id AS a, dest AS b FROM eb WHERE k = 1 AND id <> dest)"""
GROUPS = f"""{EDGES}, gg AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), gr(n, z) AS (SELECT DISTINCT a, a FROM gg UNION SELECT gr.n, gg.b FROM gr JOIN gg ON gg.a = gr.z),
gc AS (SELECT n, min(z) AS gid FROM gr GROUP BY n)"""


def first_bins(m: DataFrame) -> DataFrame:
    return boundaries.binned(boundaries.votes(m))


def match_bins(spark, sf_dir):
    return first_bins(boundaries.without_internal(matched(spark, sf_dir))).select("run", "pos", F.size("events").cast("long").alias("n"))


def carried_votes(spark, sf_dir):
    m = written(boundaries.without_internal(matched(spark, sf_dir)), "matched")
    return boundaries.carried(first_bins(m), m).groupBy("run", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("near") - F.col("far")).alias("sum_gap"))


def cuts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept cuts, the spans of both sides, and the matches."""
    m = written(boundaries.without_internal(matched(spark, sf_dir)), "matched")
    return written(boundaries.cut(m), "cuts"), boundaries.sides(m), m


def kept_cuts(spark, sf_dir):
    return cuts(spark, sf_dir)[0]


def segments(spark, sf_dir):
    kept, spans, _ = cuts(spark, sf_dir)
    return boundaries.segments(kept, spans).select("run", F.col("start").alias("s"), F.col("end").alias("e"))


def segment_edges(spark, sf_dir):
    kept, spans, m = cuts(spark, sf_dir)
    return boundaries.edges(m, boundaries.segments(kept, spans))


def atomic_groups(spark, sf_dir):
    return boundaries.atomic_groups(matched(spark, sf_dir)).select("gid", "run", F.col("start").alias("s"), F.col("end").alias("e"))


# ---- groups of airings
def grouped(spark, sf_dir) -> DataFrame:
    """Each type of event a group, each user a run; short airings, so that some follow each other."""
    a = airings(spark, sf_dir).where("event_id % 3 < 2")
    return a.select(F.ascii("event_type").cast("long").alias("gid"), F.col("user_id").alias("run"), F.floor(F.col("s") / 60).cast("long").alias("start"), (F.floor(F.col("s") / 60) + 40 + F.col("event_id") % 90).cast("long").alias("end")).distinct()


GROUPED = f"""{AIRINGS}, g0 AS (SELECT DISTINCT ascii(event_type)::BIGINT AS gid, user_id AS run, s // 60 AS start, s // 60 + 40 + event_id % 90 AS stop FROM a WHERE event_id % 3 < 2)"""
CHAIN_GAP = 400


def chain(spark, sf_dir):
    """Words of groups that follow each other; a word's group by its size and its first airing."""
    out = chains.chain(grouped(spark, sf_dir), CHAIN_GAP, (F.col("n") >= 2) & (F.col("med") > 10))
    w = Window.partitionBy("gid")
    return out.select("run", F.col("start").alias("s"), F.col("end").alias("e"), F.count(F.lit(1)).over(w).alias("n"), F.min("start").over(w).alias("first_s"))


CHAIN = f"""WITH {GROUPED}, z AS (SELECT gid, count(*) AS n, list_sort(list(stop - start))[len(list(stop)) // 2 + 1] AS med FROM g0 GROUP BY gid),
mine AS (SELECT g0.* FROM g0 JOIN z ON z.gid = g0.gid AND z.n >= 2 AND z.med > 10), rest AS (SELECT g0.* FROM g0 JOIN z ON z.gid = g0.gid AND NOT (z.n >= 2 AND z.med > 10)),
l AS (SELECT *, lead(gid) OVER w AS ng, lead(start) OVER w AS ns, lead(stop) OVER w AS ne FROM mine WINDOW w AS (PARTITION BY run ORDER BY start, gid, stop)),
x AS (SELECT * EXCLUDE (ng), CASE WHEN ns <= stop + {CHAIN_GAP} AND ne > stop THEN ng END AS nxt FROM l),
t AS (SELECT gid, nxt, count(*) AS k FROM x WHERE nxt IS NOT NULL GROUP BY ALL),
j AS (SELECT t.*, p.n AS na, p.med AS ma, q.n AS nb, q.med AS mb, (SELECT count(*) FROM t u WHERE u.nxt = t.nxt) AS n_before, (SELECT count(*) FROM t u WHERE u.gid = t.gid) AS n_after FROM t JOIN z p ON p.gid = t.gid JOIN z q ON q.gid = t.nxt),
c AS (SELECT gid, nxt, CASE WHEN k >= {chains.FIRM_SHARE} * na AND k >= {chains.FIRM_SHARE} * nb THEN 'both'
  WHEN k >= {chains.FIRM_SHARE} * na AND n_before <= {chains.MAX_FAMILY} AND (mb < ma OR (mb < {chains.SMALL} AND 2 * ma >= mb)) THEN 'right'
  WHEN k < {chains.FIRM_SHARE} * na AND k >= {chains.FIRM_SHARE} * nb AND n_after <= {chains.MAX_FAMILY} AND (ma < mb OR (ma < {chains.SMALL} AND 2 * mb >= ma)) THEN 'left' END AS code
  FROM j WHERE gid <> nxt AND ma < {chains.LONG} AND mb < {chains.LONG}),
y AS (SELECT x.*, c.code FROM x LEFT JOIN c ON c.gid = x.gid AND c.nxt = x.nxt AND c.code IS NOT NULL),
v AS (SELECT *, CASE WHEN code IS NULL OR (code = 'left' AND lag(code) OVER (PARTITION BY run ORDER BY start, gid, stop) = 'right') THEN 1 ELSE 0 END AS cut FROM y),
o AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY run ORDER BY start, gid, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word FROM v),
r AS (SELECT string_agg(gid, ',' ORDER BY start, gid, stop) AS names, run, min(start) AS s, max(stop) AS e FROM o GROUP BY run, word UNION ALL SELECT gid::VARCHAR, run, start, stop FROM rest)
SELECT run, s, e, count(*) OVER (PARTITION BY names) AS n, min(s) OVER (PARTITION BY names) AS first_s FROM r"""


def spaced(spark, sf_dir):
    """Airings of a user that do not begin before the middle of the last one kept."""
    a = airings(spark, sf_dir)
    rows = a.select(F.col("user_id").alias("gid"), F.lit(0).cast("long").alias("run"), F.col("s").alias("start"), (F.col("s") + 40 * F.col("d")).alias("end")).distinct()
    return fold(rows, ["gid"], ["start", "end"], refine.spaced, refine.GROUP).select("gid", F.col("start").alias("s"), F.col("end").alias("e"))


SPACED = f"""WITH RECURSIVE {AIRINGS}, g AS (SELECT DISTINCT user_id AS gid, s, s + 40 * d AS e FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s, e) AS k FROM g),
r(gid, k, s, e) AS (SELECT gid, k, s, e FROM o WHERE k = 1 UNION ALL
 SELECT n.gid, n.k, n.s, n.e FROM (SELECT r.gid AS gid, min(o.k) AS k FROM r JOIN o ON o.gid = r.gid AND o.k > r.k AND o.s >= (r.s + r.e) // 2 GROUP BY r.gid, r.k) f JOIN o n ON n.gid = f.gid AND n.k = f.k)
SELECT gid, s, e FROM r"""


def union_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of users, each at a place of its own; those of equal remainder by seven are chained to the next but one and next."""
    n = airings(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("at"))
    step = F.explode(F.array(F.lit(7), F.lit(14))).alias("step")
    left = n.where("user_id % 7 < 5").select(F.col("user_id").alias("i"), F.col("n").alias("ni"), F.col("at").alias("ai"), step)
    right = n.select(F.col("user_id").alias("j"), F.col("n").alias("nj"), F.col("at").alias("aj"))
    met = left.join(right, F.col("j") == F.col("i") + F.col("step"))
    return met.select("i", "j", (100 + (F.col("i") * 31 + F.col("step")) % 57).alias("shared"), (F.col("aj") - F.col("ai")).alias("shift"), "ni", "nj")


def weighted_union(spark, sf_dir):
    pairs = written(union_pairs(spark, sf_dir), "pairs")
    parts = connected_components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return fold(pairs.join(parts, pairs["i"] == parts["node"]), ["component"], ["i", "j"], refine.weighted_union, "idx long, root long, off long")


#: Pairs place their groups consistently, so that every order of unions gives the largest group as root.
WEIGHTED = f"""WITH {AIRINGS}, n AS (SELECT user_id, count(*) AS n, min(s) AS place FROM a GROUP BY user_id), p AS (SELECT x.user_id AS i, y.user_id AS j FROM n x JOIN n y ON y.user_id IN (x.user_id + 7, x.user_id + 14) WHERE x.user_id % 7 < 5),
w AS (SELECT i AS u, i % 7 AS f FROM p UNION SELECT j, j % 7 FROM p), r AS (SELECT w.u, w.f, place, row_number() OVER (PARTITION BY w.f ORDER BY n DESC, w.u) AS k FROM w JOIN n ON n.user_id = w.u)
SELECT x.u AS idx, y.u AS root, x.place - y.place AS off FROM r x JOIN r y ON y.f = x.f AND y.k = 1"""


# ---- verdicts on airings
def verdicts(spark, sf_dir):
    """Every user's events of a type a cluster of lengths up to some minutes, through the whole of classification."""
    a = airings(spark, sf_dir).where("event_type <> 'signup' or user_id % 3 = 0")
    code = F.col("user_id") * 1000 + F.ascii("event_type")
    d = 5 + (F.col("user_id") * 7) % 130
    start = F.floor(F.col("s") / 60) * 1_000_000
    o = a.select(code.cast("long").alias("cluster_id"), d.cast("double").alias("duration"), start.cast("long").alias("start_us"), (start + d * 1_000_000).cast("long").alias("end_us"), F.col("event_id").alias("frame"))
    out = classified(o)
    return out.select("cluster_id", "n", "duration", "first_us", "unit", "pieces", "top", "n_beside", "rule", "is_spot")


VERDICTS = f"""WITH RECURSIVE {AIRINGS}, o AS (SELECT event_id, user_id * 1000 + ascii(event_type) AS c, 5 + (user_id * 7) % 130 AS d, s // 60 * 1000000 AS st, s // 60 * 1000000 + (5 + (user_id * 7) % 130) * 1000000 AS en FROM a WHERE event_type <> 'signup' OR user_id % 3 = 0),
b AS (SELECT c, count(*) AS n, max(d)::DOUBLE AS duration, min(st) AS first_us FROM o GROUP BY c),
mt AS (SELECT c, max(k) AS top FROM (SELECT c, st // 60000000 % 60 AS mi, count(*) AS k FROM o GROUP BY ALL) GROUP BY c),
bs AS (SELECT c, count(*) AS n_beside FROM o WHERE EXISTS (SELECT 1 FROM o x WHERE x.c <> o.c AND x.en > o.st - 2000000 AND x.en <= o.st + 2000000 AND x.st >= o.st - 120000000)
  OR EXISTS (SELECT 1 FROM o x WHERE x.c <> o.c AND x.st BETWEEN o.en - 2000000 AND o.en + 2000000 AND x.st >= o.st - 120000000) GROUP BY c),
t AS (SELECT x.c AS i, y.c AS j, count(*) AS k FROM o x JOIN o y ON y.st BETWEEN x.en - 1000000 AND x.en + 5000000 AND x.c <> y.c GROUP BY ALL),
p AS (SELECT i, j FROM t JOIN b x ON x.c = i JOIN b y ON y.c = j WHERE k >= 0.8 * x.n AND k >= 0.8 * y.n), g AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r(n, m) AS (SELECT c, c FROM b UNION SELECT r.n, g.j FROM r JOIN g ON g.i = r.m), f AS (SELECT n AS c, min(m) AS root FROM r GROUP BY n),
u AS (SELECT root, sum(duration) AS unit, count(*) AS pieces FROM f JOIN b ON b.c = f.c GROUP BY root),
v AS (SELECT b.*, unit, pieces, top, coalesce(n_beside, 0) AS n_beside, CASE WHEN unit > 120 THEN 'long unit' WHEN duration < 8 THEN 'short' WHEN duration > 120 THEN 'long' WHEN n >= 4 AND top >= 0.8 * n THEN 'hourly'
  WHEN coalesce(n_beside, 0) > 0 THEN 'accompanied' ELSE 'alone' END AS rule FROM b JOIN f ON f.c = b.c JOIN u ON u.root = f.root JOIN mt ON mt.c = b.c LEFT JOIN bs ON bs.c = b.c)
SELECT c AS cluster_id, n, duration, first_us, unit, pieces, top, n_beside, rule, rule IN ('accompanied', 'alone') AS is_spot FROM v"""


# ---- the axis
def laid(spark, sf_dir) -> list:
    """Every customer's first event as a recording: path, start_us, file, n. A row a recording, as a run has them."""
    a = airings(spark, sf_dir).groupBy("user_id").agg(F.min("s").alias("s"))
    rows = a.select(F.format_string("r%06d", "user_id").alias("path"), (F.col("s") * 1_000_000).alias("start_us"), F.lit("f").alias("file"), (200 + (F.col("user_id") * 977) % 400_000).alias("n"))
    return [r.asDict() for r in rows.toLocalIterator()]


def axis_spans(spark, sf_dir):
    axis = lay("file:///none", laid(spark, sf_dir))
    return spark.createDataFrame([(s.path, s.first, s.n, s.start, s.run) for s in axis.spans], "path string, first long, n long, start_us long, run long")


LAID = f"""{AIRINGS}, f AS (SELECT 'r' || lpad(user_id::VARCHAR, 6, '0') AS path, min(s) * 1000000 AS st, 200 + (user_id * 977) % 400000 AS n FROM a GROUP BY user_id),
o AS (SELECT *, lead(st) OVER w - (st + n * 1000000 // {FPS}) AS after, st - lag(st + n * 1000000 // {FPS}) OVER w AS before FROM f WINDOW w AS (ORDER BY st, path)),
k AS (SELECT path, st, n - CASE WHEN after < -1000000 THEN least(n, CAST(trunc(-after * {FPS} / 1000000) AS BIGINT)) ELSE 0 END AS n, sum(CASE WHEN before > 1000000 THEN 1 ELSE 0 END) OVER (ORDER BY st, path ROWS UNBOUNDED PRECEDING) AS run FROM o),
sp AS (SELECT path, n, st, CAST(run AS BIGINT) AS run, CAST(coalesce(sum(n) OVER (ORDER BY st, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM k WHERE n > 0)"""


def emitted_airings(spark, sf_dir):
    """Airings of groups on that axis, numbered and placed in recordings and in time."""
    axis = lay("file:///none", laid(spark, sf_dir))
    a = airings(spark, sf_dir)
    start = (F.col("event_id") * 104_729) % F.lit(axis.n - 2000)
    groups = a.select((F.col("event_id") % 400).alias("gid"), F.lit(0).cast("long").alias("run"), start.alias("start"), (start + 100 + F.col("event_id") % 400).alias("end"))
    return emitted(axis, groups).select("cluster_id", "duration", "start_us", "end_us", "path", "offset_sec")


EMITTED = f"""WITH {LAID}, ax AS (SELECT max(first + n) AS n FROM sp), g AS (SELECT event_id % 400 AS gid, event_id * 104729 % (ax.n - 2000) AS s, 100 + event_id % 400 AS len FROM a, ax),
z AS (SELECT gid, count(*) AS n, min(s) AS first_s, max(len) AS med FROM g GROUP BY gid HAVING count(*) >= 2), c AS (SELECT *, row_number() OVER (ORDER BY first_s, med DESC, gid) AS cluster_id FROM z),
p AS (SELECT cluster_id, med, g.s, g.len, sp.path, sp.st + (g.s - sp.first) * 1000000 // {FPS} AS start_us, (g.s - sp.first) / {FPS} AS offset_sec FROM g JOIN c ON c.gid = g.gid ASOF JOIN sp ON g.s >= sp.first)
SELECT cluster_id, med / {FPS} AS duration, start_us, start_us + len * 1000000 // {FPS} AS end_us, path, offset_sec FROM p"""


# ---- names of recordings
def recording_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day, k = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id") % 7
    dashed, colons = F.date_format("ts", "HH-mm-ss"), F.date_format("ts", "HH:mm:ss")
    forms = [
        F.concat(day, F.lit("_"), dashed, F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("_x.mp3")), F.concat(day, F.lit("-"), dashed, F.lit("_merged.flac")),
        F.concat(day, F.lit("T"), colons, F.lit(".wav")), F.concat(day, F.lit("-"), dashed), F.concat(day, F.lit("-"), dashed, F.lit(".a.b.mp3")), F.concat(F.lit("x"), day, F.lit("-"), dashed, F.lit(".mp3")),
        F.concat(day, F.lit("-"), dashed, F.lit(",5.ogg")),
    ]
    name = F.element_at(F.array(*forms), (k + 1).cast("int"))
    rows = e.withColumn("name", name)
    return rows.select("event_id", "name", F.unix_micros(F.coalesce(*[name_time(F.col("name"), p) for p in NAME_PATTERNS])).alias("start_us"))


TIMES = """WITH n AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%d_%H-%M-%S.') || lpad((event_id % 1000)::VARCHAR, 3, '0') || '_x.mp3' WHEN 1 THEN strftime(ts, '%Y-%m-%d-%H-%M-%S') || '_merged.flac'
  WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.wav' WHEN 3 THEN strftime(ts, '%Y-%m-%d-%H-%M-%S') WHEN 4 THEN strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.a.b.mp3'
  WHEN 5 THEN 'x' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.mp3' ELSE strftime(ts, '%Y-%m-%d-%H-%M-%S') || ',5.ogg' END AS name FROM events)
SELECT event_id, name, CASE event_id % 7 WHEN 0 THEN epoch_us(date_trunc('second', ts)) + event_id % 1000 * 1000 WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts))
  WHEN 6 THEN epoch_us(date_trunc('second', ts)) + 500000 END AS start_us FROM n"""


# ---- evaluation
def evaluated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Listed airings (every third event) and mined ones (the others, moved by some seconds)."""
    a = airings(spark, sf_dir)
    us, d = F.col("s") * 1_000_000, 20 + F.col("event_id") % 60
    listed = a.where("event_id % 3 = 0").select(
        (F.col("user_id") % 20).alias("file_no"), F.col("event_id").alias("id"), F.concat(F.lit("ad"), (F.col("user_id") % 20).cast("string")).alias("name"), d.cast("double").alias("dur"),
        F.date_format(F.timestamp_micros(us), "yyyy-MM-dd").alias("day"), us.alias("start_us"), (us + d * 1_000_000).alias("end_us"),
    )
    moved = us + (F.col("event_id") % 9 - 4) * 1_000_000
    found = a.where("event_id % 4 <> 1").select(
        (F.col("user_id") % 30).alias("cluster_id"), (F.col("user_id") % 30).cast("double").alias("duration"), (F.col("user_id") % 2 == 0).alias("is_spot"),
        F.concat(F.lit("of "), (F.col("user_id") % 30).cast("string"), F.lit(" airings, rule "), (F.col("user_id") % 4).cast("string"), F.when(F.col("user_id") % 5 == 0, ".5x").otherwise("!")).alias("reason"),
        moved.alias("start_us"), (moved + (20 + F.col("event_id") % 50) * 1_000_000).alias("end_us"),
    )
    return listed, found


EVAL = f"""{AIRINGS}, li AS (SELECT user_id % 20 AS file_no, event_id AS id, 'ad' || (user_id % 20) AS name, (20 + event_id % 60)::DOUBLE AS dur, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS day, s * 1000000 AS st, (s + 20 + event_id % 60) * 1000000 AS en FROM a WHERE event_id % 3 = 0),
mi AS (SELECT user_id % 30 AS cluster_id, (user_id % 30)::DOUBLE AS duration, user_id % 2 = 0 AS is_spot, 'of ' || (user_id % 30) || ' airings, rule ' || (user_id % 4) || CASE WHEN user_id % 5 = 0 THEN '.5x' ELSE '!' END AS reason,
 (s + event_id % 9 - 4) * 1000000 AS st, (s + event_id % 9 - 4 + 20 + event_id % 50) * 1000000 AS en FROM a WHERE event_id % 4 <> 1)"""
COVERED = f"""{EVAL}, me AS (SELECT li.id, least(li.en, mi.en) - greatest(li.st, mi.st) AS shared, mi.en - mi.st AS size, mi.st, cluster_id, is_spot, (mi.st - li.st) / 1e6 AS off FROM li JOIN mi ON li.st < mi.en AND mi.st < li.en),
mb AS (SELECT *, max(shared) OVER (PARTITION BY id) AS most FROM me), mp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size, st, cluster_id, is_spot, shared) AS k FROM mb WHERE shared >= most - {evaluate.TIE_US}),
cv AS (SELECT li.*, coalesce(shared / 1e6, 0) AS best, cluster_id, is_spot, off, CASE WHEN coalesce(shared / 1e6, 0) >= dur - 3 THEN 'covered' WHEN coalesce(shared / 1e6, 0) > 0.5 * dur THEN 'partial' ELSE 'missed' END AS verdict FROM li LEFT JOIN mp ON mp.id = li.id AND mp.k = 1),
bv AS (SELECT li.*, coalesce(b, 0) AS best, CASE WHEN coalesce(b, 0) >= dur - 3 THEN 'found' WHEN coalesce(b, 0) >= 0.5 * dur THEN 'short' WHEN coalesce(b, 0) > 1 THEN 'fragment' ELSE 'missing' END AS verdict FROM li LEFT JOIN (SELECT id, max(shared) / 1e6 AS b FROM me GROUP BY id) x ON x.id = li.id)"""


def eval_covered(spark, sf_dir):
    return evaluate.covered(*evaluated(spark, sf_dir)).select("id", "best", "cluster_id", "is_spot", "offset", "verdict")


def eval_day(spark, sf_dir):
    """The first days only, by their dates."""
    listed, found = evaluated(spark, sf_dir)
    days = [r.day for r in listed.select("day").distinct().orderBy("day").limit(2).collect()]
    return evaluate.totals(evaluate.covered(listed, found, days=days)).select("listed", "covered", "partial", "flagged", F.round("recall", 9).alias("recall"), F.round("flag_share", 9).alias("flag_share"))


def eval_fragmentation(spark, sf_dir):
    return evaluate.fragmentation(evaluate.covered(*evaluated(spark, sf_dir))).select("name", "clusters", "airings", F.round("largest_share", 9).alias("largest_share"))


def eval_profile(spark, sf_dir):
    return evaluate.profile(evaluate.covered(*evaluated(spark, sf_dir)), "ad3")


def eval_per_file(spark, sf_dir):
    return evaluate.per_file(evaluate.verdicts(*evaluated(spark, sf_dir))).select("file_no", "name", "total", "found", F.round("share", 9).alias("share"))


def eval_levels(spark, sf_dir):
    return evaluate.levels(evaluate.per_file(evaluate.verdicts(*evaluated(spark, sf_dir), tol=30))).select(F.col("level").cast("long").alias("level"), "files")


def eval_per_day(spark, sf_dir):
    return evaluate.per_day(evaluated(spark, sf_dir)[1]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "airings", "clusters")


def eval_near_lengths(spark, sf_dir):
    """Clusters of a user and a type of event, with lengths in tenths."""
    a = airings(spark, sf_dir).where("event_id % 40 = 0")
    o = a.select((F.col("user_id") * 1000 + F.col("event_id") % 8).alias("cluster_id"), (F.col("user_id") % 50 * 0.3 + F.col("event_id") % 8 * 7).alias("duration"), F.lit(True).alias("is_spot"), (F.col("s") * 1_000_000).alias("start_us"), (F.col("e") * 1_000_000).alias("end_us"))
    return evaluate.near_lengths(o).select("a", "b", F.round("da", 6).alias("da"), F.round("db", 6).alias("db"))


def eval_reasons(spark, sf_dir):
    return evaluate.reasons(evaluated(spark, sf_dir)[1])


def eval_quantiles(spark, sf_dir):
    a = airings(spark, sf_dir)
    return a.groupBy("event_type").agg(*[evaluate.quantile("d", x / 100).alias(f"q{x}") for x in (0, 5, 50, 95, 100)])


# ---- a generated broadcast whose schedule is the table nation: a spot a region, an airing a nation
SLOT, HEAD, PER_FILE = 900, 100, 9000


def spot_length(region):
    return 200 + 60 * region


def schedule(spark, sf_dir) -> DataFrame:
    """gid, k, start, end, in frames; r numbers a spot's airings."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("gid"))
    start = HEAD + SLOT * F.col("k")
    r = F.row_number().over(Window.partitionBy("gid").orderBy("k"))
    return n.select("gid", "k", start.alias("start"), (start + spot_length(F.col("gid"))).alias("end"), r.cast("long").alias("r"))


SCHEDULE = f"""sc AS (SELECT n_regionkey::BIGINT AS gid, n_nationkey::BIGINT AS k, {HEAD} + {SLOT} * n_nationkey::BIGINT AS s, {HEAD} + {SLOT} * n_nationkey::BIGINT + 200 + 60 * n_regionkey::BIGINT AS e, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)"""


def broadcast(spark, sf_dir):
    """Frames of the schedule in the shared folder: a programme drawn by file, spots drawn by region over it. Returns the axis."""
    plan = [(r.gid, r.start) for r in schedule(spark, sf_dir).collect()]  # a row a nation
    total = SLOT * (1 + max(s for _, s in plan) // SLOT)
    folder = shared_dir(spark, "broadcast")

    def noise(seed: int, n: int) -> np.ndarray:
        return np.clip(np.random.default_rng(seed).normal(0, 40, (n, BANDS)), -127, 127).astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = k * PER_FILE, min(total, (k + 1) * PER_FILE)
                frames = noise(1000 + k, high - low)
                for region, start in plan:
                    a, b = max(start, low), min(start + spot_length(region), high)
                    if a < b:
                        frames[a - low : b - low] = noise(region, spot_length(region))[a - start : b - start]
                with fs.open_output_stream(f"{root}/{k}.frames", compression=None) as f:
                    f.write(frames.tobytes())
            yield batch

    n = -(-total // PER_FILE)
    done = spark.range(0, n, 1, n).mapInArrow(run, "id long").collect()
    rows = [{"path": f"{r.id}", "start_us": r.id * PER_FILE * 1_000_000 // FPS, "file": f"{r.id}.frames", "n": min(PER_FILE, total - r.id * PER_FILE)} for r in done]
    return lay(folder, rows)


OPTIONS = Options(min_lag=30)


def near(column: str):
    """To the nearest second: an edge may be found some frames off."""
    return (F.floor((F.col(column) + FPS / 2) / FPS) * FPS).cast("long")


def air_matches(spark, sf_dir):
    found = search.find_matches(spark, broadcast(spark, sf_dir), OPTIONS.bounds())
    return found.select(near("a_start").alias("a_start"), near("a_end").alias("a_end"), "lag", "split")


AIR_MATCHES = f"WITH {SCHEDULE} SELECT x.s AS a_start, x.e AS a_end, x.s - y.s AS lag, 0::BIGINT AS split FROM sc x JOIN sc y ON x.gid = y.gid AND y.s < x.s"


def placed(groups: DataFrame, to=lambda c: F.col(c)) -> DataFrame:
    """Groups by their number of airings and first airing, so that ids do not matter."""
    w = Window.partitionBy("gid")
    return groups.select(to("start").alias("s"), to("end").alias("e"), F.count(F.lit(1)).over(w).alias("n"), F.min(to("start")).over(w).alias("first_s"))


def moved(spark, sf_dir, shift) -> DataFrame:
    """The schedule's groups, each airing but a group's first moved by shift frames."""
    by = F.when(F.col("r") == 1, 0).otherwise(shift)
    return schedule(spark, sf_dir).select("gid", F.lit(0).cast("long").alias("run"), (F.col("start") + by).cast("long").alias("start"), (F.col("end") + by).cast("long").alias("end"))


PLACED = f"WITH {SCHEDULE} SELECT s, e, count(*) OVER (PARTITION BY gid) AS n, min(s) OVER (PARTITION BY gid) AS first_s FROM sc"


def air_groups(spark, sf_dir):
    found = written(search.find_matches(spark, broadcast(spark, sf_dir), OPTIONS.bounds()), "matches")
    return placed(boundaries.atomic_groups(found), near)


def air_aligned(spark, sf_dir):
    return placed(refine.aligned(broadcast(spark, sf_dir), moved(spark, sf_dir, F.col("k") * 7 % 21 - 10)))


def air_checked(spark, sf_dir):
    """Airings some seconds off are found, one that is not of its group goes."""
    axis, rows = broadcast(spark, sf_dir), moved(spark, sf_dir, 5 * (F.col("k") * 3 % 8 + 1))
    strange = schedule(spark, sf_dir).where("r = 2").select("gid", F.lit(0).cast("long").alias("run"), (F.col("start") + 550).alias("start"), (F.col("end") + 550).alias("end"))
    return placed(refine.checked(axis, rows.unionByName(strange), OPTIONS.sim_high))


def air_extended(spark, sf_dir):
    axis = broadcast(spark, sf_dir)
    short = schedule(spark, sf_dir).select("gid", F.lit(0).cast("long").alias("run"), (F.col("start") + 30).alias("start"), (F.col("end") - 40).alias("end"))
    return placed(refine.extended(axis, short, OPTIONS.sim_high))


def air_same_audio(spark, sf_dir):
    """Each spot's airings as two groups, of odd and even ones; then one."""
    axis = broadcast(spark, sf_dir)
    halves = schedule(spark, sf_dir).select((F.col("gid") * 2 + F.col("r") % 2).alias("gid"), F.lit(0).cast("long").alias("run"), "start", "end")
    return placed(refine.same_audio(spark, axis, halves, OPTIONS.bounds(0)))


def air_mined(spark, sf_dir):
    """The whole run: clusters and airings, to the nearest second."""
    mined = mine_axis(spark, broadcast(spark, sf_dir), OPTIONS)
    o = mined.occurrences.join(mined.clusters.select("cluster_id", "n", "rule", "is_spot"), "cluster_id")
    second = lambda c: F.floor((F.col(c) + 500_000) / 1_000_000).cast("long")
    return o.select("cluster_id", "n", F.round("duration").cast("long").alias("duration"), second("start_us").alias("start_s"), second("end_us").alias("end_s"), F.round("offset_sec").cast("long").alias("offset_s"), "path", "rule", "is_spot")


AIR_MINED = f"""WITH {SCHEDULE}, c AS (SELECT gid, row_number() OVER (ORDER BY min(s)) AS cluster_id, count(*) AS n FROM sc GROUP BY gid)
SELECT cluster_id, n, (e - s) // {FPS} AS duration, s // {FPS} AS start_s, e // {FPS} AS end_s, s % {PER_FILE} // {FPS} AS offset_s, (s // {PER_FILE})::VARCHAR AS path, 'alone' AS rule, true AS is_spot FROM sc JOIN c ON c.gid = sc.gid"""

LISTED_DAYS = "(SELECT day FROM (SELECT DISTINCT day FROM li) ORDER BY day LIMIT 2)"

QUERIES = {
    "mine_dedupe": (dedupe, DEDUPE),
    "mine_bridge": (bridge, BRIDGE),
    "mine_internal_repeats": (internal, f"WITH {MATCHED} SELECT ra, rb, a_start, a_end, lag, len FROM m"),
    "mine_bins": (match_bins, f"WITH RECURSIVE {BINNED} SELECT run, pos, len(events) AS n FROM c1"),
    "mine_carried_votes": (carried_votes, f"WITH RECURSIVE {CARRIED} SELECT run, pos, count(*) AS n, CAST(sum(near - far) AS BIGINT) AS sum_gap FROM cr GROUP BY ALL"),
    "mine_kept_cuts": (kept_cuts, f"WITH RECURSIVE {KEPT} SELECT run, pos FROM kc"),
    "mine_segments": (segments, f"WITH RECURSIVE {SEGMENTS} SELECT run, s, e FROM sg"),
    "mine_segment_edges": (segment_edges, f"WITH RECURSIVE {EDGES} SELECT a, b FROM ed"),
    "mine_atomic_groups": (atomic_groups, f"WITH RECURSIVE {GROUPS} SELECT gid, run, s, e FROM sg JOIN gc ON gc.n = sg.id"),
    "mine_chain": (chain, CHAIN),
    "mine_spaced": (spaced, SPACED),
    "mine_weighted_union": (weighted_union, WEIGHTED),
    "mine_verdicts": (verdicts, VERDICTS),
    "mine_axis_spans": (axis_spans, f"WITH {LAID} SELECT path, first, n, st AS start_us, run FROM sp"),
    "mine_emitted": (emitted_airings, EMITTED),
    "mine_recording_times": (recording_times, TIMES),
    "eval_covered": (eval_covered, f"WITH {COVERED} SELECT id, best, cluster_id, is_spot, off AS \"offset\", verdict FROM cv"),
    "eval_totals_of_days": (eval_day, f"WITH {COVERED} SELECT count(*) AS listed, count(*) FILTER (verdict = 'covered') AS covered, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'covered' AND is_spot) AS flagged, round(covered / greatest(listed, 1), 9) AS recall, round(flagged / greatest(covered, 1), 9) AS flag_share FROM cv WHERE day IN {LISTED_DAYS}"),
    "eval_fragmentation": (eval_fragmentation, f"WITH {COVERED}, n AS (SELECT name, cluster_id, count(*) AS k FROM cv WHERE verdict = 'covered' GROUP BY ALL) SELECT name, count(*) AS clusters, CAST(sum(k) AS BIGINT) AS airings, round(max(k) / sum(k), 9) AS largest_share FROM n GROUP BY name"),
    "eval_profile": (eval_profile, f"WITH {COVERED} SELECT cluster_id, is_spot, round(off) AS \"offset\", count(*) AS n FROM cv WHERE name = 'ad3' AND cluster_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, cluster_id, 3 LIMIT 12"),
    "eval_per_file": (eval_per_file, f"WITH {COVERED} SELECT file_no, max(name) AS name, count(*) AS total, count(*) FILTER (verdict = 'found') AS found, round(count(*) FILTER (verdict = 'found') / count(*), 9) AS share FROM bv GROUP BY file_no"),
    "eval_levels": (eval_levels, f"WITH {COVERED}, f AS (SELECT file_no, count(*) FILTER (best >= dur - 30) / count(*) AS share FROM bv GROUP BY file_no) SELECT l AS level, count(*) AS files FROM f, (SELECT unnest([100, 95, 90, 80, 50])::BIGINT AS l) WHERE l <= share * 100 GROUP BY l"),
    "eval_per_day": (eval_per_day, f"WITH {EVAL} SELECT strftime(make_timestamp(st), '%Y-%m-%d') AS day, count(*) AS airings, count(DISTINCT cluster_id) AS clusters FROM mi WHERE is_spot GROUP BY 1"),
    "eval_near_lengths": (eval_near_lengths, f"WITH {AIRINGS}, c AS (SELECT user_id * 1000 + event_id % 8 AS c, max(user_id % 50 * 0.3::DOUBLE + event_id % 8 * 7) AS d, min(s) AS s, max(e) AS e FROM a WHERE event_id % 40 = 0 GROUP BY 1) SELECT x.c AS a, y.c AS b, round(x.d, 6) AS da, round(y.d, 6) AS db FROM c x JOIN c y ON x.c < y.c AND abs(x.d - y.d) <= 0.4 AND (x.e * 1000000 < y.s * 1000000 OR y.e * 1000000 < x.s * 1000000)"),
    "eval_reasons": (eval_reasons, f"WITH {EVAL} SELECT substring(regexp_replace(reason, '\\d+(\\.\\d+)?', 'N', 'g'), 1, 70) AS reason, count(*) AS n FROM mi GROUP BY 1 ORDER BY n DESC, reason LIMIT 8"),
    "eval_quantiles": (eval_quantiles, f"WITH {AIRINGS}, v AS (SELECT event_type, list_sort(list(d)) AS v FROM a GROUP BY ALL) SELECT event_type, " + ", ".join(f"v[CAST(floor({x / 100} * (len(v) - 1)) AS BIGINT) + 1] AS q{x}" for x in (0, 5, 50, 95, 100)) + " FROM v"),
    "air_matches": (air_matches, AIR_MATCHES),
    "air_groups": (air_groups, PLACED),
    "air_aligned": (air_aligned, PLACED),
    "air_checked": (air_checked, PLACED),
    "air_extended": (air_extended, PLACED),
    "air_same_audio": (air_same_audio, PLACED),
    "air_mined": (air_mined, AIR_MINED),
}
