"""Operators on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.operators import boundaries, chains, search, timeline
from echofold.operators.classify import ladder
from echofold.operators.refine import spaced, weighted_union
from echofold.operators.relational import islands, range_join, upper_median
from echofold.plans import mine
from echofold.plans.mine import classified

M = search.MATCHES


def matches(spark, rows):
    return spark.createDataFrame([(a, e, lag, 0, 0, 0.9, 0, 0) for a, e, lag in rows], M)


def test_cuts_are_carried_and_lone_ones_dropped(spark):
    m = boundaries.with_b(matches(spark, [(5000, 5400, 4000), (9000, 9600, 8000), (9000, 9600, 4000)]))
    first = boundaries.votes(m)
    cuts = boundaries.kept_cuts(boundaries.binned(first.unionByName(boundaries.carried(boundaries.binned(first), m))), boundaries.sides(m))
    got = sorted(r.pos for r in cuts.collect())
    near = lambda p: any(abs(p - x) <= 10 for x in got)
    assert all(near(p) for p in (1000, 1600, 5000, 5600, 9000, 9600))
    assert not near(5400) and not near(1400)


def airings(spark, groups):
    return spark.createDataFrame([(g, 0, s, e) for g, spans in groups.items() for s, e in spans], "gid long, run long, start long, end long")


def chained(spark, groups):
    out = chains.chain(airings(spark, groups), 10, (F.col("n") >= 2) & (F.col("med") > 10))
    got = {}
    for r in out.collect():
        got.setdefault(r.gid, []).append((r.start, r.end))
    return sorted((e - s, len(v)) for v in got.values() for s, e in [min(v)])


A = [(100, 500), (2100, 2500), (4100, 4500)]
B = [(500, 900), (2500, 2900), (4500, 4900)]


def test_always_adjacent_is_one(spark):
    assert chained(spark, {1: A, 2: B}) == [(800, 3)]


def test_a_song_joins_nothing(spark):
    assert len(chained(spark, {1: A, 2: [(s, s + 2400) for s, _ in B]})) == 2


def test_family_words(spark):
    u1, u2 = [(0, 300), (10000, 10300)], [(20000, 20500), (30000, 30500), (40000, 40500)]
    jingle = [(300, 400), (10300, 10400), (20500, 20600), (30500, 30600), (40500, 40600), (50000, 50100)]
    assert chained(spark, {1: u1, 2: u2, 3: jingle}) == [(100, 1), (400, 2), (600, 3)]


def test_an_opener_stays(spark):
    opener = [(k * 10000, k * 10000 + 400) for k in range(5)]
    x, y = [(k * 10000 + 400, k * 10000 + 800) for k in (0, 1)], [(20400, 20800)]
    assert (400, 5) in chained(spark, {1: opener, 2: x, 3: y})


def test_dropout_is_bridged():
    places = [10000, 30000, 50000, 70000]
    rows = []
    for i, a in enumerate(places):
        for b in places[:i]:
            if a == 70000:  # its second part lies 26 frames later
                rows += [(a, 72000, a - b), (72000, 75000, a - b - 26)]
            else:
                rows.append((a, a + 5000, a - b))
    rows.append((100, 200, 50))
    dicts = [{"a_start": a, "a_end": e, "lag": lag, "split": 0, "lag2": 0, "sim": 0.9, "ra": 0, "rb": 0} for a, e, lag in sorted(rows)]
    out = search.chains(dicts, 6000)
    whole = [r for r in out if r[1] - r[0] == 5000]
    assert len(whole) == 6 and len(out) == 7
    assert sorted(r[3] for r in whole) == [0, 0, 0, 72000, 72000, 72000]


def test_dedupe(spark):
    rows = [(100, 200, 1000, 0.8, 0, 0), (205, 300, 1003, 0.9, 0, 0), (400, 500, 1000, 0.7, 0, 0), (290, 350, 1000, 0.7, 1, 0)]
    got = search.deduped(spark.createDataFrame(rows, "a_start long, a_end long, lag long, sim double, ra long, rb long")).collect()
    assert sorted((r.a_start, r.a_end, r.lag) for r in got) == [(100, 300, 1000), (290, 350, 1000), (400, 500, 1000)]


def test_internal_repeats_go(spark):
    rows = [(10000, 13600, 9000), (10500, 11500, 9200), (10500, 11500, 9005), (10500, 13400, 9200)]
    got = boundaries.without_internal(matches(spark, rows)).collect()
    assert sorted((r.a_start, r.lag, r.len) for r in got) == [(10000, 9000, 3600), (10500, 9200, 2900)]


def test_union_with_offsets():
    pair = lambda i, j, shared, shift, ni, nj: {"i": i, "j": j, "shared": shared, "shift": shift, "ni": ni, "nj": nj}
    got = {k: (r, o) for k, r, o in weighted_union([pair(0, 1, 90, 7, 2, 5), pair(1, 2, 80, -3, 5, 5), pair(0, 2, 70, 99, 2, 5)])}
    assert got == {0: (1, -7), 1: (1, 0), 2: (1, -3)}


def test_spacing_depends_on_what_was_kept():
    rows = [{"gid": 1, "run": 0, "start": s, "end": s + 100} for s in (0, 40, 60, 120, 170)]
    assert [r[2] for r in spaced(rows)] == [0, 60, 120, 170]


def test_range_join_and_islands(spark):
    left = spark.createDataFrame([(k, 7 * k, 7 * k + 5 * (k % 4) + 1) for k in range(40)], "l long, a long, b long")
    right = spark.createDataFrame([(k, 11 * k, 11 * k + 30) for k in range(25)], "r long, c long, d long")
    want = {(x.l, y.r) for x in left.collect() for y in right.collect() if x.a < y.d and y.c < x.b}
    for bucket in (3, 10, 1000):
        got = [(r.l, r.r) for r in range_join(left, right, ("a", "b"), ("c", "d"), bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r.l for r in range_join(left, right, ("a", "b"), ("c", "d"), bucket, how="left_semi").collect()} == {x for x, _ in want}
    spans = spark.createDataFrame([(0, 10, "x"), (10, 12, "x"), (13, 20, "x"), (5, 30, "y")], "s long, e long, k string")
    assert sorted((r.k, r.s, r.island) for r in islands(spans, "s", "e", ["k"]).collect()) == [("x", 0, 0), ("x", 10, 0), ("x", 13, 1), ("y", 5, 0)]


@pytest.mark.parametrize("values,want", [([1], 1), ([1, 2], 2), ([3, 1, 2], 2), ([1, 2, 3, 4], 3), ([5, 5, 1, 1], 5)])
def test_upper_median(spark, values, want):
    assert spark.createDataFrame([(v,) for v in values], "v long").agg(upper_median("v").cast("long").alias("m")).first().m == want


def test_verdicts(spark):
    """Eight clusters: too short, too long, hourly, two that air together, two parts of a long unit, one alone."""
    base, hour = 1_756_700_000_000_000 // 3_600_000_000 * 3_600_000_000, 3_600_000_000
    sec, rows = 1_000_000, []

    def add(c, length, starts):
        rows.extend((c, float(length), base + int(s * sec), base + int((s + length) * sec), int(s * 20)) for s in starts)

    add(1, 4, [100, 5100, 9100])
    add(2, 200, [12000, 24000])
    add(3, 30, [600 + 3600 * k for k in range(4)])
    add(4, 30, [20000, 31000, 47000])
    add(5, 20, [20030, 31030, 47030])
    add(6, 100, [60000, 71000])
    add(7, 90, [60100, 71100])
    add(8, 15, [80000, 90500])
    del hour
    o = spark.createDataFrame(rows, "cluster_id long, duration double, start_us long, end_us long, frame long")
    got = {r.cluster_id: (r.is_spot, r.rule) for r in classified(o).collect()}
    assert [got[k][0] for k in range(1, 9)] == [False, False, False, True, True, False, False, True]
    assert got[4][1] == "accompanied" and got[8][1] == "alone" and got[6][1] == "long unit"
    edge = spark.createDataFrame([(8.0, 8.0, 2, 1, False), (120.0, 120.0, 2, 1, False)], "d double, unit double, n long, top long, accompanied boolean")
    assert all(r.is_spot for r in ladder(edge).collect())


def crowded(spark, n=1500, clusters=60, seconds=40):
    """Few seconds and many clusters; clusters 1 and 2 follow each other by a second."""
    rng = np.random.default_rng(3)
    start = rng.integers(0, seconds, n) * 1_000_000
    rows = [(int(c), int(s), int(s + 1_000_000 * (2 + c % 5)), k) for k, (c, s) in enumerate(zip(rng.integers(10, 10 + clusters, n), start, strict=True))]
    rows += [(1, 10_000_000 * k, 10_000_000 * k + 4_000_000, n + k) for k in range(9)] + [(2, 10_000_000 * k + 5_000_000, 10_000_000 * k + 6_000_000, 2 * n + k) for k in range(9)]
    rows += [(None, 0, 1, 3 * n), (3, None, 5, 3 * n + 1), (4, 5, None, 3 * n + 2)]
    return spark.createDataFrame(rows, "c long, s long, e long, k long")


@pytest.mark.parametrize("sizes", [(2_000_000, 500_000, 1 << 22), (300, 100, 1 << 22), (300, 700, 16)])
@pytest.mark.parametrize("share", [0.8, 0.3])
def test_mostly_followed(spark, monkeypatch, sizes, share):
    for name, value in zip(("HELD", "STREAMED", "COUNTED"), sizes, strict=True):
        monkeypatch.setattr(timeline, name, value)
    a = crowded(spark)
    n = {r.c: r["count"] for r in a.groupBy("c").count().collect()}
    want = {(r.i, r.j) for r in timeline.followed(a, "c", "s", "e", 1_000_000, 5_000_000).collect() if r.n >= share * n[r.i] and r.n >= share * n[r.j]}
    got = timeline.mostly_followed(a, "c", "s", "e", 1_000_000, 5_000_000, share).collect()
    assert (1, 2) in want and len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert not timeline.mostly_followed(a.limit(0), "c", "s", "e", 1_000_000, 5_000_000, share).count()


def test_verdicts_count_pairs_where_they_are_found(spark, monkeypatch):
    rows = [(c, 6.0, 1_000_000 * s, 1_000_000 * (s + 6), 100 * s + c) for s in range(0, 40, 2) for c in range(s % 4, 200, 4)]
    o = spark.createDataFrame(rows, "cluster_id long, duration double, start_us long, end_us long, frame long")
    seen = []
    keep = mine.connected_components
    monkeypatch.setattr(mine, "connected_components", lambda edges: seen.append(edges._jdf.queryExecution().toString()) or keep(edges))
    assert mine.classified(o).count() == 100
    plan = seen[0].split("== Physical Plan ==")[1]
    assert "Join" not in plan


def test_company_of_a_crowded_place(spark):
    """Of a place the latest starts count, of two clusters."""
    rows = [(c, 100 - c % 3, 110, c) for c in range(20)] + [(50, 110, 120, 50), (51, 300, 310, 51), (52, 310, 320, 52), (52, 290, 310, 53)]
    a = spark.createDataFrame(rows, "cl long, st long, en long, id long")
    for reach in (11, 12, 15, 1000):
        want = {x[3] for x in rows for y in rows if y[0] != x[0] and y[1] >= x[1] - reach and (x[1] - 2 < y[2] <= x[1] + 2 or x[2] - 2 <= y[1] <= x[2] + 2)}
        assert {r.id for r in timeline.accompanied(a, "id", "cl", "st", "en", 2, reach).collect()} == want


def crossing(spark, n=400):
    """Matches of few lags that lie over each other, so that a place is carried to another by many of them."""
    rng = np.random.default_rng(5)
    start = rng.integers(0, 900, n)
    rows = [(int(s), int(s + size), int(lag), int(s + size // 2) if k % 7 == 0 else 0, int(lag + 6) if k % 7 == 0 else 0, 0.9, int(a), int(a + b)) for k, (s, size, lag, a, b) in enumerate(zip(start, rng.integers(40, 300, n), rng.choice([1000, 1040, 1100], n), rng.integers(0, 3, n), rng.integers(0, 2, n), strict=True))]
    return boundaries.with_b(spark.createDataFrame(rows, M))


@pytest.mark.parametrize("bucket", [6000, 50])
def test_weighed_cuts_equal_those_of_all_carried_votes(spark, monkeypatch, bucket):
    monkeypatch.setattr(boundaries, "BUCKET", bucket)
    m = crossing(spark)
    first = boundaries.votes(m)
    binned = boundaries.binned(first)
    every = boundaries.binned(first.unionByName(boundaries.carried(binned, m)))
    want = sorted(map(tuple, every.select("run", "pos", F.size("events").alias("n"), boundaries.independent(F.col("events"), F.col("pos")).alias("free")).collect()))
    got = sorted(map(tuple, boundaries.weighed(first, binned, m).collect()))
    assert got == want and {x[3] for x in want} == {True, False}
    assert sorted(boundaries.cut(m).collect()) == sorted(boundaries.kept_cuts(every, boundaries.sides(m)).collect())


def test_a_cut_is_carried_once_a_lag(spark):
    """Matches over each other carry a cut to one place, however many they are."""
    m = boundaries.with_b(matches(spark, [(100 + k, 700 + k, 2000) for k in range(200)]))
    cuts = boundaries.binned(boundaries.votes(m))
    lent = boundaries.borrowed(cuts, m)
    assert lent.count() < boundaries.carried(cuts, m).select("run", "pos").count() / 50
    assert lent.distinct().count() == lent.count()


def test_long_matches_are_not_compared_with_hosts(spark):
    rows = [(0, 2400, 5000), (100, 1700, 5050), (200, 1800, 5100), (300, 400, 5200), (3000, 3100, 5200), (0, 3600, 9000)]
    got = {(r.a_start, r.lag) for r in boundaries.without_internal(matches(spark, rows)).collect()}
    want = set()
    for s, e, lag in rows:
        covers = [1 for x, y, g in rows if y - x >= 1200 and x <= s and e <= y and x - g <= s - lag and e - lag <= y - g and y - x >= (e - s) * 3 // 2 and abs(g - lag) > 10]
        if not covers:
            want.add((s, lag))
    assert got == want and 0 < len(want) < len(rows)
