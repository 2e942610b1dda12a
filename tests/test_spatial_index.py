"""Nearest sites, footprints and spatial duplicates against brute force."""

from datetime import date as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import spatial
from emberline.operators.site_index import site_index
from emberline.params import DEFAULTS
from emberline.sources.shared import materialize


def metres(y, x, lat, lon):
    a, b = np.radians(y), np.radians(lat)
    t = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lon) - np.radians(x)) / 2) ** 2
    return np.round(2 * DEFAULTS.earth_radius_m * np.arcsin(np.sqrt(np.minimum(1, t))), 3)


def frame(spark, rows, names="osm_id"):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], f"{names} long, latitude double, longitude double")


@pytest.mark.parametrize(("k", "alone"), [(1, 20_000), (3, 20_000), (1, 300)])
def test_index_finds_the_nearest_anywhere(spark, k, alone):
    r = np.random.default_rng(k)
    globe = lambda n: np.c_[np.degrees(np.arcsin(r.uniform(-1, 1, n))), r.uniform(-180, 180, n)]
    sites = np.r_[globe(100), np.c_[r.uniform(8, 13, 400), r.uniform(76, 80, 400)], np.c_[r.normal(11, 0.01, 400), r.normal(78, 0.01, 400)], [[10, 77]] * 5, [[90, 3], [-90, 0], [0, 180], [0, -179.9]]]
    points = np.r_[globe(300), np.c_[r.uniform(8, 13, 200), r.uniform(76, 80, 200)], np.c_[r.normal(11, 0.02, 200), r.normal(78, 0.02, 200)], [[90, 0], [-90, 50], [0, 180], [0, -180], [10, 77], [16, 32]]]
    index = site_index(frame(spark, sites), k, ("osm_id",), alone=alone)
    assert index.leaves.agg(F.max(F.size("_sites"))).first()[0] <= 64
    got = {x.i: [(s.distance_m, s.osm_id) for s in x.nearest] for x in index.look_up(frame(spark, points, "i")).collect()}
    for i, (y, x) in enumerate(points):
        d = metres(y, x, sites[:, 0], sites[:, 1])
        want = [(float(d[j]), int(j)) for j in np.lexsort((np.arange(len(d)), d))[:k]]
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want], atol=0.0015)
        assert [j for _, j in got[i]] == [j for _, j in want] or len({round(a, 2) for a, _ in want}) < len(want) or y in (90, -90)


def test_dense_cell_keeps_arrays_short(spark):
    rows = spark.range(60_000).select(F.col("id").alias("osm_id"), (11 + F.rand(1) * 0.25).alias("latitude"), (78 + F.rand(2) * 0.25).alias("longitude"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    index = site_index(rows, 1, ("osm_id",))
    top = index.leaves.agg(F.max(F.size("_sites")).alias("most"), F.count("*").alias("n")).first()
    assert top.most <= 64 and top.n < 60_000


def test_sites_equally_near_to_a_pole(spark):
    """F8: all cells at a pole share it, so splitting them never parts the sites of the topmost latitude; the index once went on to cells of centimetres there."""
    sites = [(13.5, 76 + i / 100) for i in range(150)] + [(8.0, 76 + i / 100) for i in range(150)]
    index = site_index(frame(spark, sites), 1, ("osm_id",), alone=200)
    assert index.leaves.count() < 20_000
    got = {r.i: [s.osm_id for s in r.nearest] for r in index.look_up(frame(spark, [(70.0, 76.4), (13.6, 76.4), (-70.0, 76.4), (8.01, 77.003)], "i")).collect()}
    assert got == {0: [40], 1: [40], 2: [190], 3: [250]}


def test_index_on_odd_rows(spark):
    points = spark.createDataFrame([(1, None, 1.0), (2, 91.0, 0.0), (3, 5.0, 200.0), (4, 5.0, 5.0), (5, float("nan"), 0.0)], "i int, latitude double, longitude double")
    sites = spark.createDataFrame([(1, 5.0, 6.0), (2, None, 6.0), (3, 95.0, 6.0)], "osm_id long, latitude double, longitude double")
    got = {r.i: [s.osm_id for s in r.nearest] for r in spatial.nearest(points, sites, keep=("osm_id",)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [1], 5: []}
    assert all(r.nearest == [] for r in spatial.nearest(points, sites.limit(0), keep=("osm_id",)).collect())


def test_footprints_with_holes_and_overlaps(spark):
    def ring(key, points):
        return [(key, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1], strict=True)]

    edges = ring(1, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, [(1, 1), (3, 1), (3, 3), (1, 3)])
    edges += ring(2, [(2, 2), (6, 3), (5, 6)]) + ring(3, [(-60, -30), (70, -20), (10, 50)]) + ring(4, [(0.001, 0.001), (0.003, 0.001), (0.002, 0.004)])
    r = np.random.default_rng(1)
    points = np.r_[r.uniform(-1, 7, (800, 2)), r.uniform(-40, 80, (200, 2)), r.uniform(0, 0.005, (100, 2)), [[0, 0], [2, 4], [1, 2]]]
    cells = spatial.footprint_cells(spark.createDataFrame(edges, "product_id int, x1 double, y1 double, x2 double, y2 double"))
    got = {(x.i, x.product_id) for x in spatial.in_footprints(frame(spark, points, "i"), cells).collect()}
    want = set()
    for i, (y, x) in enumerate(points):
        for key in (1, 2, 3, 4):
            own = [e[1:] for e in edges if e[0] == key]
            odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in own) % 2
            on = any(abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) < 1e-12 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in own)
            if odd or on:
                want.add((i, key))
    assert got == want and {(1100, 1), (1101, 1), (1102, 1)} <= got
    assert spatial.in_footprints(frame(spark, points, "i"), cells.limit(0)).count() == 0


def test_duplicates_in_a_crowded_cell(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(11 + r.normal(0, 0.05)), float(78 + r.normal(0, 0.05)), int(r.integers(0, 2)), float(r.integers(0, 40))) for i in range(600)] + [(1000 + i, 70.0 + float(r.normal(0, 0.03)), float(r.normal(20, 0.1)), 0, float(i % 7)) for i in range(150)]
    rows += [(2000, None, 1.0, 0, 5.0), (2001, 11.0, 78.0, 0, None)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, d int, frp double").withColumn("acq_date", F.date_add(F.lit("2024-01-01").cast("date"), "d"))
    got = {x.event_id: x.is_spatial_duplicate for x in spatial.spatial_duplicates(df, "frp").collect()}
    for i, y, x, d, s in rows:
        beaten = y is not None and s is not None and any(e == d and v is not None and t is not None and metres(y, x, v, u) <= 5500 and (t > s or (t == s and j < i)) for j, v, u, e, t in rows if j != i)
        assert got[i] == beaten
    crowd = spark.range(100_000).select(F.col("id").alias("event_id"), (11 + F.col("id") % 100 / 10_000).alias("latitude"), F.lit(78.0).alias("longitude"), F.lit("2024-01-01").cast("date").alias("acq_date"), (F.col("id") % 1000).cast("double").alias("frp"))
    assert spatial.spatial_duplicates(crowd, "frp").filter("not is_spatial_duplicate").count() == 1


def test_exploded_sides_of_spatial_joins_are_not_broadcast(spark):
    """Spark doesn't know that a side grew 25-fold and would broadcast it; a small table is enough to see the choice."""
    rows = [(i, 10.0 + i % 7 / 100, 78.0 + i % 5 / 100, D(2024, 1, 1 + i % 3), float(i % 11)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, acq_date date, frp double")
    events = materialize(events)
    for out in (spatial.near_in_space_time(events, events), spatial.spatial_duplicates(events, "frp")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("cy#" in x or "cd#" in x)]


def test_pairs_in_space_and_time_meet_by_place_and_day(spark, monkeypatch):
    """events of one place and day are one row of the join; repeated and missing keys, places and dates pair as in plain SQL."""
    r = np.random.default_rng(3)
    rows = [(i, float(11 + r.integers(0, 30) / 150), float(78 + r.integers(0, 30) / 150), D(2024, 1, 1 + int(r.integers(0, 8)))) for i in range(400)]
    rows += rows[:40] + [(1000 + i, 45.0, float(20 + i / 40), D(2024, 2, 1)) for i in range(9)]
    rows += [(None, 11.0, 78.0, D(2024, 1, 1)), (2000, None, 78.0, D(2024, 1, 1)), (2001, 11.0, 78.0, None), (2002, float("nan"), 78.0, D(2024, 1, 1))] + [(3000 + i, 11.0, 78.0, D(2024, 1, 1)) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, acq_date date")
    b = events.toDF("b", "lat_b", "lon_b", "day_b")
    a = events.toDF("a", "lat_a", "lon_a", "day_a")
    near = (F.abs(F.datediff("day_a", "day_b")) < 3) & (F.round(spatial.haversine_m("lat_a", "lon_a", "lat_b", "lon_b"), 3) < 3000)
    whole = sorted(map(tuple, a.crossJoin(b).filter("a <> b").filter(near).select("a", "b").collect()))
    for together in (1000, 7):
        monkeypatch.setattr(spatial, "TOGETHER", together)
        assert sorted(map(tuple, spatial.near_in_space_time(events, events).collect())) == whole
    held = spatial._place_days(events, "event_id").collect()
    assert max(len(x.ids) for x in held) == 7 and sum(len(x.ids) for x in held) == 499
    monkeypatch.setattr(spatial, "TOGETHER", 1000)
    assert [len(x.ids) for x in spatial._place_days(events.filter("event_id >= 3000"), "event_id").collect()] == [50]


def test_crossings_alone_decide_on_an_edge(spark):
    """On the edge of a square, the half-open rule of the SQL keeps the lower and the left side."""
    edges = spark.createDataFrame([(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 3.0, 1.0), (4, 2.0, 2.0), (5, 1.0, 0.0), (6, 1.0, 2.0)], "event_id long, latitude double, longitude double")
    for most in (1, 5000):
        assert sorted(r.event_id for r in spatial.in_polygon(points, edges, most_edges=most, closed=None).collect()) == [1, 2, 5]
        assert [r.event_id for r in spatial.in_polygon(points, edges, most_edges=most).collect()] == [1]


@pytest.mark.parametrize("k", [1, 3])
def test_shortlist_of_a_leaf_holds_ties_and_the_nearest(spark, k):
    """The batch-wise choice never loses a site that Spark's rounded distance would rank; empty leaves and points off the globe get nothing."""
    from emberline.operators.site_index import _shortlist

    near = [(10.0, 78.0), (10.0, 78.0), (10.000000001, 78.0), (10.5, 78.0), (11.0, 79.0)]
    rows = [(10.0, 78.0, [a for a, _ in near], [b for _, b in near]), (10.0, 78.0, [], []), (-10.0, -102.0, [10.0, 10.0], [78.0, 78.000001]), (None, None, [], [])]
    got = [r.p for r in spark.createDataFrame(rows, "y double, x double, ys array<double>, xs array<double>").select(_shortlist(k)("y", "x", "ys", "xs").alias("p")).collect()]
    assert got == [[0, 1, 2], [], [0, 1], []]


def test_a_search_task_gets_a_bounded_number_of_rows(spark):
    """A larger table is dealt over more tasks, not over the cores only."""
    from emberline.sources.shared import spread

    rows = spark.range(0, 2000, 1, 2)
    assert spread(rows, 100).rdd.getNumPartitions() == 20
    assert spread(rows, 10_000).rdd.getNumPartitions() == spread(rows).rdd.getNumPartitions() == max(2, spark.sparkContext.defaultParallelism)
    assert spread(rows, 100).count() == 2000
