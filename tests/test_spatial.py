"""Blocked joins against naive ones, and the shape of their plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import spatial
from tidemark.sources import refdata as R


def points(seed, n):
    rng = random.Random(seed)
    rows = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(n // 2)]
    rows += [(rng.uniform(89.2, 90), rng.uniform(-180, 180)) for _ in range(n // 8)]  # pole
    rows += [(rng.uniform(-10, 10), rng.choice([-1, 1]) * rng.uniform(179.5, 180)) for _ in range(n // 8)]  # date line
    rows += [(1.2 + rng.uniform(0, 0.4), 103.7 + rng.uniform(0, 0.4)) for _ in range(n - len(rows))]  # a port
    return [(i, lat, lng) for i, (lat, lng) in enumerate(rows)]


def km(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("radius_km,hot", [(50, None), (50, 20), (5, None), (2000, None)])
def test_radius_join_equals_naive(spark, radius_km, hot):
    rows = points(radius_km, 320)
    df = spark.createDataFrame(rows, "id int, lat double, lng double")
    got = spatial.self_pairs(df, "id", radius_km * 1000.0, metric="haversine", hot_cell=hot).select("a_id", "b_id").collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and km(a, b) <= radius_km}
    assert len(got) == len(set(got)), "a pair came twice"
    assert set(map(tuple, got)) == want


def test_no_nested_loops(spark, tables):
    pairs = spatial.self_pairs(tables.current.select("entity_id", "lat", "lng"), "entity_id", 50_000)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_zones(spark):
    cases = [(32.0, 53.0, "iran"), (22.0, -79.0, "cuba"), (40.0, 127.0, "north_korea"), (45.0, 34.0, "crimea"), (30.0, -40.0, None), (24.5, 54.4, None)]
    df = spark.createDataFrame([(i, lat, lng) for i, (lat, lng, _) in enumerate(cases)], "id int, lat double, lng double")
    got = {r["id"]: r["zone"] for r in spatial.within_zones(df, R.zones_df(spark)).collect()}
    assert got == {i: z for i, (_, _, z) in enumerate(cases) if z}


def test_corroboration_counts_pairs_of_other_layers(spark):
    rows = points(7, 200)
    df = spark.createDataFrame([(i, lat, lng, "abc"[i % 3]) for i, lat, lng in rows], "event_id int, lat double, lng double, layer string")
    got = {r["event_id"]: r["corroborations"] for r in spatial.corroboration_counts(df).collect()}
    want = {a[0]: sum(1 for b in rows if a[0] % 3 != b[0] % 3 and km(a, b) <= 50) for a in rows}
    assert got == want


def test_reference_tables():
    assert (len(R.PORTS), len(R.ZONES), len(R.PAIR_RULES), len(R.REGIONS), len(R.CATEGORIES)) == (103, 10, 20, 18, 11)


def test_many_points_in_one_cell_are_salted(spark):
    df = spark.range(600).select(F.col("id"), F.lit(1.0).alias("lat"), (F.lit(100.0) + F.col("id") * 1e-6).alias("lng"))
    got = spatial.self_pairs(df, "id", 1000.0, hot_cell=50)
    assert got.count() == 600 * 599 // 2


@pytest.mark.parametrize("most", [25, 10**6])
def test_shapes_meet_points_on_leaves(spark, most):
    """A harbour with a third of all points; circles over poles and the date line, boxes, whole worlds: each pair once."""
    import random

    from tidemark.functions.geo import EARTH_KM, haversine_km
    from tidemark.operators import watch

    rng = random.Random(most)
    at = lambda k: (1.25 + rng.random() / 500, 103.8) if k % 3 == 0 else (rng.uniform(-90, 90), rng.uniform(-180, 180)) if k % 5 else (rng.choice([-90.0, 0.0, 90.0]), rng.choice([-180.0, 180.0, 0.0]))
    points = spark.createDataFrame([(f"e{k}", ["l"], 5, *at(k)) for k in range(900)], "id string, event_layers array<string>, severity int, lat double, lng double")
    circles = [("pole", 88.0, 10.0, 900.0), ("line", 0.0, 179.9, 1500.0), ("west", 0.0, -179.9, 1500.0), ("east", 3.0, -170.0, 1113.0), ("harbour", 1.3, 103.9, 30.0), ("world", 0.0, 0.0, 30_000.0), ("dot", 0.0, 0.0, 0.0)]
    lists = spark.createDataFrame([(n, [], *xyz, 0, True) for n, *xyz in circles], "watch_id string, layers array<string>, center_lat double, center_lng double, radius_km double, min_severity int, enabled boolean")
    got = sorted((r.watch_id, r.id) for r in watch.watch_matches(points, lists, most).collect())
    every = points.join(lists, haversine_km(F.col("center_lat"), F.col("center_lng"), F.col("lat"), F.col("lng"), EARTH_KM) <= F.col("radius_km"))
    assert got == sorted((r.watch_id, r.id) for r in every.collect())


def test_large_trees_and_rules_are_not_broadcast(spark, monkeypatch):
    from tidemark.operators import leaves, watch

    monkeypatch.setattr(leaves, "FEW_NODES", 0)
    monkeypatch.setattr(watch, "FEW_SHARERS", 0)
    test_shapes_meet_points_on_leaves(spark, 25)


def test_subscriptions_meet_events_on_leaves(spark):
    import random

    from tidemark.operators import watch

    rng = random.Random(2)
    at = lambda k: (None, None) if k % 11 == 0 else (1.25, 103.8) if k % 3 == 0 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
    events = spark.createDataFrame([(f"e{k}", rng.choice("tu"), "x", 0.5, float(k % 10), *at(k)) for k in range(600)], "id string, event_type string, event_subtype string, confidence double, severity double, lat double, lng double")
    subs = []
    for k in range(40):
        west = rng.uniform(-180, 180)
        east = west + rng.choice([2.0, 90.0])
        subs.append((f"s{k}", [["t"], ["t", "u"], []][k % 3], [], 0.2, float(k % 4), ["bbox", "circle", "global"][k % 4 % 3], west, -60.0, east - 360 if east > 180 else east, 70.0, rng.uniform(-80, 80), rng.uniform(-180, 180), 4000.0))
    names = "sub_id string, categories array<string>, subcategories array<string>, min_confidence double, min_severity double, area string, west double, south double, east double, north double, center_lat double, center_lng double, radius_km double"
    table = spark.createDataFrame(subs, names)
    got = sorted((r.sub_sub_id, r.id) for r in watch.subscription_join(events, table, most=20).collect())
    mine = table.select(*[F.col(c).alias("sub_" + c) for c in table.columns])
    want = sorted((r.sub_sub_id, r.id) for r in events.join(mine, watch.subscription_matches("", "sub_")).collect())
    assert got == want and len(got) > 100
