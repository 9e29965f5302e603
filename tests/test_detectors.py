"""Scenarios of each detector on small tables at a fixed moment."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corrections, names
from tidemark.operators.detectors import clusters, encounters, listed, movement, ports
from tidemark.operators.detectors.base import FINDING_SCHEMA
from tidemark.operators.latest import current_entities
from tidemark.sources import refdata as R

NOW = datetime(2026, 5, 20, 12, 0, 0)
AS_OF = lambda: F.lit(NOW).cast("timestamp")


def ago(**kw):
    return NOW - timedelta(**kw)


def entities(spark, rows):
    """rows: id, type, name, imo, military"""
    return spark.createDataFrame(
        [(i, k, "200000" + i, n, imo, mil, "NO") for i, k, n, imo, mil in rows],
        "entity_id string, entity_type string, canonical_id string, display_name string, imo string, military boolean, origin_country string",
    )


def track(spark, rows):
    """rows: id, time, lat, lng, velocity"""
    return spark.createDataFrame(
        [(n, t, i, lat, lng, v, 0.0) for n, (i, t, lat, lng, v) in enumerate(rows)],
        "ping_id long, time timestamp, entity_id string, lat double, lng double, velocity_ms double, heading_deg double",
    )


def current(spark, people, pings):
    return current_entities(entities(spark, people), track(spark, pings))


def vessels(*ids):
    return [(i, "vessel", f"SHIP {i}", None, False) for i in ids]


def test_dark_vessel_bounds_and_idempotency(spark):
    pings = [("a", ago(hours=12), 59.0, 25.0, 5.0), ("b", ago(days=3), 59.0, 25.0, 5.0), ("c", ago(days=10), 59.0, 25.0, 5.0), ("d", ago(hours=3), 59.0, 25.0, 5.0),
             ("e", ago(days=20), 59.0, 25.0, 5.0), ("f", ago(hours=13), 59.0, 25.0, 0.1)]
    now = current(spark, vessels(*"abcdef"), pings)
    found = movement.dark_vessels(now, AS_OF())
    assert {r["entity_id"]: r["event_subtype"] for r in found.collect()} == {"a": "short", "b": "medium", "c": "long"}
    assert found.filter("entity_id = 'a'").first()["severity"] == 1.0
    assert movement.dark_vessels(now, AS_OF(), prior=found).count() == 0


def test_dark_cohort_is_a_receiver(spark):
    at = ago(hours=10)
    ids = [f"v{i}" for i in range(6)]
    now = current(spark, vessels(*ids), [(i, at, 1.0, 2.0, 4.0) for i in ids])
    assert movement.dark_vessels(now, AS_OF()).count() == 0
    assert movement.dark_vessels(now.filter("entity_id <> 'v0'"), AS_OF()).count() == 5


def loiter(spark, pings):
    people = vessels("a")
    return movement.loitering(current(spark, people, pings), track(spark, pings), AS_OF())


@pytest.mark.parametrize("case,count", [("small", 1), ("travels", 0), ("few", 0), ("brief", 0), ("still", 0), ("frozen", 0)])
def test_loitering(spark, case, count):
    step = {"small": 0.0005, "travels": 0.05, "frozen": 0.0}.get(case, 0.0005)
    hours = 1.0 if case == "brief" else 5.0
    n = 3 if case == "few" else 11
    v = 0.05 if case == "still" else 2.0
    pings = [("a", NOW - timedelta(hours=hours * (n - 1 - k) / (n - 1)), 10.0 + (k % 3) * step, 20.0 + (k % 2) * step, v) for k in range(n)]
    assert loiter(spark, pings).count() == count


def meet(spark, offset=0.001, speed=1.0, minutes=40, recent=1.0):
    pings = []
    for k in range(0, minutes + 1, 5):
        pings += [("a", NOW - timedelta(minutes=minutes - k), 10.0, 20.0, recent if k else speed), ("b", NOW - timedelta(minutes=minutes - k, seconds=-20), 10.0 + offset, 20.0, speed)]
    pings[-2] = ("a", pings[-2][1], 10.0, 20.0, speed)
    return encounters.rendezvous(current(spark, vessels("a", "b"), pings), track(spark, pings), AS_OF() + F.expr("INTERVAL 1 MINUTE"))


def test_rendezvous(spark):
    row = meet(spark).collect()
    assert len(row) == 1 and row[0]["severity"] == 10.0 and row[0]["event_subtype"] == "vessel_vessel" and row[0]["entity_ids"] == ["a", "b"]
    assert meet(spark, offset=0.0035).first()["severity"] == 9.0  # about 390 m
    assert meet(spark, offset=0.05).count() == 0  # far
    assert meet(spark, speed=8.0).count() == 0  # fast
    assert meet(spark, minutes=10).count() == 0  # not sustained
    assert meet(spark, recent=80.0).count() == 0  # was fast shortly before


def test_ports(spark):
    sg = (1.2655, 103.8240)
    pings = [("a", ago(minutes=5), *sg, 0.5), ("b", ago(minutes=5), sg[0], sg[1] + 0.02, 5.0), ("c", ago(minutes=5), sg[0] + 0.2, sg[1], 0.5), ("d", ago(hours=3), *sg, 0.5), ("e", ago(minutes=5), 36.9472, -76.3294, 0.1)]
    now = current(spark, vessels(*"abcde"), pings)
    harbours = R.ports_df(spark)
    calls = ports.port_calls(now, harbours, AS_OF())
    assert {(r["entity_id"], r["key"], r["severity"]) for r in calls.collect()} == {("a", "SG_SIN", 3.0), ("e", "US_NRF", 6.0)}
    assert ports.port_calls(now, harbours, AS_OF(), prior=calls).count() == 0
    assert ports.port_arrivals(now, harbours, AS_OF(), prior=calls).count() == 0
    assert ports.port_arrivals(now, harbours, AS_OF()).count() == 2
    # 'c' called there 10 h ago and is now 22 km away: departed, once.
    before = calls.filter("entity_id = 'a'").withColumns({"entity_id": F.lit("c"), "event_time": F.lit(ago(hours=10)).cast("timestamp")})
    left = ports.port_departures(now, harbours, AS_OF(), before)
    assert [(r["entity_id"], r["key"], r["severity"]) for r in left.collect()] == [("c", "SG_SIN", 4.0)]
    assert ports.port_departures(now, harbours, AS_OF(), before.unionByName(left)).count() == 0


def test_zones_and_military(spark):
    spots = {"ir": (32.0, 53.0, 8.0), "cu": (22.0, -79.0, 7.0), "kp": (40.0, 127.0, 10.0), "cr": (45.0, 34.0, 9.0), "at": (30.0, -40.0, None)}
    people = [(k, "aircraft", f"RCH{k}", None, k == "ir") for k in spots]
    now = current(spark, people, [(k, ago(minutes=3), v[0], v[1], 200.0) for k, v in spots.items()])
    zones = movement.zone_intrusions(now, R.zones_df(spark), AS_OF())
    assert {r["entity_id"]: r["severity"] for r in zones.collect()} == {k: v[2] for k, v in spots.items() if v[2]}
    assert movement.zone_intrusions(now, R.zones_df(spark), AS_OF(), prior=zones).count() == 0
    mil = movement.military_flights(now, AS_OF()).collect()
    assert [(m["entity_id"], m["event_subtype"]) for m in mil] == [("ir", "RCHIR")]


def listings(spark, rows):
    return spark.createDataFrame(rows, "listed_id string, listed_name string, listed_imo string, authority string, regime string")


def test_sanctions_match(spark):
    people = [("1", "vessel", "pola sofia", None, False), ("2", "vessel", "RENAMED", "9111", False), ("3", "vessel", "ANTEY", "9222", False), ("4", "vessel", "ABC", None, False), ("5", "vessel", None, None, False), ("6", "vessel", "POLA SOFIA", None, False)]
    pings = [(p[0], ago(hours=1) if p[0] != "6" else ago(days=3), 10.0, 20.0, 3.0) for p in people]
    lst = listings(spark, [("S1", "POLA SOFIA", None, "A", None), ("S2", "OLD NAME", "9111", None, None), ("S3", "ANTEY", "9333", None, None), ("S4", "ABC", None, None, None)])
    now = current(spark, people, pings)
    found = listed.sanctions_matches(now, lst, AS_OF())
    assert {(r["entity_id"], r["key"], r["event_subtype"], r["severity"]) for r in found.collect()} == {("1", "S1", "name_match", 9.0), ("2", "S2", "imo_match", 10.0)}
    assert listed.sanctions_matches(now, lst, AS_OF(), prior=found).count() == 0


def test_prefix_filter_finds_every_pair(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = ["ocean", "star", "pola", "sofia", "north", "sea", "trader", "ii", "7", "gulf"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "a", " x"])
    left, right = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})
    grams = lambda s: {("  " + w + " ")[i:i + 3] for w in s.split() for i in range(len(w) + 1)}
    for t in (0.9, 0.5):
        want = {(a, b) for a, b in itertools.product(left, right) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= t}
        df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
        got = names.similar_names(df(left), df(right), t).collect()
        assert {(r["left_name"], r["right_name"]) for r in got} == want and len(got) == len(want)


def matches(spark, rows):
    """rows: entity, lat, lng, authority, hours ago"""
    data = [("sanctioned_vessel_underway", "imo_match", ago(hours=h), lat, lng, 10.0, "t", "d", "maritime", 1440, e, None, None, f"S{n}", "m",
             '{"sanctioning_authority":"%s","live_vessel_name":"MV %s","mmsi":"%s"}' % (a, e, e)) for n, (e, lat, lng, a, h) in enumerate(rows)]
    return spark.createDataFrame(data, FINDING_SCHEMA)


def test_multi_authority(spark):
    rows = matches(spark, [("1", 1.0, 2.0, "A", 1), ("1", 1.1, 2.0, "B", 2), ("2", 1.0, 2.0, "A", 1), ("2", 1.0, 2.0, "A", 2), ("3", 1.0, 2.0, "A", 1), ("3", 1.0, 2.0, "B", 1), ("3", 1.0, 2.0, "C", 1), ("4", 1.0, 2.0, "A", 1), ("4", 1.0, 2.0, "B", 30)])
    found = listed.multi_authority(rows, AS_OF())
    assert {(r["entity_id"], r["event_subtype"], r["key"]) for r in found.collect()} == {("1", "dual_listed", "A|B"), ("3", "tri_listed", "A|B|C")}
    assert listed.multi_authority(rows, AS_OF(), prior=found).count() == 0


def fleet(spark, rows):
    data = matches(spark, rows)
    members = clusters.fleet_members(clusters.latest_matches(data, AS_OF()))
    return clusters.fleet_clusters(members, AS_OF())


def test_fleet_clusters(spark):
    near = lambda k, base=0.0, n="": (f"{n}{k}", 1.0 + base + k * 0.02, 100.0, "A", 1)
    assert [r["event_subtype"] for r in fleet(spark, [near(k) for k in range(3)]).collect()] == ["cluster"]
    assert fleet(spark, [near(k) for k in range(2)]).count() == 0
    assert fleet(spark, [(str(k), float(k), 100.0, "A", 1) for k in range(4)]).count() == 0  # far apart
    chain = [(str(k), 1.0 + k * 0.08, 100.0, "A", 1) for k in range(8)]  # 62 km of 9 km steps
    assert fleet(spark, chain).count() == 0
    two = fleet(spark, [near(k, 0, "x") for k in range(4)] + [near(k, 10, "y") for k in range(7)])
    assert sorted(r["event_subtype"] for r in two.collect()) == ["fleet", "large_fleet"]


def test_dbscan_equals_brute_force(spark):
    import random

    rng = random.Random(11)
    pts = [(f"p{i:03}", rng.gauss(0, 30), rng.gauss(0, 30)) for i in range(120)] + [(f"q{i:03}", rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(120)]
    pts += [(f"r{i:03}", 100 + i * 0.01, 100.0) for i in range(40)]
    eps, m = 9.0, 4
    near = {a: [b for b, x, y in pts if (x - ax) ** 2 + (y - ay) ** 2 <= eps * eps] for a, ax, ay in pts}
    core = {a for a in near if len(near[a]) >= m}
    label = {}
    for start in sorted(core):
        if start in label:
            continue
        todo = [start]
        while todo:
            a = todo.pop()
            if a in label:
                continue
            label[a] = start
            todo += [b for b in near[a] if b in core and b not in label]
    groups = {frozenset(a for a in label if label[a] == g) for g in set(label.values())}
    got = clusters.dbscan(spark.createDataFrame(pts, "id string, x double, y double"), eps, m).collect()
    found = {r["id"]: r["cluster"] for r in got}
    assert {frozenset(a for a in core if found[a] == g) for g in {found[a] for a in core}} == groups
    for a in near:
        if a not in core:
            around = {found[b] for b in near[a] if b in core}
            assert found[a] == (min(around) if around else None)


def test_proximity_skips_derived_and_repeats(spark):
    now = current(spark, vessels("a"), [("a", ago(minutes=5), 10.0, 20.0, 3.0)])
    rows = [("q", "usgs_quake", ago(minutes=30), 10.2, 20.0, 60), ("far", "usgs_quake", ago(minutes=30), 12.0, 20.0, 60), ("old", "usgs_quake", ago(hours=3), 10.1, 20.0, 60),
            ("slow", "nasa_eonet", ago(hours=3), 10.1, 20.0, 720), ("derived", "shadow_fleet_cluster", ago(minutes=1), 10.0, 20.0, 60), ("none", "usgs_quake", ago(minutes=1), None, None, 60)]
    events = spark.createDataFrame([(i, t, at, lat, lng, d, 5.0, "title " + i) for i, t, at, lat, lng, d in rows], "id string, event_type string, event_time timestamp, lat double, lng double, decay_half_life_min int, severity double, title string")
    found = encounters.event_proximity(now, events, AS_OF())
    assert {r["key"] for r in found.collect()} == {"q", "slow"}
    assert {r["key"] for r in encounters.event_proximity(now, events, AS_OF(), prior=found).collect()} <= {"slow"}  # repeats drop inside the window


def test_withdrawn_rows_keep_their_properties(spark, tables):
    f = tables.finding
    out = corrections.withdraw(f, corrections.stale_pings(f), AS_OF(), "audit")
    row = out.filter("withdrawal_reason is not null").first()
    assert row is not None and '"withdrawn":true' in row["properties"] and '"hours_dark"' in row["properties"]
    assert out.count() == f.count()
