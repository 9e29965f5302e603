"""Shapes of physical plans, the contract of the entry module, and the detection cycle."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import DATA
from tidemark.operators import serving
from tidemark.plans import cycle
from tidemark.sources import refdata as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d1_event_proximity", "d2_entity_proximity", "d5_rendezvous", "d11_sanctions_match", "d14_listed_rendezvous", "p8_subscription_predicate", "j10_watchlist_join"])
def test_no_nested_loops(spark, name):
    text = plan(queries()[name](spark, DATA))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan(queries()["w6_top_per_type"](spark, DATA)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(queries()["w7_global_top"](spark, DATA))


def test_filters_and_columns_reach_the_scan(spark, tables):
    as_of = F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz")
    rows = tables.raw("events").filter(F.col("ts") >= as_of).select("event_id")
    text = plan(rows)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
    assert "user_id" not in plan(serving.event_by_id(tables.finding.select("id", "title"), "F1"))


def test_entry_and_registry(spark):
    df = entry(spark)
    assert "entity_id" in df.columns and df.count() > 0
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 160


def test_cycle_isolates_failures_and_feeds_later_detectors(spark, tables, monkeypatch):
    names = ["loitering", "sanctions_match", "multi_authority"]
    monkeypatch.setattr(cycle, "DETECTORS", {n: cycle.DETECTORS[n] for n in names})
    events = tables.finding.drop("event_id", "last_seen", "members", "user_id").filter("event_type = 'usgs_quake'").withColumn("event_ids", F.lit(None).cast("array<string>"))
    options = {"loitering": {"no_such_option": 1}, "sanctions_match": {"fresh_hours": 14 * 24}}
    inputs = cycle.Inputs(tables.current, tables.track, events, tables.ports, R.zones_df(spark), tables.listed, tables.as_of, options)
    state = cycle.run_cycle(inputs)
    assert state["loitering"].startswith("TypeError") and state["sanctions_match"] == state["multi_authority"] == "ok"
    totals = {r["detector"]: r["findings"] for r in cycle.totals(spark, inputs, state).collect()}
    assert totals["loitering"] == 0 and totals["multi_authority"] > 0


def partition_filters(df, place):
    """Those of the scans of one place."""
    scans = [line for line in plan(df).splitlines() if "FileScan" in line and place in line]
    return [line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in scans]


def test_time_bounds_prune_stored_days(spark, tables, tmp_path):
    from tidemark.operators import aggregates, bounds, merge
    from tidemark.operators.detectors import base, encounters, listed, ports
    from tidemark.sources import sinks

    rows = tables.finding.drop("event_id", "last_seen", "members", "user_id").withColumn("event_ids", F.lit(None).cast("array<string>"))
    path = str(tmp_path / "events")
    sinks.append_events(spark, rows, path)
    stored = spark.read.parquet(path)
    as_of = F.lit(datetime(2024, 1, 20)).cast("timestamp")
    start, box, batch = as_of - F.expr("INTERVAL 2 DAYS"), (-30.0, -30.0, 30.0, 30.0), rows.limit(20)
    categories = spark.createDataFrame([("usgs_quake", "quakes", "high")], "event_type string, category_id string, level string")
    subscribers = spark.createDataFrame([], "verified boolean, unsubscribed_at timestamp")
    found = {
        "insert_absent": merge.insert_absent(stored, batch), "insert_absent_by_id": merge.insert_absent_by_id(stored, batch, as_of),
        "prior": base.not_found_before(batch, stored, start), "in_box": serving.events_in_box(stored, box, start, as_of),
        "viewport": serving.viewport_events(stored, box, start, as_of), "partners": serving.partners(stored, tables.entity, "7", as_of),
        "entity_events": serving.entity_events(tables.current, stored, "7", as_of), "alerts": serving.recent_alerts(stored, ["usgs_quake"], as_of),
        "by_algorithm": serving.findings_by_algorithm(stored, "algo_1", as_of), "signals": serving.signals_today(stored, categories, as_of),
        "dashboard": aggregates.dashboard(stored, subscribers, categories, as_of), "by_type": aggregates.counts_by_type(stored, as_of),
        "buckets": aggregates.time_buckets(stored, categories, as_of), "series": aggregates.dense_series(stored, ["usgs_quake"], start),
        "departures": ports.port_departures(tables.current, tables.ports, as_of, stored),
        "proximity": encounters.event_proximity(tables.current, stored, as_of, longest_decay_min=5000),
        "snapshot": sinks.snapshot(stored, as_of), "feed": sinks.feed_items(stored, as_of), "situation": aggregates.situation_facts(stored, as_of),
        "listed_arrivals": listed.listed_port_arrivals(stored, as_of),
    }
    for name, df in found.items():
        filters = partition_filters(df, tmp_path.name)
        assert filters and all(bounds.DATE in f for f in filters), (name, filters)
    lo, hi = datetime(2024, 1, 18), datetime(2024, 1, 20)
    want = rows.filter(F.col("event_time").between(F.lit(lo), F.lit(hi))).dropDuplicates(["id", "event_time"]).count()
    assert sinks.read_events(spark, path, lo, hi).count() == want == bounds.since(stored, F.lit(lo), F.lit(hi)).count()


def test_fleet_members_are_kept(spark):
    """All members of a fleet are in its finding, and either finds it by any of them."""
    from tidemark.operators.detectors import clusters

    as_of = F.lit(datetime(2024, 1, 20)).cast("timestamp")
    rows = [(f"v{k}", datetime(2024, 1, 20), "k", 10 + k * 0.001, 20.0, "A", f"ship {k}", str(k)) for k in range(9)]
    latest = spark.createDataFrame(rows, "entity_id string, event_time timestamp, key string, lat double, lng double, authority string, name string, mmsi string")
    found = clusters.fleet_clusters(clusters.fleet_members(latest), as_of)
    row = found.first()
    assert row.entity_ids == sorted(f"v{k}" for k in range(9))
    named = found.withColumns({"id": F.lit("f1"), "event_time": as_of})
    entities = spark.createDataFrame([(f"v{k}", f"ship {k}", "vessel", str(k)) for k in range(9)], "entity_id string, display_name string, entity_type string, canonical_id string")
    partners = serving.partners(named, entities, "v7", as_of).first().partners
    assert [p.member_id for p in partners] == sorted(f"v{k}" for k in range(9) if k != 7)
    assert serving.membership(named).count() == 9


def scanned(df):
    """Rows that the scans of an executed plan put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_boxes_reach_the_scan(spark, tables, tmp_path):
    """A table laid out by place: the box becomes key ranges, of which the scan reads little more than the box."""
    import random

    from tidemark.operators import bounds
    from tidemark.sources import sinks

    rng = random.Random(1)
    crowd = lambda k: (rng.gauss(1.3, 0.05), rng.gauss(103.8, 0.05)) if k % 3 == 0 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
    rows = [(str(k), datetime(2024, 1, 1 + k % 2, k % 24), False, *crowd(k)) for k in range(30_000)] + [("x", datetime(2024, 1, 1), False, None, 3.0)]
    events = spark.createDataFrame(rows, "id string, event_time timestamp, withdrawn boolean, lat double, lng double")
    path = str(tmp_path / "placed")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sinks.write_by_place(events, path)
        stored = spark.read.parquet(path)
        for box in ((-10.0, -10.0, 10.0, 10.0), (170.0, -20.0, -175.0, 20.0), (103.0, 1.0, 104.5, 2.0), (-180.0, -90.0, 180.0, 90.0)):
            got, want = bounds.within(stored, box), bounds.within(events, box)
            assert {r.id for r in got.select("id").collect()} == {r.id for r in want.select("id").collect()}
        few = bounds.within(stored, (20.0, 20.0, 40.0, 40.0)).select("id", "lat", "lng")
        text = plan(few)
        assert "PushedFilters: [" in text and "Or(And(Gre" in text.split("PushedFilters: [")[1]
        assert scanned(few) < 0.2 * len(rows)
        assert len(list((tmp_path / "placed").glob("event_date=2024-01-01/*.parquet"))) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    for _ in range(200):
        lat, lng = rng.uniform(-90, 90), rng.uniform(-180, 180)
        box = (lng - rng.random() * 9, lat - rng.random() * 9, lng + rng.random() * 9, lat + rng.random() * 9)
        ranges = bounds.box_ranges(box)
        key = 0
        x, y = (min(max(int((v - lo) / span * 4096), 0), 4095) for v, lo, span in ((lng, -180, 360), (lat, -90, 180)))
        for b in range(12):
            key |= (x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1
        assert any(lo <= key <= hi for lo, hi in ranges) and 1 <= len(ranges) <= bounds.RANGES


def test_partners_from_one_bucket(spark, tables, tmp_path):
    """A member with a third of all findings and one with few: one bucket is read, and the rows are those of the array scan."""
    from tidemark.sources import sinks

    rows = [(f"f{k}", datetime(2024, 1, 1 + k % 20), "t" if k % 2 else "u", ["hot", f"m{k % 50}"] if k % 3 == 0 else [f"m{k % 50}", f"m{k % 7}", f"m{k % 50}"]) for k in range(900)]
    findings = spark.createDataFrame([*rows, ("none", datetime(2024, 1, 5), "t", None)], "id string, event_time timestamp, event_type string, entity_ids array<string>")
    entities = spark.createDataFrame([(f"m{k}", f"ship {k % 9}", "vessel", str(k)) for k in range(40)], "entity_id string, display_name string, entity_type string, canonical_id string")
    sinks.write_membership(findings, "membership_test", str(tmp_path / "members"), 16)
    table = spark.table("membership_test")
    as_of = F.lit(datetime(2024, 1, 20)).cast("timestamp")
    try:
        for member in ("hot", "m3", "nobody"):
            got = serving.partners_of(table, entities, member, as_of, 24 * 9, ["t"], limit=40)
            want = serving.partners(findings, entities, member, as_of, 24 * 9, ["t"], limit=40)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert "SelectedBucketsCount: 1 out of 16" in plan(got)
    finally:
        spark.sql("DROP TABLE membership_test")


@pytest.mark.parametrize("lacking", ["folders", "zstandard"])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, lacking):
    """In a copy without them, or without a package that only they need, all other queries are registered."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    if lacking == "folders":
        for name in ("tidemark/llm", "tests/llm"):
            shutil.rmtree(copy / name)
        (copy / "corpus_pipeline.py").unlink()
    hide = "import sys; sys.modules['zstandard'] = None; " if lacking == "zstandard" else ""
    code = hide + "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    rest = [n for n in queries() if not n.startswith("op") and n != "pipeline"]
    assert said.stdout.split() == [str(len(rest)), "0"] and ("left out" in said.stderr) == (lacking == "zstandard")


def test_pairs_of_radius_joins_are_dealt_and_take_no_json(spark):
    """Tasks are not merged by what a join of few rows and many pairs reads, and no pair is written as JSON to be read again."""
    text = plan(queries()["d1_event_proximity"](spark, DATA))
    assert "REPARTITION_BY_NUM" in text and "to_json" not in text and "get_json_object" not in text
