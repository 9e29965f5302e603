"""Merges, sinks, analytics and streams."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, anomaly, dedup, embedding, forecast, merge, resolution, serving, watch
from tidemark.sources import sinks
from tidemark.streaming import flows, state

NOW = datetime(2026, 5, 20, 12, 0, 0)


def test_upsert_keeps_newer_motion_but_merges_properties(spark):
    schema = "entity_type string, canonical_id_type string, canonical_id string, display_name string, properties map<string,string>, position_time timestamp, lat double, lng double, velocity_ms double, heading_deg double, altitude_m double"
    row = lambda name, props, at, v: ("vessel", "mmsi", "1", name, props, at, 1.0, 2.0, v, 0.0, 0.0)
    state_df = spark.createDataFrame([row("OLD", {"a": "1", "b": "1"}, NOW, 5.0)], schema).withColumn("last_seen", F.col("position_time"))
    batch = spark.createDataFrame([row(None, {"b": "2", "c": "2"}, NOW - timedelta(hours=1), 9.0)], schema).withColumn("arrival", F.lit(1))
    got = merge.upsert_entities(state_df, batch).first()
    assert got["display_name"] == "OLD" and got["velocity_ms"] == 5.0 and got["properties"] == {"a": "1", "b": "2", "c": "2"} and got["last_seen"] == NOW
    newer = merge.upsert_entities(state_df, batch.withColumn("position_time", F.lit(NOW + timedelta(seconds=1)).cast("timestamp"))).first()
    assert newer["velocity_ms"] == 9.0


def test_append_is_idempotent_and_prunes(spark, tmp_path, tables):
    path = str(tmp_path / "events")
    rows = tables.finding.select("id", "event_time", "event_type", "severity")
    sinks.append_events(spark, rows, path)
    sinks.append_events(spark, rows, path)
    assert spark.read.parquet(path).count() == rows.count()
    day = sinks.read_events(spark, path, datetime(2024, 1, 3), datetime(2024, 1, 4))
    text = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text and 0 < day.count() < rows.count()
    dropped = sinks.drop_expired(spark, path, "2024-01-30", 10)
    assert dropped and spark.read.parquet(path).agg(F.min("event_date")).first()[0].isoformat() == "2024-01-20"


def test_csv_snapshot(spark, tmp_path, tables):
    out = str(tmp_path / "csv")
    rows = sinks.snapshot(tables.finding, tables.as_of, 720, "critical", limit=20)
    assert rows.columns == list(sinks.SNAPSHOT_COLUMNS)
    sinks.write_csv(rows.coalesce(1), out)
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes().decode()
    assert text.count("\r\n") == 21 and text.startswith("event_time_utc,severity") and "null" not in text
    sinks.write_rss(sinks.feed_items(tables.finding, tables.as_of, 720), str(tmp_path / "rss"))
    assert "<item>" in next((tmp_path / "rss").glob("part-*")).read_text()


def news(spark, rows):
    """rows: id, minutes, title, lat, lng"""
    return spark.createDataFrame(
        [(i, NOW + timedelta(minutes=m), "conflict.x", t, None, None, lat, lng) for i, m, t, lat, lng in rows],
        "event_id string, timestamp timestamp, subcategory string, title string, actor1_name string, actor2_name string, lat double, lng double",
    )


def greedy(rows, window=60, threshold=0.85, radius=50):
    """Row-by-row definition of the filter."""
    accepted, out = [], {}
    for i, m, title, lat, lng in sorted(rows, key=lambda r: (r[1], r[0])):
        toks = frozenset((title + " conflict x").split())
        hit = None
        for j, n, other, la, lo in reversed([a for a in accepted if a[1] >= m - window]):
            if None not in (lat, lng, la, lo) and dedup._km(lat, lng, la, lo) > radius:
                continue
            if len(toks & other) / len(toks | other) >= threshold:
                hit = j
                break
        out[i] = hit
        if hit is None:
            accepted.append((i, m, toks, lat, lng))
    return out


def duplicates_fixture(seed=5, n=160):
    import random

    rng = random.Random(seed)
    base = ["alpha beta gamma delta epsilon zeta eta", "alpha beta gamma delta epsilon zeta theta", "one two three four five six seven", "quick brown fox"]
    rows = []
    for k in range(n):
        place = rng.choice([(10.0, 20.0), (10.1, 20.0), (40.0, 20.0), (None, None)])
        rows.append((f"e{k:03}", rng.randint(0, 600), rng.choice(base) + rng.choice(["", " more"]), *place))
    return rows


def test_near_duplicates_equal_the_greedy_definition(spark):
    rows = duplicates_fixture()
    got = {r["event_id"]: r["duplicate_of"] for r in dedup.near_duplicates(news(spark, rows)).collect()}
    want = greedy(rows)
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert len(got) == len(rows)


def test_rejected_rows_do_not_represent(spark):
    text = "a b c d e f g h"
    rows = [("1", 0, text, None, None), ("2", 40, text, None, None), ("3", 80, text, None, None)]
    got = {r["event_id"]: r["duplicate_of"] for r in dedup.near_duplicates(news(spark, rows)).collect()}
    assert got == {"1": None, "2": "1", "3": None}  # "2" was rejected, so "3" starts anew
    counts = dedup.duplicate_counts(dedup.near_duplicates(news(spark, rows))).collect()
    assert [(c["event_id"], c["duplicate_count"]) for c in counts] == [("1", 1)]


@pytest.mark.parametrize("block_rows", [15, 60])
def test_blocks_of_a_long_chain_end_as_one_walk(spark, block_rows):
    """One text holds a third of all rows over two days; blocks are walked side by side until their pasts agree."""
    import random

    rng = random.Random(block_rows)
    rows = duplicates_fixture(3, 120) + [(f"h{k:03}", rng.randint(0, 3000), "alpha beta gamma delta epsilon zeta eta", *rng.choice([(10.0, 20.0), (10.3, 20.0), (None, None)])) for k in range(250)]
    got = {r["event_id"]: r["duplicate_of"] for r in dedup.near_duplicates(news(spark, rows), block_rows=block_rows).collect()}
    want = greedy(rows)
    assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert len(got) == len(rows)
    steady = [(f"s{k:03}", 7 * k, "one two three four", None, None) for k in range(300)]  # no two walks ever meet by themselves
    got = {r["event_id"]: r["duplicate_of"] for r in dedup.near_duplicates(news(spark, steady), block_rows=40).collect()}
    assert got == greedy(steady)


def test_news_filter_over_epochs(spark, tmp_path):
    rows = sorted(duplicates_fixture(11, 150), key=lambda r: r[1])
    cuts = [[r for r in rows if a <= r[1] < a + 150] for a in range(0, 601, 150)]
    sink = flows.filter_news(str(tmp_path / "news"))
    for epoch, part in enumerate(cuts):
        sink(news(spark, part), epoch)
    sink(news(spark, cuts[-1]), len(cuts) - 1)  # a retried epoch changes nothing
    sink(news(spark, []), len(cuts))
    got = {r["event_id"]: r["duplicate_of"] for r in spark.read.parquet(str(tmp_path / "news/verdicts")).collect()}
    want = greedy(rows)
    assert len(got) == len(rows) and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}


def landed(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_equals_batch(spark, tmp_path, tables):
    rows = news(spark, duplicates_fixture(9, 120))
    stream = {r["event_id"] for r in flows.drain(state.near_duplicates_stream(landed(spark, tmp_path, rows, "n"))).filter("duplicate_of is null").collect()}
    batch = {r["event_id"] for r in dedup.near_duplicates(rows).filter("duplicate_of is null").collect()}
    assert stream == batch
    from tidemark.plans.join_queries import _daily

    daily = _daily(tables).withColumn("cycle", F.col("cycle").cast("bigint"))
    got = flows.drain(state.baseline_stream(landed(spark, tmp_path, daily, "d"))).orderBy(F.desc("cycle"))
    last = {(r["layer"], r["region"]): r for r in got.groupBy("layer", "region").agg(F.max_by(F.struct("mean_before", "cycles_before", "count"), "cycle").alias("x")).select("layer", "region", "x.*").collect()}
    fold = {(r["layer"], r["region"]): r for r in aggregates.ewma_baselines(daily).collect()}
    for key, row in fold.items():
        before = last[key]
        assert before["cycles_before"] == row["n_cycles"] - 1
        if before["mean_before"] is not None:
            assert 0.75 * before["mean_before"] + 0.25 * before["count"] == pytest.approx(row["mean_count"])


def test_values_in_force_equal_a_plain_search(spark):
    """An entity with a third of all events and history; values without end, without length, at the very ends."""
    import random

    rng = random.Random(8)
    at = lambda s: NOW + timedelta(seconds=s)
    history, moments = [], []
    for k in range(600):
        entity = "hot" if k % 3 == 0 else f"e{k % 20}"
        start = rng.choice([0, 256, 1000, 1024, rng.randint(0, 10**6), rng.randint(0, 10**6)])
        stop = rng.choice([None, start, start + 1, start + 256, start + rng.randint(0, 10**5)])
        history.append((entity, rng.choice("ab"), f"v{k}", at(start), None if stop is None else at(stop), k))
        moments.append((entity, k, at(rng.choice([0, 256, 999, 1024, rng.randint(0, 10**6)]))))
    got = merge.valid_at_events(
        spark.createDataFrame(moments, "entity_id string, event_id long, event_time timestamp"),
        spark.createDataFrame(history + [("hot", "a", "x", None, None, 999)], "entity_id string, attribute_name string, attribute_value string, valid_from timestamp, valid_to timestamp, attribute_id long"),
    ).collect()
    want = {}
    for entity, event, moment in moments:
        for e, name, value, start, stop, i in history:
            if e == entity and start <= moment and (stop is None or stop > moment):
                want[event, name] = max(want.get((event, name), (NOW - timedelta(days=1), -1, "")), (start, i, value))
    assert {(r["event_id"], r["attribute_name"]): r["attribute_value"] for r in got} == {k: v[2] for k, v in want.items()}


def moves(spark, rows):
    """rows: id, hours, state"""
    return spark.createDataFrame(
        [(i, NOW + timedelta(hours=h), n, float(s), 0.0, 1, "k", 0.0) for n, (i, h, s) in enumerate(rows)],
        "id string, event_time timestamp, seq long, lat double, lng double, severity int, kind string, altitude_m double",
    )


def test_changes_in_order_of_event_time(spark, tmp_path):
    """Late rows take their place, and ids that fall silent leave the state."""
    path = str(tmp_path / "moves")
    rows = [("a", 0, 1), ("a", 3, 2), ("b", 0, 5), ("hot", 0, 1)] + [("hot", 1 + k / 10, k // 5) for k in range(30)]
    moves(spark, rows).coalesce(1).write.parquet(path)
    late = [("a", 2, 1), ("a", 4, 2), ("b", 9, 5)]  # at 2 h "a" is still as it was: not a change
    moves(spark, [("z", 0, 0)] * 100 + late).filter("id <> 'z'").coalesce(1).write.mode("append").parquet(path)
    moves(spark, [("z", 0, 0)] * 200 + [("b", 200, 5), ("end", 400, 0)]).filter("id <> 'z'").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(moves(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["id"], r["seq"]) for r in flows.drain(state.changed_only_stream(stream, late="4 hours", idle_days=2)).filter("id <> 'end'").collect())
    want = sorted([("a", 0), ("a", 1), ("b", 2), ("b", 200)] + [("hot", 3), ("hot", 4)] + [("hot", 4 + k) for k in range(5, 30, 5)])
    assert got == want


def replayed(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("buckets", [1, 3])
def test_ids_share_a_state(spark, tmp_path, buckets):
    """Changes and silences of many ids in few states equal those of one id after the other, over several batches."""
    import random

    rng = random.Random(buckets)
    pings = sorted(((rng.randrange(60 * 24 * 8), rng.choice([None, *"abcdefghij"]), k) for k in range(160)), key=lambda p: (p[0], p[2]))
    at = lambda minute: NOW + timedelta(minutes=minute)
    close = 60 * 24 * 30
    batches = lambda make, last: [*([make(*p) for p in pings[k : k + 40]] for k in (0, 40, 80, 120)), [last]]

    row = lambda minute, i, k: (i, at(minute), k, 1.0 * (k % 2), 2.0, k % 2, "state", None)
    stream = replayed(spark, str(tmp_path / "moves"), batches(row, ("end", at(close), 999, 0.0, 0.0, 0, "state", None)), moves(spark, []).schema)
    got = flows.drain(state.changed_only_stream(stream, late="4 hours", idle_days=2, buckets=buckets)).filter("seq < 999").collect()
    want, last = [], {}
    for minute, i, k in pings:
        if i not in last or last[i][1] != k % 2 or minute - last[i][0] >= 2 * 24 * 60:
            want.append((i, k))
        last[i] = (minute, k % 2)
    assert sorted(((r.id, r.seq) for r in got), key=str) == sorted(want, key=str)

    ping = lambda minute, i, k: (i, at(minute), k, 1.0, None, k % 3 * 0.4)
    stream = replayed(spark, str(tmp_path / "pings"), batches(ping, ("end", at(close), 999, 0.0, 0.0, 9.0)), "entity_id string, time timestamp, ping_id long, lat double, lng double, velocity_ms double")
    got = flows.drain(state.silent_vessels_stream(stream, buckets=buckets)).collect()
    want = []
    for i in {p[1] for p in pings}:
        own = [p for p in pings if p[1] == i]
        for (minute, _, k), after in zip(own, [*(p[0] for p in own[1:]), close]):
            if after - minute >= 6 * 60 and k % 3 * 0.4 > 0.5:
                want.append((i, at(minute)))
    assert sorted(((r.entity_id, r.last_seen.replace(tzinfo=NOW.tzinfo)) for r in got), key=str) == sorted(want, key=str)


def test_positions_as_a_log(spark, tmp_path):
    """An epoch writes what it touched; bases fold the log; a retry and a late reader see the same."""
    path = str(tmp_path / "positions")
    import random

    rng = random.Random(4)
    schema = "entity_type string, canonical_id_type string, canonical_id string, display_name string, properties map<string,string>, event_time timestamp, position_time timestamp, lat double, lng double, velocity_ms double, heading_deg double, altitude_m double"
    sink, whole, every = flows.merge_positions(path, buckets=4, compact_every=3), flows.empty_state(spark), []
    for epoch in range(8):
        ids = range(60) if epoch == 0 else rng.sample(range(60), 4)
        rows = [("vessel", "mmsi", str(i), rng.choice([None, f"n{epoch}"]), {f"k{epoch % 2}": str(epoch)}, NOW + timedelta(minutes=epoch), NOW + timedelta(minutes=rng.randint(-30, 30)), float(epoch), 1.0, 2.0, 3.0, 4.0) for i in ids]
        batch = spark.createDataFrame(rows if epoch != 5 else [], schema)
        sink(batch, epoch)
        if epoch in (2, 4):
            sink(batch, epoch)
        whole = spark.createDataFrame(merge.upsert_entities(whole, batch.withColumn("arrival", F.unix_micros("event_time"))).select(*whole.columns).collect(), whole.schema)
        if epoch:
            assert sum(1 for _ in (tmp_path / f"positions/log/epoch={epoch}").glob("bucket=*/*.parquet")) <= 4
            assert spark.read.schema(flows.POSITIONS).parquet(f"{path}/log/epoch={epoch}").count() == (0 if epoch == 5 else 4)
    show = lambda df: sorted(str(r.asDict()) for r in df.select(*whole.columns).collect())
    assert show(flows.positions(spark, path)) == show(whole)
    assert [e for e in flows._epochs(spark, f"{path}/base", "upto")] == [2, 5] and min(flows._epochs(spark, f"{path}/log", "epoch")) == 3
    with pytest.raises(RuntimeError):
        flows.merge_positions(path)(batch, 11)


def test_two_sinks_deliver_even_if_the_store_fails(spark):
    seen = []
    def broken(batch, epoch):
        raise OSError("disk")
    run = flows.two_sinks(lambda b, e: seen.append(b.count()), broken)
    with pytest.raises(RuntimeError):
        run(spark.range(3), 0)
    assert seen == [3]


def test_bucket_features(spark):
    row = spark.range(1).select(*anomaly.features_of(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 8, 10)]), F.lit(12))).first()
    assert tuple(row) == pytest.approx((5, 4.8, 10, 8, 24, 0, -1), abs=1e-9)


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(1)
    rows = [("l", "r", *[float(x) for x in rng.normal(5, 1, 5)], 0.0, 1.0) for _ in range(300)] + [("l", "odd", 90.0, 9.0, 10.0, 10.0, 900.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "layer string, region string, " + ", ".join(f"{f} double" for f in anomaly.FEATURES))
    found = anomaly.forest_anomalies(df, df, anomaly.train_forest(df, trees=50)).collect()
    worst = min(found, key=lambda r: r["iso_score"])
    assert worst["region"] == "odd" and len(found) <= 0.06 * len(rows)


def test_forecast_falls_back_and_predicts(spark):
    at = F.lit(NOW).cast("timestamp")
    wave = [("w", "x", NOW - timedelta(hours=h), int(5 + 4 * np.sin(2 * np.pi * h / 24))) for h in range(72)]
    flat = [("f", "x", NOW - timedelta(hours=h), 3) for h in range(72)]
    rows = {r["layer"]: r for r in forecast.hotspots(spark.createDataFrame(wave + flat, "layer string, region string, event_time timestamp, severity int"), at).collect()}
    assert rows["w"]["method"] == "seasonal" and 150 < rows["w"]["score"] < 330
    assert rows["f"]["method"] == "recency_weighted_fallback"


def test_resolution_persists_once(spark):
    vessels = spark.createDataFrame([("v1", "POLA SOFIA", "9111", "111"), ("v2", "OTHER SHIP", None, "222"), ("v3", "NO MATCH", "9999", "333")], "entity_id string, display_name string, imo string, canonical_id string")
    listed = spark.createDataFrame([("S1", "RENAMED", "9111", None), ("S2", "OTHER SHIP", None, "222"), ("S3", "ELSE", "9000", None)], "listed_id string, listed_name string, listed_imo string, listed_mmsi string")
    edges = resolution.alias_edges(vessels, listed, F.lit(NOW).cast("timestamp"), 0.0)
    best = {(r["from_entity"], r["to_entity"]): r["confidence"] for r in edges.collect()}
    assert best[("v1", "S1")] >= 0.99 and ("v2", "S2") in best and ("v3", "S3") not in best
    assert resolution.new_edges(edges, edges).count() == 0
    assert resolution.aliases_of(edges, "v1", 0.5).count() == 1
    assert resolution.alias_edges(vessels.limit(0), listed, F.lit(NOW).cast("timestamp")).count() == 0


def test_predicates_on_subscriptions(spark):
    ev = spark.createDataFrame([("1", "port_call", "SG", 0.9, 7.0, 0.0, 179.0), ("2", "port_call", None, None, 9.0, None, None)], "id string, event_type string, event_subtype string, confidence double, severity double, lat double, lng double")
    sub = spark.createDataFrame(
        [("s", [], [], 0.0, 5.0, "bbox", 170.0, -10.0, -170.0, 10.0, None, None, None)],
        "sub_id string, categories array<string>, subcategories array<string>, min_confidence double, min_severity double, area string, west double, south double, east double, north double, center_lat double, center_lng double, radius_km double")
    assert {r["id"] for r in watch.subscription_join(ev, sub).collect()} == {"1", "2"}


def test_backfill_takes_an_encoder(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id int, body string")
    have = spark.createDataFrame([(2,)], "id int")
    got = embedding.backfill(texts, have, encoder=lambda bodies: np.ones((len(bodies), 3))).collect()
    assert [(r["id"], r["embedding"]) for r in got] == [(1, [1.0, 1.0, 1.0])]


def test_vectors_in_lists(spark, tmp_path):
    """Every vector is in a list; few lists find nearly all neighbours of clustered vectors, all lists find all; a third of them share one direction."""
    from tidemark.operators import vectors

    rng = np.random.default_rng(4)
    middles = rng.normal(size=(25, 16))
    data = [(k, [float(x) for x in (middles[0] if k % 3 == 0 else middles[k % 25]) + 0.25 * rng.normal(size=16)]) for k in range(3000)]
    rows = spark.createDataFrame([*data, (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15)], "id long, embedding array<double>")
    path = str(tmp_path / "vectors")
    vectors.write_lists(rows, path, lists=20, sample=1000)
    assert spark.read.parquet(path + "/lists").count() == 3000
    found = 0
    for k in range(0, 40, 2):
        exact = [r.id for r in serving.similar_vectors(rows.filter("id < 9000"), F.array(*map(F.lit, data[k][1])), 10, F.lit(k)).collect()]
        assert [r.id for r in vectors.from_lists(spark, path, data[k][1], 10, None, k).collect()] == exact
        near = vectors.from_lists(spark, path, data[k][1], 10, 3, k)
        found += len({r.id for r in near.collect()} & set(exact))
    assert found >= 0.9 * 200
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "list#" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_approximate_neighbours(spark, tables):
    rows = tables.raw("embeddings").withColumn("id", F.col("vec_id"))
    seed = rows.orderBy("vec_id").first()["embedding"]
    got = serving.approximate_neighbours(rows, list(map(float, seed)), 5).collect()
    assert got[0]["vec_id"] == 0 or got[0]["distance"] < 1e-6
