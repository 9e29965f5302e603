"""Work that must not grow faster than the input: what meets in joins, and what is sent to all."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import DATA
from tidemark.functions.geo import within_m
from tidemark.functions.text import trigrams
from tidemark.operators import dedup, names, serving, spatial, watch
from tidemark.operators.detectors import encounters
from tidemark.streaming import flows


def test_values_in_force_are_not_broadcast(spark):
    text = queries()["j9_valid_at_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange HashedRelation" not in text


def test_grading_meets_each_pair_of_positions_once(spark, monkeypatch):
    met, plain = [], watch.radius_join

    def join(probe, build, *rest, **more):
        found = plain(probe, build, *rest, **more)
        met.append(found.count())
        return found

    monkeypatch.setattr(watch, "radius_join", join)
    due = F.lit("2024-01-01").cast("timestamp")
    asked = spark.range(40).select(F.col("id").cast("string").alias("prediction_id"), (F.col("id") % 2 * 40.0).alias("lat"), F.lit(10.0).alias("lng"), F.when(F.col("id") < 38, "quake").otherwise("cyber").alias("category"), F.lit("pending").alias("status"), due.alias("due_at"))
    quakes = spark.range(30).select(F.col("id").alias("quake_id"), (F.col("id") % 7).cast("double").alias("magnitude"), F.concat(F.lit("p"), "id").alias("place"), (F.col("id") % 3 * 40.0).alias("lat"), F.lit(11.0).alias("lng"))
    rows = {r["prediction_id"]: r for r in watch.grade_predictions(asked, quakes, quakes.limit(0), due).collect()}
    assert len(rows) == 40 and met == [2]
    assert (rows["0"]["outcome"], rows["0"]["evidence_count"], rows["0"]["place"]) == ("win", 10, "p6")
    assert (rows["1"]["evidence_count"], rows["1"]["magnitude"], rows["1"]["place"]) == (10, 6.0, "p13")
    assert rows["38"]["outcome"] == "unresolved" and rows["38"]["evidence_count"] == 0


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.9])
def test_similar_names_equal_all_pairs(spark, threshold):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ABC1") for _ in range(rnd.randint(1, 9)))
    pool = [" ".join(word() for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    # The second half differs from the first by a letter here and there.
    pool += [n[:k] + rnd.choice("ABC 1") + n[k + 1 :] for n in pool for k in (rnd.randrange(len(n)),)] + ["A", "B", "AB"]
    rows = spark.createDataFrame([(n,) for n in pool], "name string")
    grams = {r["name"]: frozenset(r["g"]) for r in rows.distinct().select("name", trigrams(F.col("name")).alias("g")).collect()}
    want = {(a, b) for a in grams for b in grams if grams[a] and grams[b] and _jaccard(grams[a], grams[b]) >= threshold - 1e-12}
    assert {(r["left_name"], r["right_name"]) for r in names.similar_names(rows, rows, threshold).collect()} == want


def test_names_that_share_words_seldom_meet(spark):
    rows = spark.range(3000).select(F.concat_ws(" ", F.lit("LARGE RING"), (F.col("id") + 100_000).cast("string")).alias("name")).withColumn("grams", trigrams(F.col("name")))
    frequency = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    index = names._indexed(rows, frequency, 0.9)
    key = index.columns[-1] if "gram" in index.columns else "key"
    pairs = index.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert pairs < 3000 * 100


def test_a_window_compares_with_what_is_near(monkeypatch):
    calls, plain = [], dedup._km
    monkeypatch.setattr(dedup, "_km", lambda *at: calls.append(1) or plain(*at))
    rnd = random.Random(3)
    window = dedup.GreedyWindow(1e9, 0.85, 50)
    for i in range(2000):
        window.judge(i, str(i), ["a", "b"], rnd.uniform(-80, 80), rnd.uniform(-180, 180))
    assert 0 < len(window.rows) <= 2000 and len(calls) < 2000 * 5


@pytest.mark.parametrize("seed", range(8))
def test_a_window_equals_a_search_of_all_rows(seed):
    rnd, nan = random.Random(seed), float("nan")
    threshold, radius, width = rnd.choice([0.5, 0.85]), rnd.choice([0.1, 50, 5000]), rnd.choice([50, 500])
    window, held, at = dedup.GreedyWindow(width, threshold, radius), [], 0.0
    for i in range(600):
        at += rnd.random() * 2
        toks = frozenset(t for t in "abcdefg" if rnd.random() < 0.6)
        lat, lng = (nan, nan) if rnd.random() < 0.1 else (rnd.choice([rnd.gauss(0, 1), 89.9, -90]), rnd.choice([180, -180, 179.99, rnd.gauss(0, 1)]))
        want = (None, None)
        for t, other, theirs, o_lat, o_lng in reversed(held):
            s = dedup._jaccard(toks, theirs)
            if t >= at - width and s >= threshold and (lat != lat or o_lat != o_lat or dedup._km(lat, lng, o_lat, o_lng) <= radius):
                want = (other, s)
                break
        if want == (None, None):
            held.append((at, str(i), toks, lat, lng))
        assert window.judge(at, str(i), toks, lat, lng) == want


def test_tracks_meet_by_place_and_time(spark, monkeypatch):
    """Equal to all pairs of pings; and no pair of pings at other times is formed, as candidates by place alone would be."""
    rnd = random.Random(3)
    pings = [(str(rnd.randrange(12)), rnd.randrange(40_000), rnd.choice([10.0, 179.999, 89.999]), rnd.choice([179.999, -179.999, 20.0]), rnd.uniform(-0.012, 0.012)) for _ in range(700)]
    pings = [(i, s, min(90.0, lat + d), lng + d / 2) for i, s, lat, lng, d in pings if lat < 91] + [("0", 5, None, 1.0), ("1", 5, 1.0, None)]
    track = spark.createDataFrame(pings, "entity_id string, s long, lat double, lng double").select("entity_id", F.timestamp_seconds("s").alias("time"), "lat", "lng")
    a, b = (track.select(*[F.col(c).alias(side + c) for c in track.columns]) for side in ("a_", "b_"))
    near = (F.abs(F.unix_seconds("a_time") - F.unix_seconds("b_time")) <= 60) & within_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"), 1000)
    span = (F.unix_seconds(F.max("a_time")) - F.unix_seconds(F.min("a_time"))) / 60
    want = a.join(b, (F.col("a_entity_id") < F.col("b_entity_id")) & near).groupBy("a_entity_id", "b_entity_id").agg(F.count(F.lit(1)).alias("n"), span.alias("m")).filter("n >= 2 and m >= 20")
    want = {(r[0], r[1], r[2], round(r[3], 6)) for r in want.collect()}
    start = F.lit(0).cast("timestamp")
    for frame, hot in ((256, 20_000), (2, 5)):
        monkeypatch.setattr(encounters, "FRAME", frame)
        monkeypatch.setattr(encounters, "salted", lambda x, y, by, hot=hot: spatial.salted(x, y, by, hot))
        assert {(r[0], r[1], r[2], round(r[3], 6)) for r in encounters.sustained_pairs(track, start, 1000).collect()} == want
    assert len(want) > 5
    few = {r[:2] for r in encounters.sustained_pairs(track, start, 1000, track.filter("entity_id < '4'").select("entity_id")).select("a_entity_id", "b_entity_id").collect()}
    assert few == {w[:2] for w in want if w[0] < "4" and w[1] < "4"}
    monkeypatch.setattr(spatial, "self_pairs", lambda *rest, **more: pytest.fail("pings of all times meet"))
    queries()["j12_sustained_pairs"](spark, DATA)


@pytest.mark.parametrize("text", ["red plate", "Red", "a b1", "rød plate", "--"])
def test_search_makes_grams_of_few_names(spark, monkeypatch, text):
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice(["RED", "plate", "plat", "A", "b1", "Größe", "İst", "late", "redplate", "x"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(pool)), "listed_id long, listed_name string").withColumn("listed_imo", F.lit(None).cast("string"))
    found = lambda: {(r["listed_id"], r["match_kind"], r["similarity"]) for r in serving.search_listed(rows, text, 1000).collect()}
    got, refused = found(), rows.filter(~serving._may_reach(F.col("listed_name"), text, 0.4)).count()
    monkeypatch.setattr(serving, "_may_reach", lambda *rest: F.lit(True))
    assert got == found() and (refused > 50 or text in ("a b1", "rød plate", "--"))


def test_watch_stream_keeps_events_and_not_matches(spark, tmp_path):
    lists = [(w, [], 10.0, 20.0 + k, 300.0, 0, True) for w in range(50) for k in range(1 + w % 2)]
    watchlists = spark.createDataFrame(lists, "watch_id long, layers array<string>, center_lat double, center_lng double, radius_km double, min_severity int, enabled boolean")
    schema = "event_id long, event_time timestamp, layer string, lat double, lng double, severity int"
    events = spark.range(20).selectExpr("id % 10 AS event_id", "timestamp'2024-01-01' AS event_time", "'news' AS layer", "10.0D AS lat", "20.0D + 4 * (id % 10 % 2) AS lng", "3 AS severity")
    events.union(events).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = flows.watch_stream(stream, watchlists).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("watch_id", "match_id").distinct().count() == 50 * 5
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) == 10


def joined(df):
    """The greatest number of rows that a join of an executed plan puts out."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_subscriptions_that_ask_for_the_same_share_a_rule(spark):
    """Pairs are made from rules, after the join; rows that differ in a null or a type, and repeated rows, stay apart."""
    events = spark.range(600).selectExpr(
        "id", "IF(id % 3 = 0, 't', 'u') AS event_type", "'x' AS event_subtype", "0.5D AS confidence", "CAST(id % 10 AS DOUBLE) AS severity",
        "IF(id % 2 = 0, NULL, 10D + id % 7) AS lat", "IF(id % 2 = 0, NULL, 20D) AS lng",
    )
    names = "sub_id int, categories array<string>, subcategories array<string>, min_confidence double, min_severity double, area string, west double, south double, east double, north double, center_lat double, center_lng double, radius_km double"
    kinds = [
        (["t"], [], 0.2, 3.0, "bbox", 0.0, 0.0, 30.0, 12.0, None, None, None), (["t"], [], 0.2, 3.0, "bbox", None, 0.0, 30.0, 12.0, 0.0, None, None),
        (["t", "u"], None, 0.2, None, "global", *[None] * 7), ([], [], 0.2, 3.0, "circle", *[None] * 4, 10.0, 20.0, 250.0), (["u"], [None], 0.2, 3.0, "global", *[None] * 7),
    ]
    subs = spark.createDataFrame([(None if k == 7 else k - k % 11 // 10, *kinds[k % 5]) for k in range(3000)], names)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = watch.subscription_join(events, subs)
        got = sorted((str(r["sub_sub_id"]), r["id"]) for r in found.select("sub_sub_id", "id").collect())
        assert joined(found) < len(got) / 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    mine = subs.select(*[F.col(c).alias("sub_" + c) for c in subs.columns])
    assert got == sorted((str(r["sub_sub_id"]), r["id"]) for r in events.join(mine, watch.subscription_matches("", "sub_")).select("sub_sub_id", "id").collect())
    assert found.columns == [*events.columns, *mine.columns] and watch.rules_of(subs, watch.SUBSCRIPTION_RULE).rules.count() == 5


def test_alerts_are_found_in_few_events(spark, monkeypatch):
    """Lists look on only while they have too few; pairs that have fired, events dealt with for all, lists of two circles, events without time."""
    rnd = random.Random(5)
    at = lambda k: f"2024-01-{1 + k % 20:02d} 00:00:{rnd.randrange(60):02d}" if k % 9 else None
    rows = [(k, at(k), "abc"[k % 3], rnd.choice([10.0, 10.2, 40.0]), 20.0 + k % 5 / 10, rnd.randrange(9)) for k in range(2000)]
    rows += [(9000 + k, "2024-03-01 00:00:00", "late", -50.0, 100.0, 9) for k in range(40)] + [(9999, None, "a", None, 3.0, 9)]
    geo = spark.createDataFrame(rows, "event_id long, at string, layer string, lat double, lng double, severity int").withColumn("event_time", F.col("at").cast("timestamp"))
    events = watch.watch_sources(geo.drop("at"))
    cells = spark.createDataFrame([(["a"], 10.0, 20.0, 9), (["b"], 10.0, 21.0, 1)], "layers array<string>, center_lat double, center_lng double, severity int")
    events = events.unionByName(watch.watch_sources(geo.limit(0).drop("at"), clusters=cells))
    kinds = [([], 10.0, 20.0, 60.0, 3), (["a", "c"], 10.2, 20.3, 40.0, 0), ([], -50.0, 100.0, 10.0, 5), ([], 40.0, 20.0, 500.0, 8), (["none"], 10.0, 20.0, 900.0, 0), (None, 0.0, 0.0, 25_000.0, 9)]
    lists = [(f"w{k}", *kinds[k % 6], k % 29 != 3) for k in range(240)] + [("w1", *kinds[3], True)]
    watchlists = spark.createDataFrame(lists, "watch_id string, layers array<string>, center_lat double, center_lng double, radius_km double, min_severity int, enabled boolean")
    every = watch.watch_matches(events, watchlists)
    memory = every.withColumn("n", F.expr("try_cast(split(match_id, ':')[1] AS INT)")).filter("(watch_id = 'w0' AND n % 3 > 0) OR (watch_id IN ('w1', 'w2') AND n < 9035) OR n % 7 = 0")
    fired = memory.select("watch_id", "match_id").unionByName(events.filter("match_id LIKE 'c:%5'").select(F.lit(None).cast("string").alias("watch_id"), "match_id")).localCheckpoint()
    done = fired.filter("watch_id IS NULL").select("match_id")
    left = every.join(fired, ["watch_id", "match_id"], "left_anti").join(done, "match_id", "left_anti")
    order = [F.asc("kind_order"), F.asc_nulls_last("event_time"), F.asc("match_id")]
    want = sorted((r.watch_id, r["rank"], r.match_id) for r in watch.top_per_group(left, ["watch_id"], order, 5).collect())
    seen, plain = [], watch.top_per_group
    monkeypatch.setattr(watch, "top_per_group", lambda df, *rest: seen.append(df.count()) or plain(df, *rest))
    monkeypatch.setattr(watch.leaves, "MOST", 20)
    monkeypatch.setattr(watch, "STRETCH", 4)
    got = sorted((r.watch_id, r["rank"], r.match_id) for r in watch.watch_alerts(events, watchlists, fired).collect())
    assert got == want and len(got) > 800 and len(seen) == 5
    assert max(seen) < every.count() / 5


def test_watch_stream_stores_matches_of_rules(spark, tmp_path, monkeypatch):
    """Lists that ask for the same (the query's repeat after 4,680) are stored once for each match, and all of them are in the result."""
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet")
    suppliers.join(spark.range(6).withColumnRenamed("id", "k")).withColumn("s_suppkey", F.col("s_suppkey") + 4680 * F.col("k")).drop("k").write.parquet(str(tmp_path / "supplier.parquet"))
    stored, plain = [], flows.drain
    monkeypatch.setattr(flows, "drain", lambda stream: stored.append(plain(stream)) or stored[-1])
    found = {(r["watch_id"], r["match_id"]) for r in queries()["t7_watch_stream"](spark, str(tmp_path)).collect()}
    few = {(w, m) for w, m in found if int(w) < 4680}
    assert found == {(str(int(w) + 4680 * k), m) for w, m in few for k in range(6)} and len(few) > 10
    assert stored[0].count() == len(few)
