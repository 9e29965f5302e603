"""Queries for aggregates (A), windows (W), merges (U), sinks (K) and serving (Q)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates, anomaly, corrections, dedup, latest, merge, serving, vectors
from tidemark.operators.detectors.base import hours
from tidemark.plans.join_queries import CAT_SQL, MAX_TS, _DIGEST, _daily, digest_rows
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import JUDGED_SQL, judged, region_sql
from tidemark.plans.views import CURRENT, Tables, geodesic_sql, haversine_sql, jaccard_sql, trigrams_sql
from tidemark.sources import licence, sinks
from tidemark.sources import refdata as R

c = F.col
CUR = ("entity", "track")
SINCE = lambda h: f"event_time >= {MAX_TS} - INTERVAL {h} HOUR"


def r(x, places=6):
    return F.round(x, places)


# ------------------------------------------------------------------ aggregates
@query("a1_bucket_stats", ("geo",), f"""
    SELECT layer, {region_sql()} AS region, count(*) AS count, round_even(avg(severity), 2) AS avg_severity, max(severity) AS max_severity, CAST(sum(severity) AS BIGINT) AS sev_sum FROM geo GROUP BY 1, 2""")
def a1(t: Tables) -> DataFrame:
    return aggregates.bucket_stats(t.geo)


def signups(t: Tables) -> DataFrame:
    i = c("c_custkey")
    return t.raw("customer").select((i % 3 != 0).alias("verified"), F.when(i % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("unsubscribed_at"))


@query("a2_dashboard", ("finding",), f"""
    SELECT count(*) FILTER (WHERE level IS NOT NULL) AS signals, count(*) FILTER (WHERE level = 'critical') AS critical, count(DISTINCT entity_id) FILTER (WHERE level = 'critical') AS open_cases,
      count(*) FILTER (WHERE level IS NOT NULL AND lat IS NOT NULL) AS geolocated, count(DISTINCT source_id) FILTER (WHERE {SINCE(1)}) AS sources,
      (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0) AS subscribers
    FROM finding LEFT JOIN cat ON cat.event_type = finding.event_type WHERE {SINCE(240)}""", CAT_SQL)
def a2(t: Tables) -> DataFrame:
    return aggregates.dashboard(t.finding, signups(t), R.categories_df(t.spark), t.as_of, 240)


@query("a3_counts_by_type", ("finding",), f"SELECT event_type, count(*) AS cnt FROM finding WHERE NOT withdrawn AND {SINCE(240)} GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    return aggregates.counts_by_type(t.finding, t.as_of, 240)


@query("a4_sanctions_breakdown", ("listed",), """
    SELECT authority, sum(n) FILTER (WHERE entity_type = 'sanctioned_vessel')::BIGINT AS vessels, coalesce(sum(n) FILTER (WHERE entity_type = 'sanctioned_aircraft'), 0)::BIGINT AS aircraft,
      string_agg(entity_type || ':' || regime || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, entity_type, regime) AS regimes
    FROM (SELECT coalesce(authority, 'Unknown') AS authority, entity_type, id_type, coalesce(regime, '') AS regime, count(*) AS n FROM listed GROUP BY 1, 2, 3, 4) GROUP BY 1""")
def a4(t: Tables) -> DataFrame:
    rows = aggregates.sanctions_breakdown(t.listed)
    text = F.array_join(F.transform("regimes", lambda x: F.concat_ws(":", x["entity_type"], x["regime"], (-x["minus_n"]).cast("string"))), ",")
    return rows.select("authority", "vessels", "aircraft", text.alias("regimes"))


@query("a5_time_buckets", ("finding",), f"""
    SELECT time_bucket(INTERVAL 60 MINUTE, event_time) AS bucket, count(*) AS total, count(*) FILTER (WHERE category_id = 'quakes') AS quakes, count(*) FILTER (WHERE level = 'critical') AS critical, count(*) FILTER (WHERE level = 'low') AS low
    FROM finding JOIN cat ON cat.event_type = finding.event_type WHERE {SINCE(240)} GROUP BY 1""", CAT_SQL)
def a5(t: Tables) -> DataFrame:
    rows = aggregates.time_buckets(t.finding, R.categories_df(t.spark), t.as_of, 240, 60)
    return rows.select("bucket", "total", F.coalesce(F.try_element_at("by_category", F.lit("quakes")), F.lit(0)).alias("quakes"), "critical", "low")


_TYPES = ["usgs_quake", "port_call", "no_such_type"]


@query("a6_dense_series", ("finding",), f"""
    SELECT x.event_type, ({MAX_TS} - INTERVAL 240 HOUR) + x.slot * INTERVAL 30 MINUTE AS bucket, coalesce(n, 0) AS n
    FROM (SELECT et AS event_type, slot FROM (VALUES ('usgs_quake'), ('port_call'), ('no_such_type')) AS v(et), range(0, 481) AS s(slot)) x
    LEFT JOIN (SELECT event_type, CAST(floor((epoch_us(event_time) - epoch_us({MAX_TS} - INTERVAL 240 HOUR)) / 1800000000) AS BIGINT) AS slot, count(*) AS n FROM finding WHERE {SINCE(240)} GROUP BY 1, 2) y
      ON y.event_type = x.event_type AND y.slot = x.slot""")
def a6(t: Tables) -> DataFrame:
    return aggregates.dense_series(t.finding, _TYPES, t.as_of - hours(240), 240, 30)


@query("a7_ordered_collections", ("finding",), """
    SELECT entity_id, arg_max(title, event_time) AS latest_title, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms, bool_or(withdrawn) AS any_withdrawn FROM finding GROUP BY 1""")
def a7(t: Tables) -> DataFrame:
    return t.finding.groupBy("entity_id").agg(
        F.max_by("title", F.struct("event_time", "id")).alias("latest_title"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"),
        F.bool_or("withdrawn").alias("any_withdrawn"),
    )


@query("a8_having_threshold", ("finding",), "SELECT entity_id, count(DISTINCT event_type) AS kinds FROM finding GROUP BY 1 HAVING count(DISTINCT event_type) >= 17")
def a8(t: Tables) -> DataFrame:
    return t.finding.groupBy("entity_id").agg(F.count_distinct("event_type").alias("kinds")).filter(c("kinds") >= 17)


def web_hits(t: Tables) -> DataFrame:
    u = c("user_id")
    return t.raw("events").select(
        c("ts").cast("timestamp").alias("ts"), F.when(c("event_type") == "signup", "waitlist_signup").otherwise("pageview").alias("event_type"),
        F.concat(F.lit("/p/"), (c("event_id") % 37).cast("string")).alias("path"), F.concat(F.lit("s"), (u % 13).cast("string")).alias("source"),
        F.when(c("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("https://r"), (u % 17).cast("string"))).alias("referrer"),
        F.when(u % 6 == 0, "").otherwise(F.concat(F.lit("c"), (u % 21).cast("string"))).alias("country"), u.cast("string").alias("visitor"),
    )


def _top(section: str, where: str, item: str, order: str, k: int) -> str:
    return f"(SELECT '{section}' AS section, {item} AS item, count(*) AS hits, count(DISTINCT visitor) AS uniques FROM hit WHERE {where} GROUP BY 2 ORDER BY {order} DESC, item LIMIT {k})"


@query("a9_web_summary", (), "SELECT 'total' AS section, NULL AS item, count(*) AS hits, count(DISTINCT visitor) AS uniques FROM hit UNION ALL " + " UNION ALL ".join((
    _top("path", "kind = 'pageview'", "path", "hits", 20), _top("source", "kind = 'waitlist_signup'", "source", "hits", 10),
    _top("referrer", "kind = 'pageview' AND referrer <> ''", "referrer", "hits", 10), _top("country", "country <> ''", "country", "uniques", 15))), f"""
    hit AS (SELECT CASE event_type WHEN 'signup' THEN 'waitlist_signup' ELSE 'pageview' END AS kind, '/p/' || CAST(event_id % 37 AS VARCHAR) AS path, 's' || CAST(user_id % 13 AS VARCHAR) AS source,
      CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://r' || CAST(user_id % 17 AS VARCHAR) END AS referrer, CASE WHEN user_id % 6 = 0 THEN '' ELSE 'c' || CAST(user_id % 21 AS VARCHAR) END AS country, user_id AS visitor
      FROM events WHERE ts > {MAX_TS} - INTERVAL 240 HOUR)""")
def a9(t: Tables) -> DataFrame:
    return aggregates.web_summary(web_hits(t), t.as_of, 240)


def feed_rows(t: Tables) -> DataFrame:
    u = c("user_id")
    last = t.raw("events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("seen"))
    return last.select(
        u.cast("string").alias("layer"), F.when(u % 10 != 0, c("seen")).alias("last_fetch"), ((u % 5) * 3600 * 4).cast("double").alias("poll_interval_sec"),
        F.when(u % 4 == 0, 86400.0).alias("breach_override_sec"), F.when(u % 20 == 0, c("seen")).alias("created_at"), F.when(u % 9 == 0, "down").alias("health"),
    )


_FEED = f"""feed AS (SELECT u, CASE WHEN u % 10 <> 0 THEN seen END AS last_fetch, u % 5 * 14400 AS poll, CASE WHEN u % 4 = 0 THEN 86400 END AS ov, CASE WHEN u % 20 = 0 THEN seen END AS created, CASE WHEN u % 9 = 0 THEN 'down' ELSE 'ok' END AS health
    FROM (SELECT user_id AS u, max(ts) AS seen FROM events GROUP BY 1)),
  graded AS (SELECT u, health, CASE WHEN poll <= 0 THEN false WHEN last_fetch IS NULL THEN CASE WHEN ov IS NOT NULL AND created IS NOT NULL THEN epoch({MAX_TS})::BIGINT - epoch(created)::BIGINT > ov ELSE true END
    ELSE floor(epoch({MAX_TS}))::BIGINT - floor(epoch(last_fetch))::BIGINT > coalesce(ov, greatest(60, 3 * poll)) END AS breach FROM feed)"""


@query("a10_feed_health", (), "SELECT CAST(u AS VARCHAR) AS layer, breach AS sla_breach, CASE WHEN breach AND health = 'ok' THEN 'degraded' ELSE health END AS health FROM graded", _FEED)
def a10(t: Tables) -> DataFrame:
    return aggregates.feed_health(feed_rows(t), t.as_of).select("layer", "sla_breach", "health")


@query("a10_system_status", (), """
    SELECT *, CASE WHEN down > 0 AND ok = 0 THEN 'down' WHEN degraded > 0 OR down > 0 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT count(*) FILTER (WHERE health = 'ok' AND NOT breach) AS ok,
      count(*) FILTER (WHERE health = 'ok' AND breach) AS degraded, count(*) FILTER (WHERE health = 'down') AS down, count(*) FILTER (WHERE breach) AS breaches FROM graded)""", _FEED)
def a10b(t: Tables) -> DataFrame:
    return aggregates.system_status(aggregates.feed_health(feed_rows(t), t.as_of))


def _flagged(t: Tables) -> DataFrame:
    f = t.finding
    members = f.select("id", F.explode("entity_ids").alias("entity_id"))
    flagged = corrections.receiver_downtime(f).select("id", "reason")
    for rule in (corrections.stale_pings(f), corrections.repeated_calls(f), corrections.derived_proximity(f), corrections.aircraft_pairs(f),
                 corrections.test_leakage(f, "algo_1"), corrections.chained_clusters(f, members, t.current)):
        flagged = flagged.unionByName(rule)
    return flagged


_FLAGS = """act AS (SELECT *, date_trunc('minute', event_time - INTERVAL 3 HOUR) AS last_seen FROM finding WHERE NOT withdrawn),
  flag AS (
    SELECT a.id, 'receiver_downtime_artifact' AS reason FROM act a JOIN (SELECT last_seen FROM act WHERE event_type = 'dark_vessel_detected' GROUP BY 1 HAVING count(DISTINCT entity_id) >= 6) d
      ON d.last_seen = a.last_seen WHERE a.event_type = 'dark_vessel_detected'
    UNION ALL SELECT id, 'stale_pings_zero_bbox' FROM act WHERE event_type = 'loitering_detected' AND event_id % 4 = 0 AND event_id % 8 < 6 AND event_id % 3 > 1
    UNION ALL SELECT a.id, 'pre_fix_24h_cooldown_excess_refire' FROM act a WHERE event_type = 'port_call' AND EXISTS (SELECT 1 FROM act b WHERE b.event_type = 'port_call' AND b.entity_id = a.entity_id AND b.key = a.key
      AND b.event_time < a.event_time AND b.event_time >= a.event_time - INTERVAL 7 DAY)
    UNION ALL SELECT id, 'proximity_algo_derived_match_fanout' FROM act WHERE event_type = 'detected_proximity' AND event_subtype LIKE '%\\_port\\_call' ESCAPE '\\'
    UNION ALL SELECT id, 'airport_taxi_or_arrival_departure' FROM act WHERE event_type = 'rendezvous_detected' AND event_subtype = 'aircraft_vessel'
    UNION ALL SELECT id, 'test_fixture_leakage_into_production_db' FROM act WHERE event_type = 'sanctioned_port_arrival' AND algorithm = 'algo_1'
    UNION ALL SELECT m.id, 'dbscan_density_reachability_chain_bug' FROM (SELECT id, unnest(string_split(members, '|')) AS e FROM act WHERE event_type = 'shadow_fleet_cluster') m JOIN current c ON c.entity_id = m.e
      GROUP BY m.id HAVING max(c.lat) - min(c.lat) > 1 OR max(c.lng) - min(c.lng) > 1)"""


@query("a11_withdrawals", (*CUR, "finding"), "SELECT id, reason FROM flag", CURRENT + ", " + _FLAGS)
def a11(t: Tables) -> DataFrame:
    return _flagged(t)


@query("d23_withdrawal_rewrite", (*CUR, "finding"), """
    SELECT f.id, f.withdrawn OR g.reason IS NOT NULL AS withdrawn, g.reason AS withdrawal_reason, CASE WHEN g.reason IS NULL THEN NULL ELSE 'audit-1' END AS audit
    FROM finding f LEFT JOIN (SELECT id, min(reason) AS reason FROM flag GROUP BY 1) g ON g.id = f.id""", CURRENT + ", " + _FLAGS)
def d23(t: Tables) -> DataFrame:
    rows = corrections.withdraw(t.finding, _flagged(t), t.as_of, "audit-1")
    return rows.select("id", "withdrawn", "withdrawal_reason", F.get_json_object("properties", "$.withdrawal_audit").alias("audit"))


@query("a12_audit_counts", ("finding",), """
    SELECT event_type, algorithm, count(*) FILTER (WHERE NOT withdrawn) AS active, count(*) FILTER (WHERE withdrawn) AS withdrawn_rows FROM finding GROUP BY 1, 2""")
def a12(t: Tables) -> DataFrame:
    return aggregates.audit_counts(t.finding)


@query("a13_article_density", ("news",), """
    SELECT n.event_id, d.article_count, CASE WHEN article_count >= 500 THEN 9 WHEN article_count >= 200 THEN 8 WHEN article_count >= 100 THEN 7 WHEN article_count >= 50 THEN 6 WHEN article_count >= 20 THEN 5
      WHEN article_count >= 10 THEN 4 WHEN article_count >= 5 THEN 3 WHEN article_count >= 3 THEN 2 ELSE 1 END AS severity
    FROM news n JOIN (SELECT user_id, count(*) AS article_count FROM news GROUP BY 1 HAVING count(*) >= 3) d ON d.user_id = n.user_id""")
def a13(t: Tables) -> DataFrame:
    return aggregates.article_density(t.news.select("event_id", c("user_id").alias("country"))).select("event_id", "article_count", "severity")


@query("a14_prefilter_stats", ("news",), "SELECT reject_reason, count(*) AS n FROM judged GROUP BY 1", JUDGED_SQL)
def a14(t: Tables) -> DataFrame:
    return aggregates.prefilter_stats(judged(t)).select("reject_reason", "n")


@query("a14_shadow_matrix", ("news",), """
    SELECT CASE WHEN reject_reason IS NULL THEN 'pass' ELSE 'drop' END AS main, CASE WHEN shadow_reason IS NULL THEN 'pass' ELSE 'drop' END AS shadow, count(*) AS n FROM judged GROUP BY 1, 2""", JUDGED_SQL)
def a14b(t: Tables) -> DataFrame:
    return aggregates.shadow_matrix(judged(t))


@query("a15_situation_facts", ("finding",), f"""
    SELECT event_type, count(*) AS n, count(DISTINCT event_subtype) AS subtypes, max(severity) AS max_severity, max(event_id % 300)::DOUBLE AS longest_dark_h, max(event_id % 40)::DOUBLE AS longest_loiter_h,
      CAST(count(*) AS VARCHAR) || ' ' || replace(event_type, '_', ' ') || '; highest severity ' || printf('%.1f', max(severity)) || ': ' || arg_max(title, severity * 1e12 + epoch(event_time)) AS sentence
    FROM finding WHERE NOT withdrawn AND {SINCE(240)} GROUP BY event_type""")
def a15(t: Tables) -> DataFrame:
    found = aggregates.situation_facts(t.finding, t.as_of, 240)
    return found.select("event_type", "n", "subtypes", "max_severity", "longest_dark_h", "longest_loiter_h").join(aggregates.situation_sentence(found), "event_type")


@query("a16_digest_groups", ("finding",), """
    SELECT email, category_id, count(*) AS items, min(position) AS first_position, string_agg(id, ',' ORDER BY position) AS ids FROM dig GROUP BY 1, 2""", _DIGEST)
def a16(t: Tables) -> DataFrame:
    rows = aggregates.digest_groups(digest_rows(t))
    return rows.select("email", "category_id", "items", "first_position", F.array_join(F.transform("entries", lambda e: e["id"]), ",").alias("ids"))


@query("a17_baseline_fold", ("geo",), f"""
    SELECT layer, region, round(s.m, 6) AS mean_count, round(s.d, 6) AS std_count, CAST(len(ns) AS INT) AS n_cycles FROM (
      SELECT layer, region, ns, list_reduce(list_prepend({{'m': CAST(ns[1] AS DOUBLE), 'd': CAST(1.0 AS DOUBLE)}}, list_transform(ns, lambda x: {{'m': CAST(x AS DOUBLE), 'd': CAST(0 AS DOUBLE)}})),
        lambda a, x: {{'m': 0.75 * a.m + 0.25 * x.m, 'd': greatest(1.0, sqrt(0.75 * a.d * a.d + 0.25 * pow(x.m - (0.75 * a.m + 0.25 * x.m), 2)))}}) AS s
      FROM (SELECT layer, region, list(n ORDER BY day) AS ns FROM (SELECT layer, {region_sql()} AS region, CAST(event_time AS DATE) AS day, count(*) AS n FROM geo GROUP BY 1, 2, 3) GROUP BY 1, 2))""")
def a17(t: Tables) -> DataFrame:
    return aggregates.ewma_baselines(_daily(t)).select("layer", "region", r("mean_count").alias("mean_count"), r("std_count").alias("std_count"), "n_cycles")


@query("a18_database_summary", ("track", "finding"), f"""
    SELECT 'track' AS table_name, count(*) AS total, count(*) FILTER (WHERE time >= {MAX_TS} - INTERVAL 1 HOUR) AS last_hour, max(time) AS latest FROM track
    UNION ALL SELECT 'event', count(*), count(*) FILTER (WHERE {SINCE(1)}), max(event_time) FROM finding""")
def a18(t: Tables) -> DataFrame:
    return aggregates.table_summary("track", t.track, "time", t.as_of).unionByName(aggregates.table_summary("event", t.finding, "event_time", t.as_of))


# ------------------------------------------------------------------ windows and limits
@query("w1_latest_position", CUR, "SELECT entity_id, position_time, round(lat, 6) AS lat, velocity_ms FROM current", CURRENT)
def w1(t: Tables) -> DataFrame:
    return t.current.select("entity_id", "position_time", r("lat").alias("lat"), "velocity_ms")


@query("w2_latest_per_subtype", ("finding",), "SELECT event_subtype, arg_max(id, event_time) AS id FROM finding WHERE event_type = 'kev_disclosure' GROUP BY 1")
def w2(t: Tables) -> DataFrame:
    return serving.latest_per_subtype(t.finding, "kev_disclosure").select("event_subtype", "id")


@query("w3_latest_per_entity", ("finding",), "SELECT entity_id, arg_max(id, event_time) AS id FROM finding WHERE event_type = 'sanctioned_vessel_underway' GROUP BY 1")
def w3(t: Tables) -> DataFrame:
    return latest.latest_by(t.finding.filter(c("event_type") == "sanctioned_vessel_underway"), ["entity_id"], ["event_time", "id"], ["event_time", "id"]).select("entity_id", "id")


@query("w4_cohort_size", ("geo",), "SELECT event_id, count(*) OVER (PARTITION BY date_trunc('hour', event_time)) AS n FROM geo")
def w4(t: Tables) -> DataFrame:
    rows = t.geo.withColumn("h", F.date_trunc("hour", "event_time"))
    return rows.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h").select("event_id", "n")


@query("w5_recent_max", ("track",), f"SELECT entity_id, max(velocity_ms) AS recent_max FROM track WHERE time >= {MAX_TS} - INTERVAL 5 DAY GROUP BY 1")
def w5(t: Tables) -> DataFrame:
    return latest.recent_max(t.track, t.as_of - hours(120))


@query("w6_top_per_type", ("finding",), "SELECT event_type, id, rank FROM (SELECT event_type, id, row_number() OVER (PARTITION BY event_type ORDER BY event_time DESC, id) AS rank FROM finding WHERE NOT withdrawn) WHERE rank <= 8")
def w6(t: Tables) -> DataFrame:
    return latest.top_per_group(t.finding.filter(~c("withdrawn")), ["event_type"], [F.desc("event_time"), F.asc("id")], 8).select("event_type", "id", "rank")


@query("w7_global_top", ("geo",), "SELECT event_id, value FROM geo ORDER BY value DESC, event_id LIMIT 1000")
def w7(t: Tables) -> DataFrame:
    return latest.newest(t.geo, [F.desc("value"), F.asc("event_id")], 1000).select("event_id", "value")


@query("w8_bounded_queue", ("geo",), "SELECT event_id FROM geo ORDER BY severity DESC, event_id LIMIT 500")
def w8(t: Tables) -> DataFrame:
    return latest.bounded_queue(t.geo.select("event_id", c("severity").alias("priority"), c("event_id").alias("arrival"))).select("event_id")


_DIST = "1 - list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x))))"


@query("w9_vector_top", (), f"""
    SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_DIST} AS d FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM embeddings) WHERE vec_id <> 3) ORDER BY d, vec_id LIMIT 20""")
def w9(t: Tables) -> DataFrame:
    rows = t.raw("embeddings").withColumn("id", c("vec_id"))
    seed = rows.filter(c("vec_id") == 3).agg(F.min_by("embedding", "vec_id")).scalar()
    return serving.similar_vectors(rows, seed, 20, F.lit(3)).select("vec_id", r("distance").alias("distance"))


_SEARCH = f"""SELECT listed_id, CASE WHEN sim >= 0.4 THEN 'name_fuzzy' ELSE 'name_substring' END AS match_kind, round(sim, 6) AS similarity FROM (
    SELECT *, {jaccard_sql('g', 'q')} AS sim FROM (SELECT *, {trigrams_sql('listed_name')} AS g, {trigrams_sql("'red plate'")} AS q FROM listed)) WHERE sim >= 0.4 OR contains(lower(listed_name), 'red plate')
    ORDER BY sim DESC, listed_name, listed_id LIMIT 200"""


def vector_lists(t: Tables) -> str:
    return t.stored("vectors", lambda path: vectors.write_lists(t.raw("embeddings").select(c("vec_id").alias("id"), "embedding"), path, 16))


def _by_lists(t: Tables, probes: int | None) -> DataFrame:
    seed = t.raw("embeddings").filter(c("vec_id") == 3).agg(F.min_by("embedding", "vec_id")).first()[0]
    return vectors.from_lists(t.spark, vector_lists(t), list(seed), 20, probes, 3).select(c("id").alias("vec_id"), r("distance").alias("distance"))


@query("w9_vector_lists_exact", (), f"""
    SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_DIST} AS d FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM embeddings) WHERE vec_id <> 3) ORDER BY d, vec_id LIMIT 20""")
def w9_lists_exact(t: Tables) -> DataFrame:
    return _by_lists(t, None)


@query("w9_vector_lists")
def w9_lists(t: Tables) -> DataFrame:
    return _by_lists(t, 8)


@query("w10_search_ranking", ("listed",), _SEARCH)
def w10(t: Tables) -> DataFrame:
    return serving.search_listed(t.listed, "red plate", 200).select("listed_id", "match_kind", r("similarity").alias("similarity"))


def changes(t: Tables) -> DataFrame:
    """Reports with a coarse state that repeats: position by user, severity by day."""
    u, e = c("user_id"), c("event_id")
    return t.geo.select(
        c("entity_id").alias("id"), "event_time", e.alias("seq"), (u % 80).cast("double").alias("lat"), (u % 170).cast("double").alias("lng"),
        (F.dayofmonth("event_time") % 4).cast("int").alias("severity"), F.lit("state").alias("kind"), F.lit(None).cast("double").alias("altitude_m"),
    )


CHANGES_SQL = """SELECT entity_id AS id, event_id AS seq FROM (SELECT *, lag(s) OVER (PARTITION BY entity_id ORDER BY event_time, event_id) AS before FROM (SELECT *, day(event_time) % 4 AS s FROM geo)) WHERE s IS DISTINCT FROM before"""


@query("w11_changed_only", ("geo",), CHANGES_SQL)
def w11(t: Tables) -> DataFrame:
    return latest.changed_only(changes(t)).select("id", "seq")


# ------------------------------------------------------------------ merges
def _entity_state(rows: DataFrame, with_name) -> DataFrame:
    return rows.select(
        F.lit("vessel").alias("entity_type"), F.lit("mmsi").alias("canonical_id_type"), c("entity_id").alias("canonical_id"), with_name.alias("display_name"),
        F.map_from_arrays(F.array(F.lit("k"), F.concat(F.lit("p"), (c("ping_id") % 3).cast("string"))), F.array(c("ping_id").cast("string"), c("ping_id").cast("string"))).alias("properties"),
        c("time").alias("position_time"), "lat", "lng", "velocity_ms", "heading_deg", F.lit(0.0).alias("altitude_m"), c("ping_id"),
    )


_HALF = f"{MAX_TS} - INTERVAL 15 DAY"


@query("u1_guarded_upsert", ("track",), f"""
    SELECT x.entity_id AS canonical_id, coalesce(n.name, o.old_name) AS display_name, coalesce(b.k, o.k) AS k, greatest(b.seen, o.seen) AS last_seen, greatest(b.seen, o.seen) AS position_time,
      CASE WHEN o.seen IS NULL OR b.seen > o.seen THEN b.velocity_ms ELSE o.velocity_ms END AS velocity_ms
    FROM (SELECT DISTINCT entity_id FROM track) x
    LEFT JOIN (SELECT entity_id, max(time) AS seen, arg_max(velocity_ms, time) AS velocity_ms, CAST(arg_max(ping_id, time) AS VARCHAR) AS k, 'old' AS old_name FROM track WHERE time < {_HALF} AND user_id % 4 <> 0 GROUP BY 1) o ON o.entity_id = x.entity_id
    LEFT JOIN (SELECT entity_id, max(time) AS seen, arg_max(velocity_ms, time) AS velocity_ms, CAST(max(ping_id) AS VARCHAR) AS k FROM track WHERE time >= {_HALF} GROUP BY 1) b ON b.entity_id = x.entity_id
    LEFT JOIN (SELECT entity_id, 'name ' || CAST(max(ping_id) AS VARCHAR) AS name FROM track WHERE time >= {_HALF} AND ping_id % 2 = 0 GROUP BY 1) n ON n.entity_id = x.entity_id
    WHERE o.entity_id IS NOT NULL OR b.entity_id IS NOT NULL""")
def u1(t: Tables) -> DataFrame:
    half = t.as_of - hours(15 * 24)
    old = t.track.filter((c("time") < half) & (c("user_id") % 4 != 0))
    state = latest.latest_by(_entity_state(old, F.lit("old")), ["entity_type", "canonical_id_type", "canonical_id"], ["position_time", "ping_id"]).withColumn("last_seen", c("position_time"))
    named = F.when(c("ping_id") % 2 == 0, F.concat(F.lit("name "), c("ping_id").cast("string")))
    batch = _entity_state(t.track.filter(c("time") >= half), named).withColumn("arrival", c("ping_id"))
    merged = merge.upsert_entities(state, batch)
    return merged.select("canonical_id", "display_name", F.try_element_at("properties", F.lit("k")).alias("k"), "last_seen", "position_time", "velocity_ms")


@query("u2_union_first", ("finding",), """
    SELECT id FROM page UNION SELECT id FROM finding WHERE event_type = 'shadow_fleet_cluster'""",
    "page AS (SELECT id FROM finding ORDER BY event_time DESC, id LIMIT 500)")
def u2(t: Tables) -> DataFrame:
    page = latest.newest(t.finding, [F.desc("event_time"), F.asc("id")], 500).select("id")
    return merge.union_first(page, t.finding.filter(c("event_type") == "shadow_fleet_cluster").select("id"), "id")


@query("u3_first_feed_wins", ("geo",), """
    SELECT entity_id, feed_rank, count(*) AS n FROM (SELECT DISTINCT entity_id, min(CASE layer WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) OVER (PARTITION BY entity_id) AS feed_rank FROM geo WHERE layer IN ('error', 'view', 'click')) GROUP BY 1, 2""")
def u3(t: Tables) -> DataFrame:
    feeds = [t.geo.filter(c("layer") == x) for x in ("error", "view", "click")]
    return merge.first_feed_wins(feeds, "entity_id").groupBy("entity_id", "feed_rank").agg(F.count(F.lit(1)).alias("n"))


@query("u4_merge_methods", ("geo",), """
    SELECT coalesce(a.layer, f.layer) AS layer, coalesce(a.region, f.region) AS region, CASE WHEN a.layer IS NOT NULL AND f.layer IS NOT NULL THEN 'ewma+iso' WHEN a.layer IS NOT NULL THEN 'ewma' ELSE 'isolation_forest' END AS method,
      CASE WHEN a.layer IS NOT NULL AND f.layer IS NOT NULL THEN least(10, greatest(a.s, f.s) + 1) ELSE coalesce(a.s, f.s) END AS anomaly_severity
    FROM (SELECT *, 3 + n % 7 AS s FROM bk WHERE n % 3 <> 0) a FULL JOIN (SELECT *, 3 + n % 5 AS s FROM bk WHERE n % 2 = 0) f ON f.layer = a.layer AND f.region = a.region""",
    f"bk AS (SELECT layer, {region_sql()} AS region, CAST(count(*) AS INT) AS n FROM geo GROUP BY 1, 2)")
def u4(t: Tables) -> DataFrame:
    s = aggregates.bucket_stats(t.geo)
    n = c("count").cast("int")
    a = s.filter(n % 3 != 0).select("layer", "region", "count", F.lit(2.5).alias("z_score"), (n % 7 + 3).alias("anomaly_severity"), "max_severity")
    f = s.filter(n % 2 == 0).select("layer", "region", "count", F.lit(-0.1).alias("iso_score"), (n % 5 + 3).alias("anomaly_severity"), "max_severity")
    return anomaly.combine(a, f).select("layer", "region", "method", "anomaly_severity")


@query("u5_merge_topics", (), """
    SELECT id, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, max(severity) AS severity FROM (
      SELECT substr(md5(CASE WHEN event_id % 6 = 0 THEN 'C' || CAST(user_id % 20 AS VARCHAR) || '|' || event_type ELSE 'u' || CAST(event_id % 500 AS VARCHAR) END), 1, 14) AS id, event_type AS topic, CAST(floor(value) AS BIGINT) % 11 AS severity FROM events) GROUP BY 1""")
def u5(t: Tables) -> DataFrame:
    i = c("event_id")
    rows = t.raw("events").select(
        F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("u"), (i % 500).cast("string"))).alias("url"), F.concat(F.lit("C"), (c("user_id") % 20).cast("string")).alias("country"),
        c("event_type").alias("topic"), (F.floor("value") % 11).alias("severity"), F.lit("t").alias("title"), i.alias("seq"),
    )
    return merge.merge_topics(rows).select("id", F.array_join("topics", ",").alias("topics"), "severity")


# ------------------------------------------------------------------ sinks
@query("k1_insert_absent", ("finding",), "SELECT id FROM finding WHERE event_id % 3 <> 0")
def k1(t: Tables) -> DataFrame:
    return merge.insert_absent(t.finding.filter(c("event_id") % 3 == 0), t.finding.unionByName(t.finding.filter(c("event_id") % 5 == 0))).select("id")


@query("k2_insert_absent_by_id", ("finding",), f"SELECT id, event_time + INTERVAL 1 HOUR AS event_time FROM finding WHERE NOT (event_id % 3 = 0 AND event_time >= {MAX_TS} - INTERVAL 10 DAY)")
def k2(t: Tables) -> DataFrame:
    batch = t.finding.withColumn("event_time", c("event_time") + hours(1))
    return merge.insert_absent_by_id(t.finding.filter(c("event_id") % 3 == 0), batch, t.as_of, 10).select("id", "event_time")


_SNAP = f"""snap AS (SELECT f.*, cat.level, cat.category_id FROM finding f JOIN cat ON cat.event_type = f.event_type WHERE cat.level_rank >= 3 AND {SINCE(240)} ORDER BY event_time DESC, id LIMIT 500)"""


@query("k3_csv_snapshot", ("finding",), """
    SELECT id, strftime(event_time, '%Y-%m-%dT%H:%M:%S') || 'Z' AS event_time_utc, level AS severity, category_id AS category, event_type, title,
      CASE WHEN event_type = 'sanctioned_vessel_went_dark' THEN json_extract_string(properties, '$.hours_dark') END AS hours_dark, json_extract_string(properties, '$.sanctioning_authority') AS authority, '/entity/' || entity_id AS entity_url FROM snap""", CAT_SQL + ", " + _SNAP)
def k3(t: Tables) -> DataFrame:
    rows = sinks.snapshot(t.finding, t.as_of, 240)
    return rows.select(F.split_part("event_url", F.lit("/"), F.lit(5)).alias("id"), "event_time_utc", "severity", "category", "event_type", "title", "hours_dark", "authority", "entity_url")


@query("k4_feed_items", ("finding",), """
    SELECT id AS guid, event_type AS category, strftime(event_time, '%a, %d %b %Y %H:%M:%S GMT') AS "pubDate" FROM snap""", CAT_SQL + ", " + _SNAP)
def k4(t: Tables) -> DataFrame:
    return sinks.feed_items(t.finding, t.as_of, 240, limit=500).select("guid", "category", "pubDate")


@query("k5_geojson_features", ("finding",), """
    SELECT id, lng, lat, event_subtype, id AS prop_id FROM finding WHERE event_type = 'kev_disclosure' AND lat IS NOT NULL""")
def k5(t: Tables) -> DataFrame:
    rows = sinks.geojson_features(t.finding, "kev_disclosure", limit=1_000_000)
    g = lambda p: F.get_json_object("feature", p)
    return rows.select(
        "id", g("$.geometry.coordinates[0]").cast("double").alias("lng"), g("$.geometry.coordinates[1]").cast("double").alias("lat"),
        g("$.properties._event_subtype").alias("event_subtype"), g("$.properties._event_id").alias("prop_id"),
    )


@query("k6_retention", ("track",), f"SELECT ping_id FROM track WHERE time >= {MAX_TS} - INTERVAL 12 DAY")
def k6(t: Tables) -> DataFrame:
    return sinks.retained(t.track, "time", t.as_of, 12).select("ping_id")


def _gate(t: Tables) -> DataFrame:
    i = c("s_suppkey")
    feeds = t.raw("supplier").select(c("s_name").alias("feed"), F.when(i % 10 == 3, F.array().cast("array<string>")).otherwise(F.array(i.cast("string"), (i + 1).cast("string"))).alias("source_ids"))
    n = c("p_partkey")
    registry = t.raw("part").filter(n % 7 != 0).select(n.cast("string").alias("source_id"), (n % 5 != 0).alias("enabled"), (n % 3 != 0).alias("commercial_use_ok"))
    return licence.gate(feeds, registry)


@query("k7_licence_gate", (), """
    SELECT s_name AS feed, CASE WHEN s_suppkey % 10 = 3 THEN 'no_source_id' ELSE coalesce(
      CASE WHEN s_suppkey % 7 = 0 THEN 'not_registered' WHEN s_suppkey % 5 = 0 THEN 'disabled' WHEN s_suppkey % 3 = 0 THEN 'not_commercial' END,
      CASE WHEN (s_suppkey + 1) % 7 = 0 THEN 'not_registered' WHEN (s_suppkey + 1) % 5 = 0 THEN 'disabled' WHEN (s_suppkey + 1) % 3 = 0 THEN 'not_commercial' END) END AS reason FROM supplier""")
def k7(t: Tables) -> DataFrame:
    return _gate(t).select("feed", "reason")


# ------------------------------------------------------------------ serving
BOX = (-30.0, 0.0, 100.0, 60.0)
_BOX = "lat BETWEEN 0 AND 60 AND lng BETWEEN -30 AND 100"


@query("q1_viewport_entities", CUR, f"""
    SELECT entity_id, position_time FROM current WHERE entity_type IN ('vessel', 'aircraft') AND position_time BETWEEN {MAX_TS} - INTERVAL 240 HOUR AND {MAX_TS} AND {_BOX} ORDER BY position_time DESC, entity_id LIMIT 1000""", CURRENT)
def q1(t: Tables) -> DataFrame:
    return serving.viewport_entities(t.current, BOX, t.as_of - hours(240), t.as_of, ["vessel", "aircraft"]).select("entity_id", "position_time")


_RARE = ", ".join(f"'{x}'" for x in R.RARE_TIER1_TYPES)
_VIEWPORT = f"""v AS (SELECT * FROM finding WHERE {SINCE(240)} AND NOT withdrawn AND {_BOX})"""


@query("q1_viewport_events", ("finding",), f"""
    SELECT id, event_type FROM v WHERE id IN (SELECT id FROM v ORDER BY event_time DESC, id LIMIT 100) OR id IN (SELECT id FROM v WHERE event_type = 'sanctioned_vessel_underway' ORDER BY event_time DESC, id LIMIT 1000)
      OR id IN (SELECT id FROM v WHERE event_type IN ({_RARE}) ORDER BY event_time DESC, id LIMIT 500)""", _VIEWPORT)
def q1b(t: Tables) -> DataFrame:
    return serving.viewport_events(t.finding, BOX, t.as_of - hours(240), t.as_of, limit=100).select("id", "event_type")


def by_place(t: Tables) -> DataFrame:
    """Findings as a table laid out by day and place."""
    return t.spark.read.parquet(t.stored("finding-by-place", lambda path: sinks.write_by_place(t.finding, path)))


@query("q1_viewport_events_by_place", ("finding",), f"""
    SELECT id, event_type FROM v WHERE id IN (SELECT id FROM v ORDER BY event_time DESC, id LIMIT 100) OR id IN (SELECT id FROM v WHERE event_type = 'sanctioned_vessel_underway' ORDER BY event_time DESC, id LIMIT 1000)
      OR id IN (SELECT id FROM v WHERE event_type IN ({_RARE}) ORDER BY event_time DESC, id LIMIT 500)""", _VIEWPORT)
def q1c(t: Tables) -> DataFrame:
    return serving.viewport_events(by_place(t), BOX, t.as_of - hours(240), t.as_of, limit=100).select("id", "event_type")


@query("q2_entity_track", ("track",), f"SELECT ping_id, time FROM track WHERE entity_id = '7' AND time >= {MAX_TS} - INTERVAL 480 HOUR ORDER BY time DESC, ping_id DESC LIMIT 5000")
def q2(t: Tables) -> DataFrame:
    return serving.entity_track(t.track, "7", t.as_of, 480).select("ping_id", "time")


@query("q2_entity_events", (*CUR, "finding"), f"""
    SELECT id, round(distance_m, 2) AS distance_m FROM {geodesic_sql("(SELECT f.id, f.event_time, f.lat AS f_lat, f.lng AS f_lng, c.lat, c.lng FROM finding f, current c WHERE c.entity_id = '7' AND " + SINCE(480) + ")", 'lat', 'lng', 'f_lat', 'f_lng')}
    WHERE distance_m <= 2000000 ORDER BY event_time DESC, id LIMIT 100""", CURRENT)
def q2b(t: Tables) -> DataFrame:
    return serving.entity_events(t.current, t.finding, "7", t.as_of, 2_000_000, 480).select("id", r("distance_m", 2).alias("distance_m"))


@query("q3_cross_domain_partners", ("finding", "entity"), f"""
    SELECT f.id, string_agg(coalesce(e.display_name, '-') || '/' || f.m, ',' ORDER BY e.display_name NULLS LAST, f.m) AS partners FROM (SELECT id, unnest(string_split(members, '|')) AS m FROM (
      SELECT * FROM finding WHERE list_contains(string_split(members, '|'), '11') AND {SINCE(720)} ORDER BY event_time DESC, id LIMIT 100)) f LEFT JOIN entity e ON e.entity_id = f.m WHERE f.m <> '11' GROUP BY 1""")
def q3(t: Tables) -> DataFrame:
    rows = serving.partners(t.finding, t.entity, "11", t.as_of, 720)
    text = F.array_join(F.transform("partners", lambda p: F.concat_ws("/", F.coalesce(p["display_name"], F.lit("-")), p["member_id"])), ",")
    return rows.filter(c("partners").isNotNull()).select("id", text.alias("partners"))


def membership(t: Tables) -> DataFrame:
    """The table of members that the partner queries read."""
    name = "membership_" + hashlib.md5(f"{t.spark.sparkContext.applicationId} {t.folder}".encode()).hexdigest()
    t.stored("membership", lambda path: sinks.write_membership(t.finding, name, path))
    return t.spark.table(name)


@query("q3_partner_index", ("finding", "entity"), f"""
    SELECT f.id, string_agg(coalesce(e.display_name, '-') || '/' || f.m, ',' ORDER BY e.display_name NULLS LAST, f.m) AS partners FROM (SELECT id, unnest(string_split(members, '|')) AS m FROM (
      SELECT * FROM finding WHERE list_contains(string_split(members, '|'), '11') AND {SINCE(720)} ORDER BY event_time DESC, id LIMIT 100)) f LEFT JOIN entity e ON e.entity_id = f.m WHERE f.m <> '11' GROUP BY 1""")
def q3b(t: Tables) -> DataFrame:
    rows = serving.partners_of(membership(t), t.entity, "11", t.as_of, 720)
    text = F.array_join(F.transform("partners", lambda p: F.concat_ws("/", F.coalesce(p["display_name"], F.lit("-")), p["member_id"])), ",")
    return rows.filter(c("partners").isNotNull()).select("id", text.alias("partners"))


@query("q4_similar_events", (), f"""
    SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_DIST} AS d FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 5) AS b FROM embeddings)
      WHERE vec_id <> 5 AND vec_id % 2 = 0 AND vec_id % 31 <= 20) ORDER BY d, vec_id LIMIT 10""")
def q4(t: Tables) -> DataFrame:
    i = c("vec_id")
    rows = t.raw("embeddings").select(
        i.alias("id"), "embedding", F.when(i % 2 == 0, "newsdata").otherwise("metar").alias("event_type"), (t.as_of - F.make_dt_interval(days=(i % 31).cast("int"))).alias("event_time")
    )
    seed = rows.filter(c("id") == 5).agg(F.min_by("embedding", "id")).scalar()
    return serving.similar_events(rows, seed, t.as_of, 20, F.lit(5)).select(c("id").alias("vec_id"), r("distance").alias("distance"))


@query("q5_signals_today", ("finding",), f"""
    SELECT id, event_type, rank, category_count FROM (SELECT f.id, f.event_type, row_number() OVER (PARTITION BY f.event_type ORDER BY event_time DESC, f.id) AS rank, count(*) OVER (PARTITION BY f.event_type) AS category_count
      FROM finding f JOIN cat ON cat.event_type = f.event_type WHERE NOT withdrawn AND {SINCE(240)}) WHERE rank <= 10""", CAT_SQL)
def q5(t: Tables) -> DataFrame:
    return serving.signals_today(t.finding, R.categories_df(t.spark), t.as_of, 240).select("id", "event_type", "rank", "category_count")


@query("q6_alert_series", ("finding",), f"SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM finding WHERE event_type IN ('port_arrival', 'loitering_detected') AND {SINCE(168)} GROUP BY 1")
def q6(t: Tables) -> DataFrame:
    rows = aggregates.dense_series(t.finding, ["port_arrival", "loitering_detected"], t.as_of - hours(168), 168, 60)
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("q7_sanctions_search", ("listed",), _SEARCH.replace("red plate", "blue ring").replace("LIMIT 200", "LIMIT 50"))
def q7(t: Tables) -> DataFrame:
    return serving.search_listed(t.listed, "blue ring").select("listed_id", "match_kind", r("similarity").alias("similarity"))


@query("q7_listed_by_regime", ("listed",), "SELECT listed_id FROM listed WHERE upper(regime) = 'IRAN' ORDER BY id_type, listed_name, listed_id LIMIT 200")
def q7b(t: Tables) -> DataFrame:
    return serving.listed_by_regime(t.listed, "iran").select("listed_id")


@query("q8_recent_alerts", ("finding",), f"SELECT id FROM finding WHERE event_type IN ({_RARE}) AND {SINCE(240)} ORDER BY event_time DESC, id LIMIT 200")
def q8(t: Tables) -> DataFrame:
    return serving.recent_alerts(t.finding, list(R.RARE_TIER1_TYPES), t.as_of, 240).select("id")


@query("q8_top_anomalies", ("geo",), f"SELECT layer, region, CAST(n AS INT) AS anomaly_severity FROM (SELECT layer, {region_sql()} AS region, count(*) AS n FROM geo GROUP BY 1, 2) ORDER BY n DESC, layer, region LIMIT 20")
def q8b(t: Tables) -> DataFrame:
    rows = aggregates.bucket_stats(t.geo).select("layer", "region", c("count").cast("int").alias("anomaly_severity"))
    return serving.top_anomalies(rows, 20)


@query("q9_latest_layer", ("finding",), "SELECT event_subtype, arg_max(id, event_time) AS id FROM finding WHERE event_type = 'newsdata' GROUP BY 1")
def q9(t: Tables) -> DataFrame:
    rows = sinks.geojson_features(t.finding.withColumn("lat", F.coalesce("lat", F.lit(0.0))).withColumn("lng", F.coalesce("lng", F.lit(0.0))), "newsdata", per_subtype=True)
    return rows.select(F.get_json_object("feature", "$.properties._event_subtype").alias("event_subtype"), "id")


@query("q10_findings_by_algorithm", ("finding",), f"SELECT id FROM finding WHERE algorithm = 'algo_2' AND {SINCE(240)} ORDER BY event_time DESC, id LIMIT 100")
def q10(t: Tables) -> DataFrame:
    return serving.findings_by_algorithm(t.finding, "algo_2", t.as_of, 240).select("id")


@query("q10_events_in_box", ("finding",), f"SELECT id FROM finding WHERE {SINCE(240)} AND NOT withdrawn AND {_BOX} ORDER BY event_time DESC, id LIMIT 500")
def q10b(t: Tables) -> DataFrame:
    return serving.events_in_box(t.finding, BOX, t.as_of - hours(240), t.as_of).select("id")


@query("q10_event_by_id", ("finding",), "SELECT id, title FROM finding WHERE id = 'F77'")
def q10c(t: Tables) -> DataFrame:
    return serving.event_by_id(t.finding, "F77").select("id", "title")


@query("q11_layer_top", ("geo",), """
    SELECT layer, event_id, rank FROM (SELECT layer, event_id, row_number() OVER (PARTITION BY layer ORDER BY severity DESC, event_time DESC, event_id) AS rank FROM geo
      WHERE layer IN ('click', 'view') AND lat BETWEEN -40 AND 40 AND (lng >= 140 OR lng <= -120)) WHERE rank <= 200""")
def q11(t: Tables) -> DataFrame:
    return serving.layer_top(t.geo, ["click", "view"], (140.0, -40.0, -120.0, 40.0)).select("layer", "event_id", "rank")


@query("q11_news_pins", ("geo",), "SELECT event_id FROM geo ORDER BY severity DESC, event_time DESC, event_id LIMIT 200")
def q11b(t: Tables) -> DataFrame:
    return serving.news_pins(t.geo).select("event_id")


@query("q12_dashboard_summary", ("finding",), f"""
    SELECT count(*) FILTER (WHERE level IS NOT NULL) AS signals, count(*) FILTER (WHERE level = 'critical') AS critical FROM finding LEFT JOIN cat ON cat.event_type = finding.event_type WHERE {SINCE(24)}""", CAT_SQL)
def q12(t: Tables) -> DataFrame:
    return aggregates.dashboard(t.finding, signups(t), R.categories_df(t.spark), t.as_of, 24).select("signals", "critical")


# ------------------------------------------------------------------ batch twins of streams
_NEWS_TEXT = "concat_ws(' ', nullif(title, ''), nullif(actor1_name, ''), nullif(actor2_name, ''), nullif(subcategory, ''))"
#: The greedy walk itself, row by row in each subcategory; the list holds what one window accepted.
T5_SQL = f"""RECURSIVE toks AS (SELECT *, epoch_us(timestamp) / 1e6 AS sec, list_sort(list_distinct(list_filter(string_split_regex(lower({_NEWS_TEXT}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))) AS w FROM news),
    spots AS (SELECT subcategory, w, sec, lat, lng, min(event_id) AS leader FROM toks GROUP BY ALL),
    line AS (SELECT *, row_number() OVER (PARTITION BY subcategory ORDER BY sec, leader) AS k FROM spots),
    walk AS (
      SELECT subcategory, k, leader, CAST(NULL AS VARCHAR) AS duplicate_of, CAST(NULL AS DOUBLE) AS similarity, [{{'sec': sec, 'id': leader, 'w': w, 'lat': lat, 'lng': lng}}] AS held FROM line WHERE k = 1
      UNION ALL
      SELECT subcategory, k, leader, hit.id, {jaccard_sql("w", "hit.w")},
        CASE WHEN hit IS NULL THEN list_append(live, {{'sec': sec, 'id': leader, 'w': w, 'lat': lat, 'lng': lng}}) ELSE live END
      FROM (SELECT *, list_filter(live, lambda h: {jaccard_sql("w", "h.w")} >= 0.85 AND coalesce({haversine_sql("lat", "lng", "h.lat", "h.lng")} <= 50, true))[-1] AS hit
        FROM (SELECT l.*, list_filter(p.held, lambda h: h.sec >= l.sec - 86400) AS live FROM line l JOIN walk p ON p.subcategory = l.subcategory AND p.k + 1 = l.k)))"""
T5_ROWS = """
    SELECT event_id, CASE WHEN event_id = leader THEN duplicate_of ELSE coalesce(duplicate_of, leader) END AS duplicate_of,
      round(CASE WHEN event_id = leader THEN similarity ELSE coalesce(similarity, 1.0) END, 6) AS similarity
    FROM toks JOIN spots USING (subcategory, w, sec, lat, lng) JOIN walk USING (subcategory, leader)"""


@query("t5_near_duplicates", ("news",), T5_ROWS, T5_SQL)
def t5(t: Tables) -> DataFrame:
    return dedup.near_duplicates(t.news, window_minutes=24 * 60).withColumn("similarity", F.round("similarity", 6))


@query("t9_tumbling_windows", ("finding",), "SELECT time_bucket(INTERVAL 6 HOUR, event_time) AS start, event_type, count(*) AS n FROM finding GROUP BY 1, 2")
def t9(t: Tables) -> DataFrame:
    from tidemark.streaming.flows import tumbling_counts

    return tumbling_counts(t.finding, "6 hours").select(c("window.start").alias("start"), "event_type", "n")


@query("t9_sliding_windows", ("finding",), """
    SELECT time_bucket(INTERVAL 6 HOUR, event_time) - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, max(severity) AS max_severity FROM finding, range(0, 4) AS s(k) GROUP BY 1, 2""")
def t9b(t: Tables) -> DataFrame:
    from tidemark.streaming.flows import sliding_counts

    return sliding_counts(t.finding, "24 hours", "6 hours").select(c("window.start").alias("start"), "event_type", "n", "max_severity")


@query("t9_track_segments", ("track",), """
    SELECT entity_id, count(*) AS pings, min(time) AS start FROM (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY time) AS seg FROM (
      SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY entity_id ORDER BY time) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM track)) GROUP BY entity_id, seg""")
def t9c(t: Tables) -> DataFrame:
    from tidemark.streaming.flows import track_segments

    return track_segments(t.track).select("entity_id", "pings", c("session_window.start").alias("start"))

