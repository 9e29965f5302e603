"""Queries for joins (J) and detectors (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import region_for
from tidemark.operators import aggregates, anomaly, correlate, forecast, merge, names, resolution, serving, spatial, watch
from tidemark.operators.detectors import clusters, encounters, listed, movement, ports
from tidemark.operators.detectors.base import hours, metres, not_found_before
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import FLAG_SQL, IDENTITY_DIGITS, _ring_sql, region_sql
from tidemark.plans.views import CURRENT, Tables, geodesic_sql, haversine_sql, jaccard_sql, trigrams_sql
from tidemark.sources import refdata as R

c = F.col
CUR = ("entity", "track")
MAX_TS = "(SELECT max(ts) FROM events)"
FRESH_MIN = 14 * 24 * 60  # the test entities report about twice a day


def r(x, places=3):
    return F.round(x, places)


# ------------------------------------------------------------------ joins
_PAIRS = geodesic_sql(
    "(SELECT a.entity_id AS a_id, b.entity_id AS b_id, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng, a.entity_type AS a_type, b.entity_type AS b_type "
    "FROM current a, current b WHERE a.entity_id <> b.entity_id)", "a_lat", "a_lng", "b_lat", "b_lng")


@query("j1_radius_self_join", CUR, f"SELECT a_id, b_id, round(distance_m, 3) AS distance_m FROM {_PAIRS} WHERE a_id < b_id AND distance_m <= 50000", CURRENT)
def j1(t: Tables) -> DataFrame:
    rows = t.current.select("entity_id", "lat", "lng")
    return spatial.self_pairs(rows, "entity_id", 50_000).select(c("a_entity_id").alias("a_id"), c("b_entity_id").alias("b_id"), r("distance_m").alias("distance_m"))


@query("j2_cross_type_join", CUR, f"""
    SELECT a_id, b_id FROM {_PAIRS} WHERE a_type < b_type AND a_type <> 'satellite' AND b_type <> 'satellite' AND distance_m <= 5000""", CURRENT)
def j2(t: Tables) -> DataFrame:
    rows = t.current.filter(c("entity_type") != "satellite").select("entity_id", "entity_type", "lat", "lng")
    return spatial.radius_join(
        spatial.prefixed(rows, "a_"), spatial.prefixed(rows, "b_"), 5000, ("a_lat", "a_lng"), ("b_lat", "b_lng"), condition=c("a_entity_type") < c("b_entity_type")
    ).select(c("a_entity_id").alias("a_id"), c("b_entity_id").alias("b_id"))


_EVENT_PAIRS = geodesic_sql(
    "(SELECT c.entity_id, f.id, c.lat AS a_lat, c.lng AS a_lng, f.lat AS b_lat, f.lng AS b_lng FROM current c, finding f "
    f"WHERE f.lat IS NOT NULL AND f.event_time >= {MAX_TS} - to_minutes(CAST(coalesce(f.decay_half_life_min, 60) * 10 AS BIGINT)))", "a_lat", "a_lng", "b_lat", "b_lng")


@query("j3_entity_event_join", (*CUR, "finding"), f"SELECT entity_id, id, round(distance_m, 2) AS distance_m FROM {_EVENT_PAIRS} WHERE distance_m <= 200000", CURRENT)
def j3(t: Tables) -> DataFrame:
    life = F.make_dt_interval(mins=F.coalesce("decay_half_life_min", F.lit(60)) * 10)
    live = t.finding.filter(c("event_time") >= t.as_of - life).select("id", c("lat").alias("e_lat"), c("lng").alias("e_lng"))
    rows = t.current.select("entity_id", "lat", "lng")
    return spatial.radius_join(rows, live, 200_000, ("lat", "lng"), ("e_lat", "e_lng")).select("entity_id", "id", r("distance_m", 2).alias("distance_m"))


_PORT_PAIRS = geodesic_sql("(SELECT c.*, p.* FROM current c, ports p)", "lat", "lng", "port_lat", "port_lng")


@query("j4_port_radius_join", CUR, f"SELECT entity_id, port_id, round(distance_m, 3) AS distance_m FROM {_PORT_PAIRS} WHERE distance_m <= 5000", CURRENT)
def j4(t: Tables) -> DataFrame:
    return spatial.within_of_places(t.current, t.ports, 5000).select("entity_id", "port_id", r("distance_m").alias("distance_m"))


_ZONE_ROWS = " UNION ALL ".join(
    f"SELECT *, '{name}' AS zone, {severity} AS zone_severity FROM current WHERE {_ring_sql(points)}" for name, severity, _, points in R.ZONES
)


@query("j5_point_in_zone_join", CUR, f"SELECT entity_id, zone FROM ({_ZONE_ROWS})", CURRENT)
def j5(t: Tables) -> DataFrame:
    return spatial.within_zones(t.current, R.zones_df(t.spark)).select("entity_id", "zone")


# Exact-else-fuzzy matches of all vessels, as the naive comparison of every pair.
MATCH_SQL = f"""live AS (SELECT entity_id, canonical_id, display_name, imo, {trigrams_sql('upper(display_name)')} AS g FROM entity WHERE entity_type = 'vessel'),
  lst AS (SELECT *, {trigrams_sql('upper(listed_name)')} AS g FROM listed),
  imo_hits AS (SELECT l.entity_id, s.listed_id, 'imo' AS match_kind, CAST(NULL AS DOUBLE) AS similarity FROM live l JOIN lst s ON l.imo = s.listed_imo),
  name_hits AS (SELECT l.entity_id, s.listed_id, 'name' AS match_kind, {jaccard_sql('l.g', 's.g')} AS similarity FROM live l JOIN lst s ON (l.imo IS NULL OR s.listed_imo IS NULL)
    AND length(l.display_name) >= 4 AND length(s.listed_name) >= 4 AND len(l.g) <= len(s.g) / 0.8 AND len(s.g) <= len(l.g) / 0.8),
  hits AS (SELECT * FROM imo_hits UNION ALL SELECT * FROM name_hits WHERE similarity >= 0.9)"""


@query("j6_exact_else_fuzzy_join", ("entity", "listed"), "SELECT entity_id, listed_id, match_kind, round(similarity, 6) AS similarity FROM hits", MATCH_SQL)
def j6(t: Tables) -> DataFrame:
    vessels = t.entity.filter(c("entity_type") == "vessel").select("entity_id", "display_name", "imo")
    return names.match_listed(vessels, t.listed).select("entity_id", "listed_id", "match_kind", r("similarity", 6).alias("similarity"))


@query("j6_similar_names", ("entity", "listed"), f"""
    SELECT a.name AS left_name, b.name AS right_name, round({jaccard_sql('a.g', 'b.g')}, 6) AS similarity
    FROM (SELECT name, {trigrams_sql('name')} AS g FROM (SELECT DISTINCT upper(display_name) AS name FROM entity WHERE display_name IS NOT NULL)) a,
         (SELECT name, {trigrams_sql('name')} AS g FROM (SELECT DISTINCT upper(listed_name) AS name FROM listed)) b WHERE {jaccard_sql('a.g', 'b.g')} >= 0.75""")
def j6b(t: Tables) -> DataFrame:
    a = t.entity.filter(c("display_name").isNotNull()).select(F.upper("display_name").alias("name"))
    b = t.listed.select(F.upper("listed_name").alias("name"))
    return names.similar_names(a, b, 0.75).withColumn("similarity", r("similarity", 6))


@query("j7_code_lookup", ("news",), """
    SELECT event_id, CASE code WHEN '190' THEN '190' WHEN '191' THEN '19' WHEN '193' THEN '193' ELSE '19' END AS matched_code,
      CASE code WHEN '190' THEN 'strike' WHEN '193' THEN 'shelling' ELSE 'fight' END AS label FROM news""")
def j7(t: Tables) -> DataFrame:
    codes = t.spark.createDataFrame([("19", "fight"), ("190", "strike"), ("193", "shelling"), ("999", "unknown")], "code string, label string")
    return merge.code_lookup(t.news.select("event_id", "code"), codes).select("event_id", "matched_code", "label")


@query("j8_fill_missing_join", ("entity", "track"), """
    SELECT t.ping_id, CASE WHEN t.ping_id % 3 = 0 THEN 'OWN NAME' ELSE e.display_name END AS name, e.imo
    FROM track t LEFT JOIN entity e ON e.entity_id = t.entity_id AND e.user_id % 2 = 0""")
def j8(t: Tables) -> DataFrame:
    p = t.track.select("ping_id", "entity_id", F.when(c("ping_id") % 3 == 0, "OWN NAME").when(c("ping_id") % 3 == 1, " ").alias("name"), F.lit(None).cast("string").alias("imo"))
    static = t.entity.filter(c("user_id") % 2 == 0).select("entity_id", c("display_name").alias("name"), "imo")
    return merge.fill_missing(p, static, "entity_id", ["name", "imo"]).select("ping_id", "name", "imo")


def attributes(t: Tables) -> DataFrame:
    """Attribute history per user: every event starts a value that holds for five days, or for ever."""
    i = c("event_id")
    return t.geo.select(
        "entity_id", F.concat(F.lit("a"), (i % 2).cast("string")).alias("attribute_name"), c("layer").alias("attribute_value"), c("event_time").alias("valid_from"),
        F.when(i % 3 != 0, c("event_time") + F.make_dt_interval(days=F.lit(5))).alias("valid_to"), i.alias("attribute_id"),
    )


ATTR_SQL = """attr AS (SELECT entity_id, 'a' || CAST(event_id % 2 AS VARCHAR) AS attribute_name, layer AS attribute_value, event_time AS valid_from,
    CASE WHEN event_id % 3 <> 0 THEN event_time + INTERVAL 5 DAY END AS valid_to, event_id AS attribute_id FROM geo)"""


@query("j9_valid_at_join", ("geo",), """
    SELECT event_id, attribute_name, attribute_value FROM (SELECT g.event_id, a.attribute_name, a.attribute_value,
      row_number() OVER (PARTITION BY g.event_id, a.attribute_name ORDER BY a.valid_from DESC, a.attribute_id DESC) AS rn
      FROM geo g JOIN attr a ON a.entity_id = g.entity_id AND a.valid_from <= g.event_time AND (a.valid_to IS NULL OR a.valid_to > g.event_time)) WHERE rn = 1""", ATTR_SQL)
def j9(t: Tables) -> DataFrame:
    return merge.valid_at_events(t.geo, attributes(t)).select("event_id", "attribute_name", "attribute_value")


def watchlists(t: Tables) -> DataFrame:
    """Watch lists derived from suppliers."""
    i = c("s_suppkey")
    return t.raw("supplier").select(
        i.cast("string").alias("watch_id"), F.when(i % 3 == 0, F.array(F.lit("click"), F.lit("error"))).otherwise(F.array().cast("array<string>")).alias("layers"),
        (i % 130 - 65).cast("double").alias("center_lat"), (i * 7 % 360 - 180).cast("double").alias("center_lng"), (i % 5 * 300 + 200).cast("double").alias("radius_km"),
        (i % 8).cast("int").alias("min_severity"), (i % 10 != 9).alias("enabled"),
    )


_WATCH = f"""hit AS (SELECT s.s_suppkey AS watch_id, g.event_id, g.layer || ':' || CAST(g.event_id AS VARCHAR) AS match_id, g.event_time,
    {haversine_sql('CAST(s.s_suppkey % 130 - 65 AS DOUBLE)', 'CAST(s.s_suppkey * 7 % 360 - 180 AS DOUBLE)', 'g.lat', 'g.lng')} AS km, s.s_suppkey % 5 * 300 + 200 AS radius
    FROM supplier s, geo g WHERE s.s_suppkey % 10 <> 9 AND (s.s_suppkey % 3 <> 0 OR g.layer IN ('click', 'error')) AND g.severity >= s.s_suppkey % 8)"""


@query("j10_watchlist_join", ("geo",), """
    SELECT CAST(watch_id AS VARCHAR) AS watch_id, match_id, round_even(km, 1) AS distance_km FROM (
      SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY event_time, match_id) AS rn FROM hit WHERE km <= radius AND event_id % 4 <> 0) WHERE rn <= 5""", _WATCH)
def j10(t: Tables) -> DataFrame:
    events = watch.watch_sources(t.geo)
    dealt_with = events.filter(F.split("match_id", ":")[1].cast("bigint") % 4 == 0)
    fired = dealt_with.select(F.lit(None).cast("string").alias("watch_id"), "match_id")
    return watch.watch_alerts(events, watchlists(t), fired).select("watch_id", "match_id", "distance_km")


def subscribers(t: Tables) -> DataFrame:
    i = c("c_custkey")
    return t.raw("customer").select(
        c("c_name").alias("email"), F.when(i % 4 == 0, "low").when(i % 4 == 1, "medium").when(i % 4 == 2, "critical").alias("severity_floor"),
        F.when(i % 5 == 0, F.array(F.lit("quakes"), F.lit("shadow_fleet"))).otherwise(F.array().cast("array<string>")).alias("category_ids"),
        (i % 3 != 0).alias("verified"), F.when(i % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("unsubscribed_at"),
    )


CAT_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{cid}', '{et}', '{lv}', {R.LEVEL_RANK[lv]})" for i, (cid, et, lv) in enumerate(R.CATEGORIES)
) + ") AS v(category_rank, category_id, event_type, level, level_rank))"
_DIGEST = CAT_SQL + """, item AS (SELECT * FROM (SELECT f.id, f.event_time, cat.category_id, cat.level_rank, row_number() OVER (PARTITION BY cat.category_id ORDER BY f.event_time DESC, f.id) AS rn
    FROM finding f JOIN cat ON cat.event_type = f.event_type WHERE NOT f.withdrawn) WHERE rn <= 3),
  dig AS (SELECT * FROM (SELECT c.c_name AS email, i.category_id, i.id, i.event_time, row_number() OVER (PARTITION BY c.c_custkey ORDER BY i.level_rank DESC, i.event_time DESC, i.id) AS position
    FROM customer c JOIN item i ON c.c_custkey % 3 <> 0 AND c.c_custkey % 7 <> 0 AND i.level_rank >= CASE c.c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END
    AND (c.c_custkey % 5 <> 0 OR i.category_id IN ('quakes', 'shadow_fleet'))) WHERE position <= 25)"""


def digest_rows(t: Tables) -> DataFrame:
    return watch.digest(watch.digest_items(t.finding, R.categories_df(t.spark)), subscribers(t))


@query("j11_digest_join", ("finding",), "SELECT email, category_id, id, position FROM dig", _DIGEST)
def j11(t: Tables) -> DataFrame:
    return digest_rows(t).select("email", "category_id", "id", "position")


_SAMPLES = geodesic_sql(
    "(SELECT a.entity_id AS a_id, b.entity_id AS b_id, a.time AS ta, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng FROM track a JOIN track b ON a.entity_id < b.entity_id "
    "AND abs(epoch_us(a.time) - epoch_us(b.time)) <= 14400000000)", "a_lat", "a_lng", "b_lat", "b_lng")


@query("j12_sustained_pairs", CUR, f"""
    SELECT a_id, b_id, count(*) AS samples, round((epoch_us(max(ta)) - epoch_us(min(ta))) / 6e7, 3) AS span_minutes FROM {_SAMPLES} WHERE distance_m <= 2000
    GROUP BY 1, 2 HAVING count(*) >= 2 AND epoch_us(max(ta)) - epoch_us(min(ta)) >= 1200000000""")
def j12(t: Tables) -> DataFrame:
    kept = encounters.sustained_pairs(t.track, F.lit("1970-01-01").cast("timestamp"), 2000, tolerance_s=14_400)
    return kept.select(c("a_entity_id").alias("a_id"), c("b_entity_id").alias("b_id"), "samples", r("span_minutes").alias("span_minutes"))


@query("j13_idempotency_anti_join", ("finding",), f"""
    SELECT id FROM finding f WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM finding p WHERE p.event_id % 2 = 0 AND p.entity_id = f.entity_id AND p.key = f.key
      AND p.event_time >= {MAX_TS} - INTERVAL 10 DAY)""")
def j13(t: Tables) -> DataFrame:
    rows = t.finding
    return not_found_before(rows.filter(c("event_id") % 2 == 1), rows.filter(c("event_id") % 2 == 0), t.as_of - hours(240)).select("id")


_PA = f"""arr AS (SELECT * FROM finding WHERE event_type IN ('port_call', 'port_arrival') AND event_time >= {MAX_TS} - INTERVAL 10 DAY),
  hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_time DESC, key DESC) AS rn FROM finding
    WHERE event_type = 'sanctioned_vessel_underway' AND event_time >= {MAX_TS} - INTERVAL 20 DAY) WHERE rn = 1)"""
_J = lambda a, k: f"json_extract_string({a}.properties, '$.{k}')"


def _port_arrivals(t: Tables) -> DataFrame:
    return listed.listed_port_arrivals(t.finding, t.as_of, arrival_minutes=14_400, match_minutes=28_800)


@query("j14_findings_join", ("finding",), f"""
    SELECT arr.entity_id, arr.key, arr.event_time, {_J('hit', 'live_vessel_name')} AS vessel FROM arr JOIN hit ON arr.entity_id = hit.entity_id""", _PA)
def j14(t: Tables) -> DataFrame:
    return _port_arrivals(t).select("entity_id", "key", "event_time", F.get_json_object("properties", "$.vessel_name").alias("vessel"))


@query("j15_partner_resolution", ("finding", "entity"), f"""
    SELECT f.id, m AS member_id, e.display_name FROM (SELECT id, unnest(string_split(members, '|')) AS m, members FROM finding WHERE list_contains(string_split(members, '|'), '7')
      AND event_time >= {MAX_TS} - INTERVAL 720 HOUR) f LEFT JOIN entity e ON e.entity_id = f.m WHERE m <> '7'""")
def j15(t: Tables) -> DataFrame:
    rows = serving.partners(t.finding, t.entity, "7", t.as_of, 720, limit=100_000)
    return rows.select("id", F.explode("partners").alias("p")).select("id", "p.member_id", "p.display_name")


@query("j16_canonical_id_lookup", ("entity",), "SELECT entity_id, display_name FROM entity WHERE entity_type = 'vessel' AND canonical_id_type = 'mmsi' AND canonical_id = '208000021'")
def j16(t: Tables) -> DataFrame:
    return serving.lookup_entity(t.entity, "vessel", "mmsi", "208000021").select("entity_id", "display_name")


@query("j17_corroboration_counts", ("geo",), f"""
    SELECT a.event_id, count(b.event_id) AS corroborations FROM geo a LEFT JOIN geo b ON a.layer <> b.layer AND abs(a.lat - b.lat) <= 1
      AND {haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 100 GROUP BY 1""")
def j17(t: Tables) -> DataFrame:
    return spatial.corroboration_counts(t.geo, 100_000).select("event_id", "corroborations")


def predictions(t: Tables) -> DataFrame:
    i = c("o_orderkey")
    return t.raw("orders").select(
        i.cast("string").alias("prediction_id"), ((i * 37) % 1700 / 10 - 85).alias("lat"), ((i * 91) % 3600 / 10 - 180).alias("lng"),
        F.when(i % 5 == 0, "Earthquake").when(i % 5 == 1, "conflict zone").when(i % 5 == 2, "cyber").otherwise("natural").alias("category"),
        F.when(i % 3 == 0, "pending").otherwise("graded").alias("status"), c("o_orderdate").cast("timestamp").alias("due_at"),
    )


def quakes(t: Tables) -> DataFrame:
    rows = t.geo.filter(c("layer") == "error")
    return rows.select(c("event_id").alias("quake_id"), (c("value") / 60).alias("magnitude"), F.concat(F.lit("place "), "event_id").alias("place"), "lat", "lng")


_PRED = f"""pred AS (SELECT o_orderkey AS pid, (o_orderkey * 37) % 1700 / 10 - 85 AS lat, (o_orderkey * 91) % 3600 / 10 - 180 AS lng, o_orderkey % 5 AS kind FROM orders WHERE o_orderkey % 3 = 0),
  near AS (SELECT p.pid, q.event_id, q.value / 60 AS magnitude, {haversine_sql('p.lat', 'p.lng', 'q.lat', 'q.lng')} AS km FROM pred p JOIN geo q ON q.layer = 'error' AND p.kind NOT IN (1, 2) AND abs(p.lat - q.lat) < 5),
  best AS (SELECT pid, count(*) AS n, max(magnitude) AS magnitude FROM near WHERE km < 500 GROUP BY 1)"""


@query("j18_prediction_grading", ("geo",), """
    SELECT CAST(p.pid AS VARCHAR) AS prediction_id, CASE WHEN kind IN (1, 2) THEN 'unresolved' WHEN n > 0 THEN 'win' ELSE 'loss' END AS outcome, coalesce(n, 0) AS evidence_count, round(magnitude, 6) AS magnitude
    FROM pred p LEFT JOIN best b ON b.pid = p.pid""", _PRED)
def j18(t: Tables) -> DataFrame:
    graded = watch.grade_predictions(predictions(t), quakes(t), t.raw("documents"), t.as_of)
    return graded.select("prediction_id", "outcome", "evidence_count", r("magnitude", 6).alias("magnitude"))


# ------------------------------------------------------------------ detectors
@query("d1_event_proximity", (*CUR, "finding"), f"""
    SELECT entity_id, id AS key, entity_type || '_' || src AS event_subtype, greatest(position_time, event_time) AS event_time, severity, CAST(round(distance_m) AS BIGINT) AS distance_m
    FROM {geodesic_sql("(SELECT c.entity_id, c.entity_type, c.position_time, f.id, f.event_type AS src, f.event_time, f.severity, c.lat, c.lng, f.lat AS f_lat, f.lng AS f_lng FROM current c, finding f WHERE c.entity_type <> 'satellite' "
      + f"AND c.position_time >= {MAX_TS} - INTERVAL 14 DAY AND f.event_type IN ('nasa_firms', 'usgs_quake', 'kev_disclosure', 'newsdata') AND f.lat IS NOT NULL AND f.event_time >= {MAX_TS} - to_minutes(CAST(coalesce(f.decay_half_life_min, 20160) AS BIGINT)))", 'lat', 'lng', 'f_lat', 'f_lng')}
    WHERE distance_m <= 500000""", CURRENT)
def d1(t: Tables) -> DataFrame:
    pairs = encounters.events_near(t.current, t.finding, t.as_of, radius_m=500_000, window_min=FRESH_MIN)
    return pairs.select(
        "entity_id", c("source_id").alias("key"), F.concat_ws("_", "entity_type", "source_type").alias("event_subtype"),
        F.greatest("position_time", "source_time").alias("event_time"), c("source_severity").alias("severity"), metres(c("distance_m")).alias("distance_m"),
    )


@query("d2_entity_proximity", CUR, f"""
    SELECT least(a_id, b_id) || '|' || greatest(a_id, b_id) AS key, a_type || '_' || b_type AS event_subtype FROM {_PAIRS} WHERE a_type < b_type AND a_type <> 'satellite' AND b_type <> 'satellite' AND distance_m <= 50000""", CURRENT)
def d2(t: Tables) -> DataFrame:
    return encounters.entity_proximity(t.current, t.as_of, window_min=60 * 24 * 60).select("key", "event_subtype")


_DARK = f"(epoch_us({MAX_TS}) - epoch_us(position_time)) / 3.6e9"
_DARK_ROWS = f"""dark AS (SELECT *, {_DARK} AS h FROM current WHERE entity_type = 'vessel' AND velocity_ms > 0.5 AND {_DARK} > 6 AND {_DARK} < 336)"""


@query("d3_dark_vessel", CUR, """
    SELECT entity_id, CASE WHEN h < 24 THEN 'short' WHEN h < 168 THEN 'medium' ELSE 'long' END AS event_subtype, round(least(10.0, greatest(1.0, h / 12)), 6) AS severity,
      'Vessel went dark: ' || coalesce(display_name, 'MMSI ' || canonical_id) AS title, cohort FROM (SELECT *, count(*) OVER (PARTITION BY date_trunc('second', position_time)) AS cohort FROM dark) WHERE cohort < 6""",
    CURRENT + ", " + _DARK_ROWS)
def d3(t: Tables) -> DataFrame:
    found = movement.dark_vessels(t.current, t.as_of)
    return found.select("entity_id", "event_subtype", r("severity", 6).alias("severity"), "title", F.get_json_object("properties", "$.cohort_size").cast("bigint").alias("cohort"))


@query("d4_loitering", CUR, f"""
    SELECT entity_id, entity_type AS event_subtype, pings, round(least(10.0, greatest(3.0, span / 2)), 6) AS severity FROM (
      SELECT c.entity_id, c.entity_type, count(*) AS pings, (epoch_us(max(t.time)) - epoch_us(min(t.time))) / 3.6e9 AS span, max(t.lat) - min(t.lat) AS la, max(t.lng) - min(t.lng) AS ln, avg(t.lat) AS m, avg(t.velocity_ms) AS v
      FROM current c JOIN track t ON t.entity_id = c.entity_id WHERE c.entity_type IN ('vessel', 'aircraft') AND c.position_time >= {MAX_TS} - INTERVAL 48 HOUR AND t.time >= {MAX_TS} - INTERVAL 240 HOUR GROUP BY 1, 2)
    WHERE pings >= 5 AND span >= 4 AND la <= 1000 / 111000.0 AND ln * cos(radians(m)) <= 1000 / 111000.0 AND v > 0.2 AND NOT (la = 0 AND ln = 0)""", CURRENT)
def d4(t: Tables) -> DataFrame:
    found = movement.loitering(t.current, t.track, t.as_of, lookback_hours=240, active_hours=48)
    return found.select("entity_id", "event_subtype", F.get_json_object("properties", "$.pings").cast("bigint").alias("pings"), r("severity", 6).alias("severity"))


_SLOW = f"""slow AS (SELECT c.* FROM current c LEFT JOIN (SELECT entity_id, max(velocity_ms) AS v FROM track WHERE time >= {MAX_TS} - INTERVAL 14 DAY GROUP BY 1) m ON m.entity_id = c.entity_id
    WHERE c.entity_type IN ('vessel', 'aircraft') AND c.position_time >= {MAX_TS} - INTERVAL 14 DAY AND c.velocity_ms BETWEEN 0.5 AND 5 AND (m.v IS NULL OR m.v <= 50)),
  pair AS (SELECT * FROM {geodesic_sql("(SELECT a.entity_id AS a_id, b.entity_id AS b_id, a.entity_type AS a_type, b.entity_type AS b_type, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng FROM slow a, slow b WHERE a.entity_id < b.entity_id)", 'a_lat', 'a_lng', 'b_lat', 'b_lng')} WHERE distance_m <= 1000),
  kept AS (SELECT a_id, b_id FROM {geodesic_sql("(SELECT p.a_id, p.b_id, a.time AS ta, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng FROM pair p JOIN track a ON a.entity_id = p.a_id JOIN track b ON b.entity_id = p.b_id AND abs(epoch_us(a.time) - epoch_us(b.time)) <= 21600000000)", 'a_lat', 'a_lng', 'b_lat', 'b_lng')}
    WHERE distance_m <= 1000 GROUP BY 1, 2 HAVING count(*) >= 2 AND epoch_us(max(ta)) - epoch_us(min(ta)) >= 1200000000)"""


@query("d5_rendezvous", CUR, """
    SELECT p.a_id || '|' || p.b_id AS pair, a_type || '_' || b_type AS event_subtype, CAST(round(distance_m) AS BIGINT) AS distance_m,
      least(10.0, CASE WHEN distance_m < 250 THEN 9.0 WHEN distance_m < 500 THEN 8.0 ELSE 7.0 END + CASE WHEN a_type = 'vessel' AND b_type = 'vessel' THEN 1.0 ELSE 0.0 END) AS severity
    FROM pair p JOIN kept k ON k.a_id = p.a_id AND k.b_id = p.b_id""", CURRENT + ", " + _SLOW)
def d5(t: Tables) -> DataFrame:
    found = encounters.rendezvous(
        t.current, t.track, t.as_of, fresh_minutes=FRESH_MIN, recent_minutes=FRESH_MIN, track_minutes=60 * 24 * 60, tolerance_s=21_600, max_velocity=5.0
    )
    return found.select(
        F.array_join("entity_ids", "|").alias("pair"), "event_subtype", F.get_json_object("properties", "$.distance_m").cast("bigint").alias("distance_m"), "severity"
    )


_IN_PORT = f"inport AS (SELECT * FROM {_PORT_PAIRS} WHERE distance_m <= 5000 AND entity_type = 'vessel' AND velocity_ms < 4 AND position_time >= {MAX_TS} - INTERVAL 14 DAY)"
_PORT = dict(fresh_minutes=FRESH_MIN, max_velocity=4.0)


def prior_calls(t: Tables, event_type: str) -> DataFrame:
    """Earlier findings at ports, from a third of the entities' older positions."""
    calls = ports.port_calls(t.current.filter(c("user_id") % 3 == 0), t.ports, t.as_of, **_PORT)
    return calls.withColumns({"event_type": F.lit(event_type), "event_time": t.as_of - hours(10)})


@query("d6_port_call", CUR, """
    SELECT entity_id, port_id AS key, port_country AS event_subtype, CASE port_kind WHEN 'strategic' THEN 6.0 ELSE 3.0 END AS severity, position_time AS event_time FROM inport WHERE user_id % 3 <> 0""",
    CURRENT + ", " + _IN_PORT)
def d6(t: Tables) -> DataFrame:
    found = ports.port_calls(t.current, t.ports, t.as_of, prior=prior_calls(t, "port_call"), **_PORT)
    return found.select("entity_id", "key", "event_subtype", "severity", "event_time")


@query("d7_port_arrival", CUR, """
    SELECT entity_id, port_id AS key, CASE port_kind WHEN 'strategic' THEN 7.0 ELSE 4.0 END AS severity, coalesce(display_name, canonical_id) || ' arrived at ' || port_name AS title FROM inport WHERE user_id % 3 <> 0""",
    CURRENT + ", " + _IN_PORT)
def d7(t: Tables) -> DataFrame:
    return ports.port_arrivals(t.current, t.ports, t.as_of, prior=prior_calls(t, "port_call"), **_PORT).select("entity_id", "key", "severity", "title")


@query("d8_port_departure", CUR, f"""
    SELECT entity_id, port_id AS key, CASE port_kind WHEN 'strategic' THEN 7.0 ELSE 4.0 END AS severity FROM {geodesic_sql("(SELECT c.*, p.* FROM current c JOIN ports p ON p.port_no = c.user_id % 103)", 'lat', 'lng', 'port_lat', 'port_lng')}
    WHERE position_time >= {MAX_TS} - INTERVAL 14 DAY AND distance_m > 5000 AND user_id % 2 = 0""", CURRENT)
def d8(t: Tables) -> DataFrame:
    numbered = t.view("ports").select("port_no", "port_id")
    at = t.current.join(numbered, c("user_id") % 103 == c("port_no")).select("entity_id", "user_id", c("port_id").alias("key"))
    calls = at.withColumns({"event_type": F.lit("port_call"), "event_time": t.as_of - hours(10)})
    left = at.filter(c("user_id") % 2 == 1).withColumns({"event_type": F.lit("port_departure"), "event_time": t.as_of - hours(5)})
    found = ports.port_departures(t.current, t.ports, t.as_of, calls.unionByName(left), fresh_minutes=FRESH_MIN)
    return found.select("entity_id", "key", "severity")


@query("d9_military_flight", CUR, f"""
    SELECT entity_id, CASE WHEN display_name IS NOT NULL AND length(display_name) >= 4 THEN nullif(regexp_extract(upper(display_name), '^[A-Z]+'), '') ELSE 'unknown' END AS event_subtype, 5.0 AS severity
    FROM current WHERE entity_type = 'aircraft' AND military AND position_time >= {MAX_TS} - INTERVAL 14 DAY""", CURRENT)
def d9(t: Tables) -> DataFrame:
    return movement.military_flights(t.current, t.as_of, fresh_minutes=FRESH_MIN).select("entity_id", "event_subtype", "severity")


@query("d10_zone_intrusion", CUR, f"SELECT entity_id, zone AS event_subtype, CAST(zone_severity AS DOUBLE) AS severity FROM ({_ZONE_ROWS}) WHERE entity_type = 'aircraft' AND position_time >= {MAX_TS} - INTERVAL 14 DAY", CURRENT)
def d10(t: Tables) -> DataFrame:
    found = movement.zone_intrusions(t.current, R.zones_df(t.spark), t.as_of, fresh_minutes=FRESH_MIN)
    return found.select("entity_id", "event_subtype", "severity")


_MATCHED = f"""matched AS (SELECT h.*, c.lat, c.lng, c.display_name, c.canonical_id, c.user_id, l.authority, l.regime, {FLAG_SQL.replace('canonical_id', 'c.canonical_id')} AS flag
    FROM hits h JOIN current c ON c.entity_id = h.entity_id JOIN listed l ON l.listed_id = h.listed_id WHERE c.position_time >= {MAX_TS} - INTERVAL 14 DAY),
  under AS (SELECT * FROM matched WHERE match_kind = 'imo' OR coalesce(flag IN ('PA', 'LR') OR CASE regime WHEN 'RUSSIA' THEN flag IN ('RU', 'UA') WHEN 'IRAN' THEN flag = 'IR' WHEN 'DPRK' THEN flag = 'KP' ELSE true END, true))"""
MATCHED = ", ".join((CURRENT, MATCH_SQL, _MATCHED))
LIVE = (*CUR, "listed")


def matches(t: Tables) -> DataFrame:
    return listed.sanctions_matches(t.current, t.listed, t.as_of, fresh_hours=14 * 24, identity_digits=IDENTITY_DIGITS)


@query("d11_sanctions_match", LIVE, """
    SELECT entity_id, listed_id AS key, match_kind || '_match' AS event_subtype, CASE match_kind WHEN 'imo' THEN 10.0 ELSE 9.0 END AS severity, coalesce(authority, 'US Treasury OFAC') AS authority FROM under""", MATCHED)
def d11(t: Tables) -> DataFrame:
    return matches(t).select("entity_id", "key", "event_subtype", "severity", listed.prop("sanctioning_authority").alias("authority"))


_DEFAULT_FLAG = """CASE WHEN m IN (351, 352, 353, 354, 355, 356, 357, 370, 371, 372, 373, 636, 637, 538, 215, 229, 248, 249, 256, 417, 477, 563, 564, 565) THEN 'any'
      WHEN m IN (273, 272) THEN 'ru' WHEN m = 422 THEN 'ir' WHEN m = 445 THEN 'kp'
      WHEN m IN (205, 211, 218, 219, 220, 224, 225, 226, 227, 228, 230, 232, 233, 234, 235, 237, 239, 240, 241, 244, 245, 246, 247, 257, 258, 259, 261, 265, 266, 269, 271, 275, 276, 277, 316,
        323, 345, 366, 367, 368, 369, 403, 408, 412, 413, 414, 416, 419, 431, 432, 440, 441, 468, 470, 471, 503, 525, 533, 548, 567, 574, 601, 622, 701, 710, 730, 775) THEN 'other' END"""


@query("d11_default_flag_rule", LIVE, f"""
    SELECT entity_id, listed_id AS key, match_kind FROM (SELECT *, {_DEFAULT_FLAG} AS f FROM (SELECT *, CAST(floor(CAST(canonical_id AS BIGINT) / 1000000) AS BIGINT) AS m FROM matched))
    WHERE match_kind = 'imo' OR f IS NULL OR f = 'any' OR CASE regime WHEN 'RUSSIA' THEN f = 'ru' WHEN 'IRAN' THEN f = 'ir' WHEN 'DPRK' THEN f = 'kp' ELSE true END
      OR regime IS NULL""", MATCHED)
def d11_default(t: Tables) -> DataFrame:
    found = listed.sanctions_matches(t.current, t.listed, t.as_of, fresh_hours=14 * 24)
    return found.select("entity_id", "key", listed.prop("match_kind").alias("match_kind"))


@query("d12_multi_authority", LIVE, """
    SELECT entity_id, string_agg(DISTINCT a, '|' ORDER BY a) AS key, CASE WHEN count(DISTINCT a) >= 3 THEN 'tri_listed' ELSE 'dual_listed' END AS event_subtype, bool_or(match_kind = 'imo') AS any_imo
    FROM (SELECT *, coalesce(authority, 'US Treasury OFAC') AS a FROM under) GROUP BY 1 HAVING count(DISTINCT a) >= 2""", MATCHED)
def d12(t: Tables) -> DataFrame:
    found = listed.multi_authority(matches(t), t.as_of)
    return found.select("entity_id", "key", "event_subtype", listed.prop("any_imo_match").cast("boolean").alias("any_imo"))


@query("d13_listed_and_dark", LIVE, "SELECT d.entity_id, h.listed_id AS key, h.match_kind || '_match' AS event_subtype FROM dark d JOIN hits h ON h.entity_id = d.entity_id", ", ".join((CURRENT, MATCH_SQL, _DARK_ROWS)))
def d13(t: Tables) -> DataFrame:
    return listed.listed_and_dark(t.current, t.listed, t.as_of).select("entity_id", "key", "event_subtype")


_RDV = f"""mover AS (SELECT c.entity_id, c.lat, c.lng, EXISTS (SELECT 1 FROM hits h WHERE h.entity_id = c.entity_id) AS on_list FROM current c
    WHERE c.entity_type = 'vessel' AND c.velocity_ms BETWEEN 0.5 AND 5 AND c.position_time >= {MAX_TS} - INTERVAL 14 DAY)"""


@query("d14_listed_rendezvous", LIVE, f"""
    SELECT a_id || '|' || b_id AS pair, CASE WHEN a_on AND b_on THEN 'both_sanctioned' ELSE 'one_sanctioned' END AS event_subtype,
      CASE WHEN a_on AND b_on AND distance_m < 500 THEN 10.0 WHEN a_on AND b_on THEN 9.0 WHEN distance_m < 500 THEN 9.0 ELSE 8.0 END AS severity
    FROM {geodesic_sql("(SELECT a.entity_id AS a_id, b.entity_id AS b_id, a.on_list AS a_on, b.on_list AS b_on, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng FROM mover a, mover b WHERE a.entity_id < b.entity_id AND (a.on_list OR b.on_list))", 'a_lat', 'a_lng', 'b_lat', 'b_lng')}
    WHERE distance_m <= 2000""", ", ".join((CURRENT, MATCH_SQL, _RDV)))
def d14(t: Tables) -> DataFrame:
    found = listed.listed_rendezvous(t.current, t.listed, t.as_of, radius_m=2000, fresh_minutes=FRESH_MIN, max_velocity=5.0)
    return found.select(F.array_join("entity_ids", "|").alias("pair"), "event_subtype", "severity")


@query("d15_listed_port_arrival", ("finding",), f"""
    SELECT arr.entity_id, arr.key, {_J('hit', 'match_regime')} || ':' || {_J('arr', 'port_country')} AS event_subtype, CASE {_J('arr', 'port_kind')} WHEN 'strategic' THEN 10.0 ELSE 8.0 END AS severity
    FROM arr JOIN hit ON arr.entity_id = hit.entity_id""", _PA)
def d15(t: Tables) -> DataFrame:
    return _port_arrivals(t).select("entity_id", "key", "event_subtype", "severity")


_DBSCAN = """pt AS (SELECT entity_id AS id, radians(max(lng)) * 6378137.0 AS x, ln(tan(pi()/4 + radians(max(lat))/2)) * 6378137.0 AS y FROM under GROUP BY 1),
  nb AS (SELECT a.id, b.id AS o FROM pt a JOIN pt b ON abs(a.x - b.x) <= 10000 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1e8),
  core AS (SELECT id FROM nb GROUP BY 1 HAVING count(*) >= 3),
  reach AS (SELECT id AS src, id AS dst FROM core UNION SELECT r.src, nb.o FROM reach r JOIN nb ON nb.id = r.dst JOIN core ON core.id = nb.o),
  label AS (SELECT src AS id, min(dst) AS cl FROM reach GROUP BY 1),
  member AS (SELECT id, cl FROM label UNION ALL SELECT nb.id, min(l.cl) FROM nb JOIN label l ON l.id = nb.o WHERE nb.id NOT IN (SELECT id FROM core) GROUP BY 1),
  width AS (SELECT m.cl, max(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS d FROM member m JOIN member n ON n.cl = m.cl JOIN pt p ON p.id = m.id JOIN pt q ON q.id = n.id GROUP BY 1)"""


@query("d16_fleet_cluster", LIVE, """
    SELECT min(m.id) AS entity_id, string_agg(m.id, '|' ORDER BY m.id) AS members, CASE WHEN count(*) >= 6 THEN 'large_fleet' WHEN count(*) >= 4 THEN 'fleet' ELSE 'cluster' END AS event_subtype, count(*) AS cluster_size, round(any_value(w.d), 1) AS diameter_m
    FROM member m JOIN width w ON w.cl = m.cl WHERE w.d <= 30000 GROUP BY m.cl HAVING count(*) >= 3""", "RECURSIVE " + ", ".join((MATCHED, _DBSCAN)))
def d16(t: Tables) -> DataFrame:
    members = clusters.fleet_members(clusters.latest_matches(matches(t), t.as_of))
    found = clusters.fleet_clusters(members, t.as_of)
    ids = F.array_join("entity_ids", "|").alias("members")
    return found.select("entity_id", ids, "event_subtype", listed.prop("cluster_size").cast("bigint").alias("cluster_size"), listed.prop("diameter_m").cast("double").alias("diameter_m"))


def _daily(t: Tables) -> DataFrame:
    rows = t.geo.withColumns({"region": region_for(c("lat"), c("lng")), "cycle": F.unix_date(F.to_date("event_time"))})
    return rows.groupBy("layer", "region", "cycle").agg(F.count(F.lit(1)).alias("count"))


def baselines(t: Tables) -> DataFrame:
    """Baselines from the daily counts of all days but the last."""
    daily = _daily(t)
    return aggregates.ewma_baselines(daily.filter(c("cycle") < F.unix_date(F.to_date(t.as_of))))


_STATS = f"""b AS (SELECT layer, {region_sql()} AS region, count(*) AS n, round_even(avg(severity), 2) AS avg_severity, max(severity) AS mx, sum(severity) AS sev_sum FROM geo GROUP BY 1, 2),
  base AS (SELECT layer, {region_sql()} AS region, count(*) / 3.0 AS mean_count, 2.0 + count(*) % 9 AS std_count, CAST(count(*) % 6 AS INT) AS n_cycles FROM geo GROUP BY 1, 2)"""


def test_baselines(t: Tables) -> DataFrame:
    s = aggregates.bucket_stats(t.geo)
    n = c("count")
    return s.select("layer", "region", (n / 3).alias("mean_count"), (2.0 + n % 9).alias("std_count"), (n % 6).cast("int").alias("n_cycles"))


@query("d17_bucket_anomaly", ("geo",), """
    SELECT b.layer, b.region, n AS count, round_even((n - mean_count) / greatest(1.0, std_count), 2) AS z_score, CASE WHEN n > mean_count THEN 'spike' ELSE 'dropout' END AS direction,
      CAST(least(10, greatest(3, round_even(abs((n - mean_count) / greatest(1.0, std_count)) + mx / 2, 0))) AS INT) AS anomaly_severity
    FROM b JOIN base ON b.layer = base.layer AND b.region = base.region WHERE n >= 5 AND n_cycles >= 3 AND abs((n - mean_count) / greatest(1.0, std_count)) >= 2""", _STATS)
def d17(t: Tables) -> DataFrame:
    found = anomaly.ewma_anomalies(aggregates.bucket_stats(t.geo), test_baselines(t))
    return found.select("layer", "region", "count", "z_score", "direction", "anomaly_severity")


def forest_found(t: Tables) -> DataFrame:
    hourly = anomaly.bucket_features(t.geo)
    today = t.geo.filter(c("event_time") >= t.as_of - hours(48))
    trees = anomaly.train_forest(hourly)
    current = anomaly.bucket_features(today)
    return anomaly.forest_anomalies(current, hourly, trees, min_sample=1)


@query("d18_isolation_forest")
def d18(t: Tables) -> DataFrame:
    worst = forest_found(t).groupBy("layer", "region").agg(
        F.max("count").alias("count"), F.min("iso_score").alias("iso_score"), F.max("max_severity").alias("max_severity"), F.max("anomaly_severity").alias("anomaly_severity")
    )
    ewma = anomaly.ewma_anomalies(aggregates.bucket_stats(t.geo), test_baselines(t))
    return anomaly.combine(ewma, worst)


def layered(t: Tables) -> DataFrame:
    """Events under layer names that the pair rules know."""
    names_of = F.create_map(*[F.lit(x) for kv in {"error": "conflict", "click": "planes", "view": "ships", "signup": "cyber", "purchase": "finance"}.items() for x in kv])
    return t.geo.withColumn("layer", names_of[c("layer")])


_LAYERED = """lay AS (SELECT * REPLACE (CASE layer WHEN 'error' THEN 'conflict' WHEN 'click' THEN 'planes' WHEN 'view' THEN 'ships' WHEN 'signup' THEN 'cyber' ELSE 'finance' END AS layer) FROM geo),
  cells AS (SELECT CAST(floor(lng / 5) AS BIGINT) AS cell_x, CAST(floor(lat / 5) AS BIGINT) AS cell_y, string_agg(DISTINCT layer, '+' ORDER BY layer) AS layers, count(DISTINCT layer) AS nl, list(DISTINCT layer) AS ls,
    count(*) AS event_count, round_even(avg(lat), 3) AS center_lat, max(severity) AS mx FROM lay GROUP BY 1, 2 HAVING count(DISTINCT layer) >= 2),
  fired AS (SELECT cell_x, cell_y, s, rule FROM cells JOIN (VALUES """ + ", ".join(
    f"('{a}', '{b}', {s}, '{label}')" for a, b, s, label in R.PAIR_RULES
) + """) AS v(a, b, s, rule) ON list_contains(ls, a) AND list_contains(ls, b))"""


@query("d19_correlation", ("geo",), """
    SELECT c.cell_x, c.cell_y, c.layers, c.event_count, coalesce(f.n, 0) AS rules, CAST(coalesce(f.s, least(8, 2 + c.nl + c.mx // 3)) AS INT) AS severity
    FROM cells c LEFT JOIN (SELECT cell_x, cell_y, count(*) AS n, max(s) AS s FROM fired GROUP BY 1, 2) f ON f.cell_x = c.cell_x AND f.cell_y = c.cell_y""", _LAYERED)
def d19(t: Tables) -> DataFrame:
    found = correlate.correlations(layered(t))
    return found.select("cell_x", "cell_y", F.array_join("layers", "+").alias("layers"), "event_count", F.size("rules_fired").alias("rules"), "severity")


@query("d20_firing_audit", ("geo",), """
    SELECT coalesce(td.rule, h.rule) AS rule, coalesce(td.k, 0) AS today_firings, coalesce(h.k, 0) AS history_firings, round_even(coalesce(td.k, 0) / (SELECT count(*) FROM cells WHERE cell_x >= 0), 6) AS today_rate,
      round_even(coalesce(h.k, 0) / (SELECT count(*) FROM cells WHERE cell_x < 0), 6) AS baseline_rate
    FROM (SELECT rule, count(*) AS k FROM fired WHERE cell_x >= 0 GROUP BY 1) td FULL JOIN (SELECT rule, count(*) AS k FROM fired WHERE cell_x < 0 GROUP BY 1) h ON h.rule = td.rule""", _LAYERED)
def d20(t: Tables) -> DataFrame:
    found = correlate.correlations(layered(t))
    audit = correlate.firing_audit(found.filter(c("cell_x") >= 0), found.filter(c("cell_x") < 0))
    return audit.select("rule", "today_firings", "history_firings", "today_rate", "baseline_rate")


def samples(t: Tables) -> DataFrame:
    return t.geo.withColumn("region", region_for(c("lat"), c("lng"))).select("layer", "region", "event_time", "severity")


@query("d21_hotspots")
def d21(t: Tables) -> DataFrame:
    return forecast.hotspots(samples(t), t.as_of)


@query("d21_recency_score", ("geo",), f"""
    SELECT layer, region, round(sum(severity * exp(-a / 12.0) * CASE WHEN a <= 6 THEN 1.5 ELSE 1.0 END), 4) AS score, max(severity) AS max_severity
    FROM (SELECT layer, {region_sql()} AS region, severity, greatest(0, (epoch_us({MAX_TS}) - epoch_us(event_time)) / 3.6e9) AS a FROM geo) GROUP BY 1, 2""")
def d21b(t: Tables) -> DataFrame:
    return forecast.recency_scores(samples(t), t.as_of).select("layer", "region", r("recency_score", 4).alias("score"), c("max_historical_severity").alias("max_severity"))


@query("d21_hourly_series", ("geo",), f"""
    SELECT layer, region, CAST(71 - floor(a) AS INT) AS slot, CAST(sum(severity) AS DOUBLE) AS s FROM (SELECT layer, {region_sql()} AS region, severity, (epoch_us({MAX_TS}) - epoch_us(event_time)) / 3.6e9 AS a FROM geo)
    WHERE a >= 0 AND a < 72 GROUP BY 1, 2, 3 HAVING sum(severity) > 0""")
def d21c(t: Tables) -> DataFrame:
    series = forecast.hourly_series(samples(t), t.as_of)
    return series.select("layer", "region", F.posexplode("series").alias("slot", "s")).filter(c("s") > 0)


@query("d22_entity_resolution")
def d22(t: Tables) -> DataFrame:
    vessels = t.entity.filter(c("entity_type") == "vessel")
    return resolution.alias_edges(vessels, t.listed, t.as_of)


@query("d22_candidate_pairs", ("entity", "listed"), f"""
    SELECT entity_id, listed_id, CASE WHEN imo IS NULL OR listed_imo IS NULL THEN 0 WHEN imo = listed_imo THEN 2 ELSE 1 END AS imo_level,
      CASE WHEN sim >= 0.9 THEN 2 WHEN sim >= 0.75 THEN 1 ELSE 0 END AS name_level
    FROM (SELECT e.entity_id, l.listed_id, e.imo, l.listed_imo, coalesce({jaccard_sql('e.g', 'l.g')}, 0) AS sim FROM (SELECT *, {trigrams_sql('upper(display_name)')} AS g FROM entity WHERE entity_type = 'vessel') e,
      (SELECT *, {trigrams_sql('upper(listed_name)')} AS g FROM listed) l) WHERE sim >= 0.75 OR imo = listed_imo""")
def d22b(t: Tables) -> DataFrame:
    pairs = resolution.candidate_pairs(t.entity.filter(c("entity_type") == "vessel"), t.listed)
    return pairs.select("entity_id", "listed_id", "imo_level", "name_level")


