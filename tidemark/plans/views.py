"""Deterministic views over the test tables, in SQL that both engines read alike.

The tables have no coordinates, vessels or findings, so every registered query starts from
these views. Text in braces marks what differs between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import shared_folder
from tidemark.sources.refdata import CATEGORIES, PORTS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages",
    "benchmark", "conversations",
)
FINDING_TYPES = [c[1] for c in CATEGORIES] + [
    "port_call", "port_arrival", "port_departure", "detected_proximity", "rendezvous_detected", "kev_disclosure", "newsdata",
]
_TYPE_CASE = "CASE (event_id * 7) % {n} {whens} END".format(
    n=len(FINDING_TYPES), whens=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FINDING_TYPES))
)
_PORT_VALUES = ", ".join(
    "({}, '{}', '{}', '{}', CAST({} AS DOUBLE), CAST({} AS DOUBLE), '{}')".format(i, p[0], p[1].replace("'", ""), p[2], p[3], p[4], p[5])
    for i, p in enumerate(PORTS)
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "geo": ((), """
        SELECT event_id, {ts} AS event_time, CAST(user_id AS STRING) AS entity_id, user_id, event_type AS layer,
          CAST((event_id * 37) % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST((event_id * 91) % 3600 AS DOUBLE) / 10 - 180 AS lng,
          CAST(CAST(floor(value) AS BIGINT) % 11 AS INT) AS severity, value, props
        FROM {events}"""),
    "ports": ((), f"""
        SELECT * FROM (VALUES {_PORT_VALUES}) AS v(port_no, port_id, port_name, port_country, port_lat, port_lng, port_kind)"""),
    "track": (("ports",), """
        SELECT b.ping_id, b.time, b.entity_id, b.user_id,
          COALESCE(p.port_lat, b.lat0) + b.d_lat AS lat, COALESCE(p.port_lng, b.lng0) + b.d_lng AS lng,
          CAST((b.ping_id * 7) % 60 AS DOUBLE) / 10 AS velocity_ms, CAST((b.ping_id * 13) % 360 AS DOUBLE) AS heading_deg
        FROM (
          SELECT event_id AS ping_id, {ts} AS time, CAST(user_id AS STRING) AS entity_id, user_id, g,
            CASE WHEN g % 3 = 1 THEN CAST(20 + (g * 5) % 28 AS DOUBLE) ELSE CAST((g * 37) % 120 - 60 AS DOUBLE) END AS lat0,
            CASE WHEN g % 3 = 1 THEN CAST(30 + (g * 7) % 32 AS DOUBLE) ELSE CAST((g * 91) % 360 - 180 AS DOUBLE) END AS lng0,
            CAST(user_id % 10 AS DOUBLE) * 0.004 + CAST(event_id % 5 AS DOUBLE) * 0.0007
              + CASE WHEN user_id % 4 = 0 THEN CAST(event_id % 1000 AS DOUBLE) * 0.01 ELSE 0.0 END AS d_lat,
            CAST(user_id % 3 AS DOUBLE) * 0.003 + CAST(event_id % 7 AS DOUBLE) * 0.0006 AS d_lng
          FROM (SELECT *, CAST(floor(user_id / 10) AS BIGINT) AS g FROM {events}) AS e
        ) AS b LEFT JOIN ports AS p ON b.g % 3 = 0 AND p.port_no = CAST(floor(b.g / 3) AS BIGINT) % 103"""),
    "entity": ((), """
        SELECT u.user_id, CAST(u.user_id AS STRING) AS entity_id,
          CASE WHEN u.user_id % 5 = 0 THEN 'aircraft' WHEN u.user_id % 11 = 3 THEN 'satellite' ELSE 'vessel' END AS entity_type,
          CASE WHEN u.user_id % 5 = 0 THEN 'icao24' WHEN u.user_id % 11 = 3 THEN 'norad' ELSE 'mmsi' END AS canonical_id_type,
          CAST(201000000 + (u.user_id * 1000003) % 574000000 AS STRING) AS canonical_id,
          CASE WHEN u.user_id % 13 = 6 THEN NULL WHEN u.user_id % 5 = 0 THEN 'RCH' || CAST(u.user_id AS STRING)
            ELSE upper(p.p_name) || ' ' || CAST(u.user_id AS STRING) || CASE WHEN u.user_id % 7 = 2 THEN 'S' ELSE '' END END AS display_name,
          CASE WHEN u.user_id % 4 = 1 THEN CAST(9000000 + u.user_id AS STRING) END AS imo,
          u.user_id % 3 = 0 AS military, n.n_name AS origin_country
        FROM (SELECT DISTINCT user_id FROM {events}) AS u
        LEFT JOIN {part} AS p ON p.p_partkey = u.user_id LEFT JOIN {nation} AS n ON n.n_nationkey = u.user_id % 25"""),
    "listed": ((), """
        SELECT 'S' || CAST(s.p_partkey AS STRING) AS listed_id,
          CASE WHEN s.p_partkey % 9 = 4 THEN 'sanctioned_aircraft' ELSE 'sanctioned_vessel' END AS entity_type,
          CASE s.p_partkey % 4 WHEN 1 THEN 'uk_ofsi_group_id' WHEN 2 THEN 'eu_logical_id' ELSE 'ofac_sdn_id' END AS id_type,
          upper(t.p_name) || ' ' || CAST(t.p_partkey AS STRING) AS listed_name,
          CASE WHEN s.p_partkey % 2 = 1 THEN CAST(9000000 + t.p_partkey AS STRING) END AS listed_imo,
          CAST(NULL AS STRING) AS listed_mmsi,
          CASE s.p_partkey % 4 WHEN 0 THEN 'US Treasury OFAC' WHEN 1 THEN 'UK OFSI' WHEN 2 THEN 'EU CFSP' END AS authority,
          CASE s.p_partkey % 5 WHEN 0 THEN 'RUSSIA' WHEN 1 THEN 'IRAN' WHEN 2 THEN 'DPRK' WHEN 3 THEN 'GLOBAL MAGNITSKY' END AS regime
        FROM {part} AS s JOIN {part} AS t ON t.p_partkey = CAST(floor(s.p_partkey / 2) AS BIGINT)"""),
    "finding": ((), f"""
        SELECT 'F' || CAST(event_id AS STRING) AS id, event_id, {_TYPE_CASE} AS event_type,
          CASE event_id % 4 WHEN 0 THEN 'vessel_vessel' WHEN 1 THEN 'aircraft_vessel' WHEN 2 THEN 'vessel_port_call' ELSE 'vessel_usgs_quake' END AS event_subtype,
          {{ts}} AS event_time,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id * 37) % 1700 AS DOUBLE) / 10 - 85 END AS lat,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id * 91) % 3600 AS DOUBLE) / 10 - 180 END AS lng,
          CAST(CAST(floor(value) AS BIGINT) % 11 AS DOUBLE) AS severity,
          {_TYPE_CASE} || ' ' || CAST(event_id AS STRING) AS title, 'found by rule ' || CAST(event_id % 3 AS STRING) AS description,
          CAST(user_id AS STRING) AS entity_id,
          CAST(user_id AS STRING) || '|' || CAST((user_id * 7 + event_id) % 150 AS STRING) AS members,
          'P' || CAST(event_id % 7 AS STRING) AS key, 'algo_' || CAST(event_id % 3 AS STRING) AS algorithm,
          event_id % 17 = 0 AS withdrawn, CAST(event_id % 12 AS STRING) AS source_id, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(60 + (event_id % 7) * 600 AS INT) END AS decay_half_life_min, user_id,
          '{{lb}}"hours_dark":' || CAST(event_id % 300 AS STRING) || ',"span_hours":' || CAST(event_id % 40 AS STRING)
            || ',"mmsi":"' || CAST(201000000 + user_id AS STRING) || '","port_name":"Port ' || CAST(event_id % 7 AS STRING)
            || '","port_country":"C' || CAST(event_id % 5 AS STRING) || '","port_kind":"' || CASE WHEN event_id % 2 = 0 THEN 'strategic' ELSE 'commercial' END
            || '","match_regime":"' || CASE event_id % 3 WHEN 0 THEN 'IRAN' WHEN 1 THEN 'RUSSIA' ELSE 'DPRK' END
            || '","live_vessel_name":"MV ' || CAST(user_id AS STRING) || '","sanctioning_authority":"A' || CAST(event_id % 3 AS STRING)
            || '","lat_span_deg":' || CASE WHEN event_id % 4 = 0 THEN '0' ELSE '0.002' END || ',"lng_span_deg":' || CASE WHEN event_id % 8 < 6 THEN '0' ELSE '0.001' END
            || ',"avg_velocity_ms":' || CAST(event_id % 3 AS STRING) || '{{rb}}' AS properties
        FROM {{events}}"""),
    "news": ((), """
        SELECT CAST(event_id AS STRING) AS event_id, event_id AS seq, {ts} AS timestamp, CAST(190 + event_id % 5 AS STRING) AS code,
          CASE event_id % 3 WHEN 0 THEN 'armed_conflict' WHEN 1 THEN 'diplomatic' ELSE 'disaster' END AS category,
          CASE event_id % 6 WHEN 0 THEN 'armed_conflict.airstrike' WHEN 1 THEN 'diplomatic.talks' WHEN 2 THEN 'disaster.flood'
            WHEN 3 THEN 'armed_conflict.shelling' WHEN 4 THEN 'diplomatic.visit' ELSE 'disaster.fire' END AS subcategory,
          CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS severity, event_type || ' report ' || CAST(event_id % 9 AS STRING) || ' from town' AS title,
          'https://' || CASE event_id % 4 WHEN 0 THEN 'www.' ELSE '' END || 'site' || CAST(event_id % 8 AS STRING) || '.org/a/' || CAST(event_id AS STRING) AS source_url,
          CASE WHEN event_id % 3 = 0 THEN 'actor ' || CAST(user_id % 4 AS STRING) END AS actor1_name, CAST(NULL AS STRING) AS actor2_name,
          CAST((user_id * 37) % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST((user_id * 91) % 3600 AS DOUBLE) / 10 - 180 AS lng,
          CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'city' WHEN 2 THEN 'region' WHEN 3 THEN 'country' ELSE 'unknown' END AS geocode_quality,
          CASE event_id % 4 WHEN 0 THEN 'UA' WHEN 1 THEN 'us' WHEN 2 THEN 'RU' END AS iso_country, event_id % 2 = 0 AS is_military, user_id
        FROM {events}"""),
}


def _fill(sql: str, spark_dir: str | None) -> str:
    values = {t: f"parquet.`{spark_dir}/{t}.parquet`" if spark_dir else t for t in TABLES}
    values.update(ts="CAST(ts AS TIMESTAMP)" if spark_dir else "ts", lb="{", rb="}")
    return sql.format(**values)


def oracle(views: tuple[str, ...], body: str, extra: str = "") -> str:
    """A statement for the other engine: the views it needs as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0] if name in VIEWS else ():
            visit(need)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    ctes = [f"{name} AS ({_fill(VIEWS[name][1], None)})" for name in order]
    recursive = extra.startswith("RECURSIVE ")
    if extra:
        ctes.append(extra.removeprefix("RECURSIVE "))
    return (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + body


# Derived relations of the oracle only; the library computes them on the Spark side.
CURRENT = """current AS (
    SELECT e.*, t.time AS position_time, t.lat, t.lng, t.velocity_ms, t.heading_deg FROM entity e JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY time DESC, ping_id DESC) AS rn FROM track) WHERE rn = 1) t
    ON t.entity_id = e.entity_id)"""


def geodesic_sql(source: str, a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    """Rows of a relation with `distance_m` on the ellipsoid, by the trigonometric form of the formula."""
    k, f = "(1 - 1/298.257223563)", "(1/298.257223563)"
    return f"""(SELECT * EXCLUDE (b1, b2, h, s), CASE WHEN h = 0 THEN 0 ELSE 6378137.0 * (s - {f}/2 * (
        (s - sin(s)) * pow(sin((b1+b2)/2) * cos((b2-b1)/2), 2) / (1 - h) + (s + sin(s)) * pow(cos((b1+b2)/2) * sin((b2-b1)/2), 2) / h)) END AS distance_m
      FROM (SELECT *, 2 * asin(sqrt(h)) AS s FROM (
        SELECT *, least(1.0, pow(sin((b2-b1)/2), 2) + cos(b1) * cos(b2) * pow(sin(radians({b_lng} - {a_lng})/2), 2)) AS h FROM (
          SELECT *, atan({k} * tan(radians({a_lat}))) AS b1, atan({k} * tan(radians({b_lat}))) AS b2 FROM {source}))))"""


def haversine_sql(a_lat: str, a_lng: str, b_lat: str, b_lng: str, r: float = 6371.0) -> str:
    return (
        f"(2 * {r} * asin(sqrt(least(1.0, pow(sin(radians({b_lat} - {a_lat})/2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) "
        f"* pow(sin(radians({b_lng} - {a_lng})/2), 2)))))"
    )


def trigrams_sql(text: str) -> str:
    return (
        "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(" + text + "), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def jaccard_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


#: What a session has stored already, by (application, folder, name): tables that are kept at write time.
_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def stored(self, name: str, write: Callable[[str], None]) -> str:
        """The place of a derived table in the shared folder; `write` puts it there at a session's first use."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            write(path)
            _STORED[key] = path
        return _STORED[key]

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        needs, sql = VIEWS[name]
        for need in needs:
            self.view(need).createOrReplaceTempView(need)
        return self.spark.sql(_fill(sql, self.folder))

    @cached_property
    def geo(self) -> DataFrame:
        return self.view("geo")

    @cached_property
    def ports(self) -> DataFrame:
        return self.view("ports").drop("port_no")

    @cached_property
    def track(self) -> DataFrame:
        return self.view("track")

    @cached_property
    def entity(self) -> DataFrame:
        return self.view("entity")

    @cached_property
    def listed(self) -> DataFrame:
        return self.view("listed")

    @cached_property
    def news(self) -> DataFrame:
        flags = F.when(F.col("is_military"), F.array(F.lit("military"))).otherwise(F.array().cast("array<string>"))
        return self.view("news").withColumn("flags", flags)

    @cached_property
    def finding(self) -> DataFrame:
        return self.view("finding").withColumns({
            "entity_ids": F.split("members", "\\|"), "last_seen": F.date_trunc("minute", F.col("event_time") - F.make_dt_interval(hours=F.lit(3))),
        })

    @cached_property
    def current(self) -> DataFrame:
        from tidemark.operators.latest import current_entities

        return current_entities(self.entity, self.track)

    @cached_property
    def as_of(self):
        """The greatest time stamp of the events, as a scalar of the plan."""
        return self.raw("events").agg(F.max("ts").cast("timestamp")).scalar()
