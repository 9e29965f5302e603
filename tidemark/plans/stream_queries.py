"""Queries that run streams over the landed tables (T), and the sanctions lists (R2-R4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import region_for
from tidemark.operators.lineage import shared_folder
from tidemark.operators.watch import share_out, watch_rules
from tidemark.plans.cycle import Inputs, run_cycle, totals
from tidemark.plans.join_queries import _WATCH, FRESH_MIN, watchlists
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import region_sql
from tidemark.plans.table_queries import CHANGES_SQL, T5_ROWS, T5_SQL, changes
from tidemark.plans.views import Tables
from tidemark.sources import lists
from tidemark.sources import refdata as R
from tidemark.sources.feeds import conform, feeds
from tidemark.streaming import flows, state

c = F.col
END = "end of replay"
r6 = lambda name: F.round(name, 6).alias(name)
FILES_PER_TRIGGER = 1000  # of a replay: more files wait for the next micro-batch


def landed(t: Tables, view: DataFrame) -> DataFrame:
    """A view's rows as a stream: written to the shared folder once and read as landed files."""
    folder = f"{shared_folder(t.spark)}/landed-{uuid.uuid4().hex}"
    view.write.parquet(folder)
    return t.spark.readStream.schema(view.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(folder)


@query("t1_feed_stream", ("geo",), """
    SELECT CAST(event_id AS VARCHAR) AS external_id, CAST(CASE WHEN value / 60 >= 7.5 THEN 10 WHEN value / 60 >= 7 THEN 9 WHEN value / 60 >= 6 THEN 8 WHEN value / 60 >= 5.5 THEN 7 WHEN value / 60 >= 5 THEN 6
      WHEN value / 60 >= 4.5 THEN 5 WHEN value / 60 >= 4 THEN 4 WHEN value / 60 >= 3 THEN 2 ELSE 1 END AS INT) AS severity FROM geo WHERE NOT (lat = 0 AND lng = 0)""")
def t1(t: Tables) -> DataFrame:
    """Landed features -> conformed events -> two sinks; the second run adds nothing."""
    props = F.struct(
        (c("value") / 60).alias("mag"), F.lit("p").alias("place"), F.unix_millis("event_time").alias("time"), F.lit(0).alias("tsunami"),
        F.lit(None).cast("string").alias("alert"), F.lit("t").alias("title"), F.lit("u").alias("url"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat", F.lit(1.0)).alias("coordinates"))
    raw = t.geo.select(F.array(F.struct(c("event_id").cast("string").alias("id"), props.alias("properties"), geometry.alias("geometry"))).alias("features"))
    events = flows.with_event_ids(conform(landed(t, raw), feeds()["quakes"], F.current_timestamp()))
    folder = f"{shared_folder(t.spark)}/t1-{uuid.uuid4().hex}"
    sink = flows.two_sinks(lambda batch, epoch: None, flows.store_events(folder + "/table"))
    for attempt in ("one", "two"):
        flows.start(events, sink, f"{folder}/{attempt}", once=True).awaitTermination()
    return t.spark.read.parquet(folder + "/table").select("external_id", "severity")


@query("t2_changed_only_stream", ("geo",), CHANGES_SQL)
def t2(t: Tables) -> DataFrame:
    """A replay as one stream; an event of a later day than all others closes it, so that the watermark passes them."""
    rows = changes(t)
    last = rows.agg(F.max("event_time").alias("event_time")).select(
        *[(F.lit(END) if f.name == "id" else c("event_time") + F.make_dt_interval(days=F.lit(2)) if f.name == "event_time" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    )
    found = flows.drain(state.changed_only_stream(landed(t, rows.unionByName(last)), late="1 hour", idle_days=90))
    return found.filter(c("id") != END).select("id", "seq")


@query("t3_latest_position_stream", ("track",), """
    SELECT entity_id AS canonical_id, max(time) AS position_time, round(arg_max(lat, time), 6) AS lat, round(arg_max(lng, time), 6) AS lng, arg_max(velocity_ms, time) AS velocity_ms FROM track GROUP BY 1""")
def t3(t: Tables) -> DataFrame:
    rows = t.track.select(
        F.lit("vessel").alias("entity_type"), F.lit("mmsi").alias("canonical_id_type"), c("entity_id").alias("canonical_id"), F.lit(None).cast("string").alias("display_name"),
        F.create_map(F.lit("a"), F.lit("b")).alias("properties"), c("time").alias("event_time"), c("time").alias("position_time"), "lat", "lng", "velocity_ms", "heading_deg",
        F.lit(0.0).alias("altitude_m"),
    )
    folder = f"{shared_folder(t.spark)}/t3-{uuid.uuid4().hex}"
    flows.start(landed(t, rows), flows.merge_positions(folder + "/state"), folder + "/progress", once=True).awaitTermination()
    return flows.positions(t.spark, folder + "/state").select("canonical_id", "position_time", r6("lat"), r6("lng"), "velocity_ms")


@query("t4_alert_tail", ("finding",), "SELECT id FROM finding WHERE event_type IN ('port_call', 'usgs_quake') AND lat BETWEEN -40 AND 40 AND (lng >= 140 OR lng <= -120)")
def t4(t: Tables) -> DataFrame:
    rows = landed(t, t.finding.select("id", "event_type", "event_time", "lat", "lng"))
    return flows.drain(flows.alert_tail(rows, ["port_call", "usgs_quake"], (140.0, -40.0, -120.0, 40.0))).select("id")


@query("t5_near_duplicates_stream")
def t5(t: Tables) -> DataFrame:
    return flows.drain(state.near_duplicates_stream(landed(t, t.news), window_minutes=24 * 60))


@query("t5_filtered_news_stream", ("news",), T5_ROWS, T5_SQL)
def t5_filtered(t: Tables) -> DataFrame:
    folder = f"{shared_folder(t.spark)}/t5-{uuid.uuid4().hex}"
    flows.start(landed(t, t.news.drop("flags")), flows.filter_news(folder, 24 * 60), folder + "/progress", once=True).awaitTermination()
    return t.spark.read.parquet(folder + "/verdicts").select("event_id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


_EWMA = f"""RECURSIVE daily AS (SELECT *, row_number() OVER (PARTITION BY layer, region ORDER BY day) AS k FROM (
      SELECT layer, {region_sql()} AS region, CAST(date_diff('day', DATE '1970-01-01', CAST(event_time AS DATE)) AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n FROM geo GROUP BY 1, 2, 3)),
    base AS (
      SELECT layer, region, day, n, k, CAST(NULL AS DOUBLE) AS mean_before, CAST(NULL AS DOUBLE) AS std_before, n AS mean, 1.0::DOUBLE AS std FROM daily WHERE k = 1
      UNION ALL
      SELECT layer, region, day, n, k, m, s, 0.75 * m + 0.25 * n, greatest(1.0, sqrt(0.75 * s * s + 0.25 * pow(n - (0.75 * m + 0.25 * n), 2)))
      FROM (SELECT d.*, b.mean AS m, b.std AS s FROM daily d JOIN base b ON b.layer = d.layer AND b.region = d.region AND b.k + 1 = d.k))"""


@query("t6_baseline_stream", ("geo",), """
    SELECT layer, region, day AS cycle, CAST(n AS BIGINT) AS count, round(mean_before, 6) AS mean_before, round(std_before, 6) AS std_before, CAST(k - 1 AS INT) AS cycles_before FROM base""", _EWMA)
def t6(t: Tables) -> DataFrame:
    daily = t.geo.withColumns({"region": region_for(c("lat"), c("lng")), "cycle": F.unix_date(F.to_date("event_time")).cast("bigint")}).groupBy(
        "layer", "region", "cycle"
    ).agg(F.count(F.lit(1)).alias("count"))
    return flows.drain(state.baseline_stream(landed(t, daily))).select(
        "layer", "region", "cycle", "count", F.round("mean_before", 6).alias("mean_before"), F.round("std_before", 6).alias("std_before"), "cycles_before"
    )


@query("t7_watch_stream", ("geo",), "SELECT CAST(watch_id AS VARCHAR) AS watch_id, match_id FROM hit WHERE km <= radius", _WATCH)
def t7(t: Tables) -> DataFrame:
    rows = landed(t, t.geo.select("event_id", "event_time", "layer", "lat", "lng", "severity"))
    rules = watch_rules(watchlists(t), once=True)
    stored = flows.drain(flows.watch_rule_stream(rows, rules, late="60 days").select("_rule", "match_id"))
    return share_out(stored, rules).select("watch_id", "match_id")


@query("t8_silence_stream", ("track",), """
    SELECT entity_id, date_trunc('second', time) AS last_seen FROM (SELECT *, lead(time) OVER (PARTITION BY entity_id ORDER BY time) AS nxt, max(time) OVER () AS latest FROM track)
    WHERE velocity_ms > 0.5 AND (floor(epoch_us(nxt) / 1000) - floor(epoch_us(time) / 1000) >= 21600000 OR (nxt IS NULL AND time + INTERVAL 6 HOUR <= latest - INTERVAL 10 MINUTE))""")
def t8(t: Tables) -> DataFrame:
    rows = landed(t, t.track.select("entity_id", "time", "ping_id", "lat", "lng", "velocity_ms"))
    found = flows.drain(state.silent_vessels_stream(rows))
    return found.select("entity_id", F.date_trunc("second", "last_seen").alias("last_seen"))


@query("t10_detection_cycle")
def t10(t: Tables) -> DataFrame:
    fresh = {"fresh_minutes": FRESH_MIN}
    options = {
        "event_proximity": {"window_min": FRESH_MIN}, "entity_proximity": {"window_min": FRESH_MIN}, "port_calls": fresh, "port_arrivals": fresh, "port_departures": fresh,
        "military_flights": fresh, "zone_intrusions": fresh, "rendezvous": fresh, "listed_rendezvous": fresh, "sanctions_match": {"fresh_hours": 14 * 24},
        "loitering": {"lookback_hours": 240, "active_hours": 48},
    }
    events = t.finding.drop("event_id", "last_seen", "members", "user_id").withColumn("event_ids", F.lit(None).cast("array<string>"))
    inputs = Inputs(t.current, t.track, events, t.ports, R.zones_df(t.spark), t.listed, t.as_of, options)
    return totals(t.spark, inputs, run_cycle(inputs))


# ------------------------------------------------------------------ sanctions lists, over rows derived from parts
@query("r2_list_a", (), """
    SELECT CAST(p_partkey AS VARCHAR) AS listed_id, CASE p_partkey % 4 WHEN 0 THEN 'sanctioned_vessel' WHEN 1 THEN 'sanctioned_aircraft' WHEN 2 THEN 'sanctioned_entity' ELSE 'sanctioned_individual' END AS entity_type,
      split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS listed_name, CASE WHEN p_partkey % 3 = 0 THEN CAST(9000000 + p_partkey AS VARCHAR) END AS listed_imo,
      CASE WHEN p_partkey % 3 = 1 THEN CAST(200000000 + p_partkey AS VARCHAR) END AS listed_mmsi,
      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(split_part(p_brand, '#', 1)) || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ORDER' END END AS regime FROM part""")
def r2(t: Tables) -> DataFrame:
    i, p = c("p_partkey"), t.raw("part")
    key = i.cast("string")
    part_value = lambda n: F.struct(F.struct(F.split("p_name", " ")[n].alias("_text"), F.lit("215").alias("_ScriptID")).alias("NamePartValue"))
    alias = F.struct(F.lit("true").alias("_Primary"), F.array(F.struct(F.array(part_value(0), part_value(1)).alias("DocumentedNamePart"))).alias("DocumentedName"))
    identity = F.struct(F.concat(F.lit("I"), key).alias("_ID"), F.lit("true").alias("_Primary"), F.array(alias).alias("Alias"))
    parties = p.select(
        key.alias("_FixedRef"), F.struct(F.concat(F.lit("P"), key).alias("_ID"), (i % 4 + 1).cast("string").alias("_PartySubTypeID"), F.array(identity).alias("Identity")).alias("Profile")
    )
    documents = p.filter(i % 3 != 2).select(
        F.concat(F.lit("I"), key).alias("_IdentityID"), F.when(i % 3 == 0, lists.DOC_IMO).otherwise(lists.DOC_MMSI).alias("_IDRegDocTypeID"),
        F.when(i % 3 == 0, F.concat(F.lit("IMO "), (i + 9000000).cast("string"))).otherwise((i + 200000000).cast("string")).alias("IDRegistrationNo"),
    )
    brand = F.split("p_brand", "#")[0]
    bases = p.select(
        F.concat(F.lit("L"), key).alias("_ID"),
        F.when(i % 5 == 0, "Unknown").when(c("p_size") % 2 == 0, F.concat(F.lit("Executive Order 1 ("), brand, F.lit(")"))).otherwise(F.concat(brand, F.lit(" Order"))).alias("_LegalBasisShortRef"),
    )
    entries = p.select(F.concat(F.lit("P"), key).alias("_ProfileID"), F.array(F.struct(F.concat(F.lit("L"), key).alias("_LegalBasisID"))).alias("EntryEvent"))
    return lists.list_a(parties, documents, bases, entries).select("listed_id", "entity_type", "listed_name", "listed_imo", "listed_mmsi", "regime")


@query("r3_list_b", (), """
    SELECT CAST(g AS VARCHAR) AS listed_id, arg_min(p_name, p_partkey) AS listed_name, arg_min(imo, p_partkey) AS listed_imo, arg_min(p_type, p_partkey) AS regime FROM (
      SELECT *, p_partkey // 3 AS g, CASE WHEN p_partkey % 2 = 0 THEN CAST(9000000 + p_partkey AS VARCHAR) ELSE '' END AS imo FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0) GROUP BY g""")
def r3(t: Tables) -> DataFrame:
    i = c("p_partkey")
    n = lambda *names: [F.lit(None).cast("string").alias(x) for x in names]
    rows = t.raw("part").orderBy("p_partkey").select(
        F.floor(i / 3).cast("string").alias("GroupID"), F.when(i % 7 == 0, "Entity").otherwise("Ship").alias("GroupTypeDescription"),
        F.when(i % 11 == 0, "R").when(i % 2 == 0, "a").alias("GrpStatus"), F.split("p_name", " ")[0].alias("name1"), *n("name2", "name3", "name4", "name5"), F.split("p_name", " ")[1].alias("Name6"),
        F.when(i % 2 == 0, F.concat(F.lit("IMO-"), (i + 9000000).cast("string"))).otherwise("n/a").alias("Ship_IMONumber"), *n("Ship_Flag", "Ship_Type"), c("p_type").alias("RegimeName"), *n("UKSanctionsListRef"),
    )
    return lists.list_b(rows).select("listed_id", "listed_name", F.coalesce("listed_imo", F.lit("")).alias("listed_imo"), "regime")


@query("r4_list_c", (), """
    SELECT CAST(p_partkey AS VARCHAR) AS listed_id, CASE WHEN p_partkey % 3 = 0 THEN 'fr ' || p_name ELSE 'ru ' || p_name END AS listed_name, CAST(9000000 + p_partkey AS VARCHAR) AS listed_imo,
      CASE WHEN p_partkey % 2 = 0 THEN 'Russia' ELSE 'XYZ' END AS regime FROM part WHERE p_partkey % 4 <> 0""")
def r4(t: Tables) -> DataFrame:
    i = c("p_partkey")
    name = lambda lang: F.struct(F.concat(F.lit(lang + " "), c("p_name")).alias("_wholeName"), F.lit(lang).alias("_nameLanguage"))
    code = F.when(i % 4 == 0, "passport").otherwise("IMO")
    rows = t.raw("part").select(
        i.cast("string").alias("_logicalId"), F.lit("r").alias("_euReferenceNumber"), F.when(i % 3 == 0, F.array(name("ru"), name("fr"))).otherwise(F.array(name("ru"))).alias("nameAlias"),
        F.array(F.struct(code.alias("_identificationTypeCode"), F.concat(F.lit("no "), (i + 9000000).cast("string")).alias("_number"), F.lit("").alias("_latinNumber"))).alias("identification"),
        F.array(F.struct(F.when(i % 2 == 0, "RUS").otherwise("XYZ").alias("_programme"))).alias("regulation"),
    )
    return lists.list_c(rows).select("listed_id", "listed_name", "listed_imo", "regime")


