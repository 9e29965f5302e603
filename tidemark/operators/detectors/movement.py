"""Detectors over one entity's own track: gone dark, loitering, military flights, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import METRES_PER_DEGREE, bbox_span_m
from tidemark.functions.text import callsign_family
from tidemark.operators.detectors.base import age_hours, finding, hours, minutes, not_found_before, text_of
from tidemark.operators.spatial import within_zones

COHORT = 6  # vessels lost in one second point at a receiver, not at the vessels


def dark_candidates(
    current: DataFrame, as_of: Column, silent_hours: float = 6, max_silent_hours: float = 14 * 24, min_velocity: float = 0.5
) -> DataFrame:
    """Vessels silent for long enough, but not for too long, that were moving when last seen."""
    at = F.col("position_time")
    return current.filter(
        (F.col("entity_type") == "vessel")
        & (at < as_of - hours(silent_hours))
        & (at > as_of - hours(max_silent_hours))
        & (F.col("velocity_ms") > min_velocity)
        & F.col("lat").isNotNull()
    ).withColumn("hours_dark", age_hours(as_of, at))


def with_cohort(candidates: DataFrame) -> DataFrame:
    """Number of candidates per second of last contact, by aggregate and join (no window:
    a receiver failure may put a third of all vessels into one second)."""
    second = F.date_trunc("second", "position_time")
    sizes = candidates.groupBy(second.alias("_second")).agg(F.count(F.lit(1)).alias("cohort_size"))
    return candidates.withColumn("_second", second).join(sizes, "_second").drop("_second")


def dark_vessels(
    current: DataFrame, as_of: Column, prior: DataFrame | None = None, algorithm: str = "dark_ship", cohort: int = COHORT, **limits
) -> DataFrame:
    rows = with_cohort(dark_candidates(current, as_of, **limits)).filter(F.col("cohort_size") < cohort)
    h = F.col("hours_dark")
    found = finding(
        rows,
        event_type="dark_vessel_detected",
        algorithm=algorithm,
        subtype=F.when(h < 24, "short").when(h < 168, "medium").otherwise("long"),
        time=as_of,
        severity=F.least(F.lit(10.0), F.greatest(F.lit(1.0), h / 12)),
        title=F.concat(F.lit("Vessel went dark: "), F.coalesce("display_name", F.concat(F.lit("MMSI "), "canonical_id"))),
        description=F.concat(
            F.lit("Last AIS broadcast "), text_of(h, 1), F.lit("h ago (was moving at "),
            text_of(F.col("velocity_ms"), 1), F.lit(" m/s); MMSI "), F.col("canonical_id"),
        ),
        key=F.date_format("position_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        properties={
            "mmsi": F.col("canonical_id"), "last_seen_ais": F.col("position_time"), "hours_dark": F.round(h, 2),
            "last_velocity_ms": F.round("velocity_ms", 2), "last_heading_deg": F.col("heading_deg"),
            "cohort_size": F.col("cohort_size"),
        },
    )
    return not_found_before(found, prior, as_of - hours(30 * 24), ("dark_vessel_detected",), algorithm)


def loitering(
    current: DataFrame,
    track: DataFrame,
    as_of: Column,
    prior: DataFrame | None = None,
    algorithm: str = "loitering",
    lookback_hours: float = 8,
    min_span_hours: float = 4,
    min_pings: int = 5,
    radius_m: float = 1000,
    active_hours: float = 1,
    dedup_hours: float = 7 * 24,
) -> DataFrame:
    """Entities whose recent pings stay in a small box although they report movement."""
    active = current.filter(
        F.col("entity_type").isin("vessel", "aircraft") & (F.col("position_time") >= as_of - hours(active_hours))
    ).select("entity_id", "entity_type", "canonical_id", "display_name", "lat", "lng")
    # Pings are reduced to one row per entity before the entity table is joined.
    boxes = track.filter(F.col("time") >= as_of - hours(lookback_hours)).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("pings"),
        F.min("time").alias("first_ping"),
        F.max("time").alias("last_ping"),
        F.avg("velocity_ms").alias("avg_velocity"),
        (F.max("lat") - F.min("lat")).alias("lat_span"),
        (F.max("lng") - F.min("lng")).alias("lng_span"),
        F.avg("lat").alias("mean_lat"),
    )
    span_h = age_hours(F.col("last_ping"), F.col("first_ping"))
    limit = radius_m / METRES_PER_DEGREE
    rows = active.join(
        boxes.filter(
            (F.col("pings") >= min_pings)
            & (span_h >= min_span_hours)
            & (F.col("lat_span") <= limit)
            & (F.col("lng_span") * F.cos(F.radians("mean_lat")) <= limit)
            & (F.col("avg_velocity") > 0.2)
            & ~((F.col("lat_span") == 0) & (F.col("lng_span") == 0))
        ),
        "entity_id",
    )
    who = F.concat_ws(" ", "entity_type", "canonical_id")
    found = finding(
        rows,
        event_type="loitering_detected",
        algorithm=algorithm,
        subtype=F.col("entity_type"),
        time=as_of,
        severity=F.least(F.lit(10.0), F.greatest(F.lit(3.0), span_h / 2)),
        title=F.concat(F.lit("Loitering detected: "), F.coalesce("display_name", who)),
        description=F.concat(
            who, F.lit(" has stayed within a small bbox (~"),
            text_of(bbox_span_m(F.col("lat_span"), F.col("lng_span"), F.col("mean_lat")), 0), F.lit("m) for "),
            text_of(span_h, 1), F.lit("h ("), F.col("pings").cast("string"), F.lit(" pings, avg velocity "),
            text_of(F.col("avg_velocity"), 1), F.lit(" m/s)"),
        ),
        key=F.lit(""),
        domain=F.when(F.col("entity_type") == "vessel", "maritime").otherwise("aviation"),
        properties={
            "canonical_id": F.col("canonical_id"), "entity_type": F.col("entity_type"), "pings": F.col("pings"),
            "first_ping": F.col("first_ping"), "last_ping": F.col("last_ping"), "span_hours": F.round(span_h, 2),
            "lat_span_deg": F.round("lat_span", 5), "lng_span_deg": F.round("lng_span", 5),
            "avg_velocity_ms": F.col("avg_velocity"), "radius_threshold_m": F.lit(int(radius_m)),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("loitering_detected",), algorithm)


def military_flights(
    current: DataFrame, as_of: Column, prior: DataFrame | None = None, algorithm: str = "military_flights",
    fresh_minutes: float = 60, dedup_hours: float = 24,
) -> DataFrame:
    rows = current.filter(
        (F.col("entity_type") == "aircraft") & F.col("military") & (F.col("position_time") >= as_of - minutes(fresh_minutes))
    )
    name = F.col("display_name")
    found = finding(
        rows,
        event_type="military_aircraft_underway",
        algorithm=algorithm,
        subtype=callsign_family(name),
        time=as_of,
        severity=F.lit(5.0),
        title=F.concat(F.lit("Military aircraft underway: "), F.coalesce(name, F.concat(F.lit("ICAO "), "canonical_id"))),
        description=F.concat(
            F.lit("Military aircraft (ICAO "), F.col("canonical_id"), F.lit(") broadcasting ADS-B"),
            F.coalesce(F.concat(F.lit(" as "), name), F.lit("")), F.lit(". Origin: "),
            F.coalesce("origin_country", F.lit("unknown")),
        ),
        key=F.lit(""),
        domain="aviation",
        properties={
            "icao24": F.col("canonical_id"), "callsign": name, "origin_country": F.col("origin_country"),
            "last_seen": F.col("position_time"), "lookback_min": F.lit(fresh_minutes),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("military_aircraft_underway",), algorithm)


def zone_intrusions(
    current: DataFrame, zones: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "sanctioned_airspace", fresh_minutes: float = 60, dedup_hours: float = 24,
) -> DataFrame:
    aircraft = current.filter(
        (F.col("entity_type") == "aircraft") & (F.col("position_time") >= as_of - minutes(fresh_minutes))
    )
    rows = within_zones(aircraft, zones)
    name = F.col("display_name")
    found = finding(
        rows,
        event_type="aircraft_in_sanctioned_airspace",
        algorithm=algorithm,
        subtype=F.col("zone"),
        time=as_of,
        severity=F.col("zone_severity"),
        title=F.concat(
            F.lit("Aircraft in sanctioned airspace: "), F.coalesce(name, F.concat(F.lit("ICAO "), "canonical_id")),
            F.lit(" over "), F.col("zone"),
        ),
        description=F.concat(
            F.lit("Aircraft (ICAO "), F.col("canonical_id"), F.lit(") currently broadcasting from sanctioned airspace: "),
            F.col("zone"), F.coalesce(F.concat(F.lit(" as "), name), F.lit("")), F.lit(". Origin: "),
            F.coalesce("origin_country", F.lit("unknown")), F.lit(". Mil flag: "),
            F.coalesce(F.col("military").cast("string"), F.lit("false")),
        ),
        key=F.col("zone"),
        domain="aviation",
        properties={
            "icao24": F.col("canonical_id"), "callsign": name, "zone": F.col("zone"),
            "origin_country": F.col("origin_country"), "military": F.col("military"),
            "last_seen": F.col("position_time"), "lat": F.col("lat"), "lng": F.col("lng"),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("aircraft_in_sanctioned_airspace",), algorithm)
