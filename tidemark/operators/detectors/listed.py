"""Detectors that involve listed (sanctioned) vessels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounds import since
from tidemark.operators.detectors.base import (
    finding, hours, metres, minutes, not_found_before, pair_key, text_of,
)
from tidemark.operators.detectors.encounters import entities_of, slow_movers, sustained_pairs
from tidemark.operators.detectors.movement import dark_candidates
from tidemark.operators.latest import latest_by
from tidemark.operators.lineage import durable
from tidemark.operators.names import flag_consistent, flag_of, match_listed
from tidemark.operators.spatial import self_pairs
from tidemark.sources.refdata import IDENTITY_DIGITS

OWN = ["entity_id", "canonical_id", "display_name", "imo", "lat", "lng", "position_time"]
DEFAULT_AUTHORITY = "US Treasury OFAC"


def prop(name: str) -> Column:
    """A property of an earlier finding."""
    return F.get_json_object("properties", f"$.{name}")


def sanctions_matches(
    current: DataFrame, listed: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "sanctions_match", threshold: float = 0.9, fresh_hours: float = 24,
    dedup_hours: float = 30 * 24, identity_digits: dict[int, str] | None = IDENTITY_DIGITS,
) -> DataFrame:
    """Live vessels that match a list entry; name matches need a flag that fits the regime.

    `identity_digits` maps the first three digits of an identity to a flag; None leaves the rule out.
    """
    vessels = current.filter(
        (F.col("entity_type") == "vessel") & (F.col("position_time") >= as_of - hours(fresh_hours))
    ).select(*OWN)
    rows = match_listed(durable(vessels), listed, threshold)
    if identity_digits:
        fits = flag_consistent(flag_of(F.col("canonical_id"), identity_digits), F.col("regime"))
        rows = rows.filter((F.col("match_kind") == "imo") | fits)
    by_imo = F.col("match_kind") == "imo"
    name = F.coalesce("display_name", F.lit(""))
    found = finding(
        rows,
        event_type="sanctioned_vessel_underway",
        algorithm=algorithm,
        subtype=F.concat_ws("_", "match_kind", F.lit("match")),
        time=as_of,
        severity=F.when(by_imo, 10.0).otherwise(9.0),
        title=F.concat(
            F.lit("Sanctioned vessel underway: "), F.col("display_name"), F.when(by_imo, " [IMO match]").otherwise("")
        ),
        description=F.concat(
            F.lit("OFAC-SDN-sanctioned vessel "), name, F.lit(" (MMSI "), F.col("canonical_id"),
            F.lit(') is currently broadcasting AIS — matches OFAC entry "'), F.col("listed_name"), F.lit('" via '),
            F.col("match_kind"), F.coalesce(F.concat(F.lit(" (IMO "), F.col("imo"), F.lit(")")), F.lit("")),
        ),
        key=F.col("listed_id"),
        properties={
            "match_kind": F.col("match_kind"), "mmsi": F.col("canonical_id"), "live_vessel_name": F.col("display_name"),
            "listed_name": F.col("listed_name"), "sanctioned_canonical_id": F.col("listed_id"),
            "similarity": F.round("similarity", 3), "live_imo": F.col("imo"), "sanctioned_imo": F.col("listed_imo"),
            "similarity_threshold": F.lit(threshold),
            "sanctioning_authority": F.coalesce("authority", F.lit(DEFAULT_AUTHORITY)),
            "match_regime": F.col("regime"),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("sanctioned_vessel_underway",), algorithm)


def multi_authority(
    matches: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "sanctions_multijurisdictional", lookback_hours: int = 24, dedup_hours: float = 24,
) -> DataFrame:
    """Vessels that two or more authorities list, whatever position each match was seen at."""
    order = F.struct("event_time", "key")
    recent = since(matches, as_of - hours(lookback_hours)).filter(
        (F.col("event_type") == "sanctioned_vessel_underway") & F.col("entity_id").isNotNull() & F.col("lat").isNotNull()
    )
    rows = (
        recent.groupBy("entity_id")
        .agg(
            F.array_sort(F.collect_set(prop("sanctioning_authority"))).alias("authorities"),
            F.bool_or(F.col("event_subtype") == "imo_match").alias("any_imo"),
            F.max("event_time").alias("most_recent_match"),
            F.max_by(
                F.struct("lat", "lng", prop("live_vessel_name").alias("name"), prop("mmsi").alias("mmsi"),
                         prop("live_imo").alias("imo")),
                order,
            ).alias("last"),
        )
        .select("*", "last.*")
        .withColumn("authority_count", F.size("authorities"))
        .filter(F.col("authority_count") >= 2)
    )
    n = F.col("authority_count").cast("string")
    who = F.coalesce("name", F.concat(F.lit("MMSI "), "mmsi"))
    found = finding(
        rows,
        event_type="sanctioned_vessel_multijurisdictional",
        algorithm=algorithm,
        subtype=F.when(F.col("authority_count") >= 3, "tri_listed").otherwise("dual_listed"),
        time=as_of,
        severity=F.lit(10.0),
        title=F.concat(
            F.lit("CRITICAL — Sanctioned vessel underway, listed by "), n, F.lit(" authorities: "), who, F.lit(" ["),
            F.array_join("authorities", " + "), F.lit("]"),
        ),
        description=F.concat(
            F.lit("Live AIS vessel "), F.coalesce("name", "mmsi"), F.lit(" (MMSI "), F.col("mmsi"), F.lit(")"),
            F.coalesce(F.concat(F.lit(", IMO "), "imo"), F.lit("")), F.lit(" has been independently flagged by "), n,
            F.lit(" sanctioning authorities ("), F.array_join("authorities", ", "),
            F.lit(f") in the last {lookback_hours} hours."),
        ),
        key=F.array_join("authorities", "|"),
        properties={
            "mmsi": F.col("mmsi"), "live_vessel_name": F.col("name"), "live_imo": F.col("imo"),
            "authority_count": F.col("authority_count"), "authorities": F.col("authorities"),
            "any_imo_match": F.col("any_imo"), "most_recent_match": F.col("most_recent_match"),
            "multi_jurisdictional": F.lit(True),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("sanctioned_vessel_multijurisdictional",), algorithm)


def listed_and_dark(
    current: DataFrame, listed: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "sanctioned_dark_vessel", threshold: float = 0.9, dedup_hours: float = 24, **limits,
) -> DataFrame:
    """Listed vessels that went silent while moving; the receiver-cohort rule does not apply."""
    dark = durable(dark_candidates(current, as_of, **limits).select(*OWN, "velocity_ms", "hours_dark"))
    rows = match_listed(dark, listed, threshold)
    by_imo = F.col("match_kind") == "imo"
    found = finding(
        rows,
        event_type="sanctioned_vessel_went_dark",
        algorithm=algorithm,
        subtype=F.concat_ws("_", "match_kind", F.lit("match")),
        time=as_of,
        severity=F.lit(10.0),
        title=F.concat(
            F.lit("CRITICAL — Sanctioned vessel went dark: "),
            F.coalesce("display_name", F.concat(F.lit("MMSI "), "canonical_id")),
            F.when(by_imo, " [IMO match]").otherwise(""),
        ),
        description=F.concat(
            F.lit("OFAC-SDN sanctioned vessel "), F.coalesce("display_name", "canonical_id"), F.lit(" (MMSI "),
            F.col("canonical_id"), F.lit(") has gone dark on AIS for "), text_of(F.col("hours_dark"), 1),
            F.lit("h. Last position broadcast at "), F.col("position_time").cast("string"),
            F.lit('. OFAC SDN match: "'), F.col("listed_name"), F.lit('" via '), F.col("match_kind"), F.lit(" match."),
        ),
        key=F.col("listed_id"),
        properties={
            "match_kind": F.col("match_kind"), "mmsi": F.col("canonical_id"), "live_vessel_name": F.col("display_name"),
            "live_imo": F.col("imo"), "sanctioned_canonical_id": F.col("listed_id"),
            "sanctioned_name": F.col("listed_name"), "sanctioned_imo": F.col("listed_imo"),
            "last_seen_ais": F.col("position_time"), "hours_dark": F.round("hours_dark", 2),
            "last_velocity_ms": F.col("velocity_ms"), "sanctioning_authority": F.coalesce("authority", F.lit(DEFAULT_AUTHORITY)),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("sanctioned_vessel_went_dark",), algorithm)


def listed_rendezvous(
    current: DataFrame, listed: DataFrame, as_of: Column, prior: DataFrame | None = None,
    track: DataFrame | None = None, algorithm: str = "sanctioned_rendezvous", radius_m: float = 1000,
    threshold: float = 0.9, dedup_hours: float = 7 * 24, fresh_minutes: float = 30, sustained: bool = False, **speeds,
) -> DataFrame:
    """Slow vessels close together of which one or both are listed, attributed to the matching entry.

    With `sustained`, the pair must also have stayed together according to the track.
    """
    movers = durable(slow_movers(current, as_of, ("vessel",), fresh_minutes, **speeds).select(*OWN, "velocity_ms"))
    flags = match_listed(movers.select("entity_id", "display_name", "imo"), listed, threshold).groupBy("entity_id").agg(
        F.max(F.struct("listed_id", "listed_name")).alias("hit")
    )
    marked = durable(movers.join(flags, "entity_id", "left").select(
        *movers.columns, F.col("hit.listed_id").alias("listed_id"), F.col("hit.listed_name").alias("listed_name")
    ))
    pairs = self_pairs(
        marked, "entity_id", radius_m, condition=F.col("a_listed_id").isNotNull() | F.col("b_listed_id").isNotNull()
    )
    if sustained:
        kept = sustained_pairs(track, as_of - minutes(90), radius_m, entities_of(pairs))
        pairs = pairs.join(kept, ["a_entity_id", "b_entity_id"], "left_semi")
    a, b = F.col("a_listed_id").isNotNull(), F.col("b_listed_id").isNotNull()
    d = F.col("distance_m")
    who = lambda s: F.coalesce(s + "display_name", F.concat(F.lit("MMSI "), s + "canonical_id"))
    note = lambda s, hit: F.when(
        hit,
        F.concat(
            F.lit(f"Vessel {s[0].upper()} ("), F.coalesce(s + "display_name", s + "canonical_id"),
            F.lit(') matches OFAC SDN: "'), F.col(s + "listed_name"), F.lit('". '),
        ),
    ).otherwise("")
    side = lambda s, hit: {
        s + "mmsi": F.col(s + "canonical_id"), s + "name": F.col(s + "display_name"), s + "imo": F.col(s + "imo"),
        s + "sanctioned": hit, s + "sanctioned_canonical_id": F.col(s + "listed_id"),
        s + "sanctioned_name": F.col(s + "listed_name"), s + "velocity_ms": F.col(s + "velocity_ms"),
    }
    found = finding(
        pairs,
        event_type="sanctioned_vessel_rendezvous",
        algorithm=algorithm,
        subtype=F.when(a & b, "both_sanctioned").otherwise("one_sanctioned"),
        time=as_of,
        severity=F.when(a & b & (d < 500), 10.0).when(a & b, 9.0).when(d < 500, 9.0).otherwise(8.0),
        title=F.concat(
            F.lit("CRITICAL — Sanctioned vessel rendezvous: "), who("a_"), F.lit(" near "), who("b_"), F.lit(" ("),
            text_of(d, 0), F.lit("m)"), F.when(a & b, " [BOTH ON OFAC SDN]").otherwise(" [one on OFAC SDN]"),
        ),
        description=F.concat(
            F.lit("Vessels "), F.col("a_canonical_id"), F.lit(" and "), F.col("b_canonical_id"), F.lit(" are within "),
            text_of(d, 0), F.lit("m of each other at low velocity. "), note("a_", a), note("b_", b),
            F.lit("Velocities: a="), text_of(F.col("a_velocity_ms"), 1), F.lit(" m/s, b="),
            text_of(F.col("b_velocity_ms"), 1), F.lit(" m/s."),
        ),
        key=pair_key(F.col("a_entity_id"), F.col("b_entity_id")),
        entity_id=F.col("a_entity_id"),
        entity_ids=F.array("a_entity_id", "b_entity_id"),
        lat="a_lat",
        lng="a_lng",
        properties={**side("a_", a), **side("b_", b), "distance_m": metres(d)},
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("sanctioned_vessel_rendezvous",), algorithm)


def listed_port_arrivals(
    events: DataFrame, as_of: Column, prior: DataFrame | None = None, algorithm: str = "sanctioned_port_arrival",
    arrival_minutes: float = 60, match_minutes: float = 24 * 60, dedup_hours: float = 24,
) -> DataFrame:
    """Recent arrivals and calls of vessels whose latest list match is recent."""
    arrivals = since(events, as_of - minutes(arrival_minutes)).filter(
        F.col("event_type").isin("port_arrival", "port_call") & F.col("entity_id").isNotNull()
    ).select(
        "entity_id", "event_time", "lat", "lng", F.col("event_type").alias("arrival_kind"), F.col("key").alias("port_id"),
        *[prop(k).alias(k) for k in ("port_name", "port_country", "port_kind")],
    )
    hits = since(events, as_of - minutes(match_minutes)).filter(
        (F.col("event_type") == "sanctioned_vessel_underway") & F.col("entity_id").isNotNull()
    )
    fields = ("live_vessel_name", "mmsi", "sanctioning_authority", "match_regime", "match_kind", "sanctioned_imo", "live_imo")
    latest = latest_by(
        hits.select("entity_id", F.col("event_time").alias("match_time"), "key", *[prop(k).alias(k) for k in fields]),
        ["entity_id"], ["match_time", "key"],
    ).drop("key", "match_time")
    rows = arrivals.join(latest, "entity_id")
    country = F.coalesce("port_country", F.lit("??"))
    found = finding(
        rows,
        event_type="sanctioned_port_arrival",
        algorithm=algorithm,
        subtype=F.concat_ws(":", F.coalesce("match_regime", F.lit("UNKNOWN")), country),
        time=F.col("event_time"),
        severity=F.when(F.col("port_kind") == "strategic", 10.0).otherwise(8.0),
        title=F.concat(
            F.lit("CRITICAL — Sanctioned vessel "), F.coalesce("live_vessel_name", "mmsi"), F.lit(" at "), F.col("port_name")
        ),
        description=F.concat(
            F.lit("OFAC "), F.coalesce("match_regime", F.lit("sanctioned")), F.lit("-listed vessel "),
            F.coalesce("live_vessel_name", F.lit("unknown")), F.lit(" (MMSI "), F.coalesce("mmsi", F.lit("?")), F.lit(") "),
            F.when(F.col("arrival_kind") == "port_arrival", "arrived at ").otherwise("observed at "),
            F.col("port_name"), F.lit(" ("), country, F.lit(")"),
        ),
        key=F.col("port_id"),
        properties={
            "arrival_kind": F.col("arrival_kind"), "vessel_id": F.col("entity_id"), "vessel_name": F.col("live_vessel_name"),
            **{k: F.col(k) for k in fields[1:]},
            **{k: F.col(k) for k in ("port_id", "port_name", "port_country", "port_kind")},
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("sanctioned_port_arrival",))
