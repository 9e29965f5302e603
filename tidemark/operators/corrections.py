"""Bulk withdrawal of findings with a reason.

Each rule flags the findings it withdraws; the rewrite adds `withdrawn` properties and keeps
the row. All rules of one statement look at the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detectors.encounters import DERIVED_TYPES

COHORT = 6


def prop(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def active(findings: DataFrame, event_type: str) -> DataFrame:
    return findings.filter((F.col("event_type") == event_type) & ~F.col("withdrawn"))


def receiver_downtime(findings: DataFrame) -> DataFrame:
    """Dark-vessel findings of seconds in which six or more entities fell silent."""
    rows = active(findings, "dark_vessel_detected").withColumn("_second", F.date_trunc("second", F.col("last_seen")))
    lost = rows.groupBy("_second").agg(F.count_distinct("entity_id").alias("cluster_size")).filter(F.col("cluster_size") >= COHORT)
    return rows.join(lost, "_second").select("id", F.lit("receiver_downtime_artifact").alias("reason"), "cluster_size")


def stale_pings(findings: DataFrame) -> DataFrame:
    """Loitering in a box of no extent while the reported speed is not small."""
    zero = (prop("lat_span_deg").try_cast("double") == 0) & (prop("lng_span_deg").try_cast("double") == 0)
    return active(findings, "loitering_detected").filter(zero & (prop("avg_velocity_ms").try_cast("double") > 1.0)).select(
        "id", F.lit("stale_pings_zero_bbox").alias("reason")
    )


def repeated_calls(findings: DataFrame, days: int = 7) -> DataFrame:
    """Port calls with an earlier call of the same vessel and port within a week.

    Distinct call times per (vessel, port) are compared with the one before; rows of equal
    time do not make each other repeats.
    """
    calls = active(findings, "port_call")
    keys = ["entity_id", "key"]
    times = calls.groupBy(*keys, "event_time").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("event_time").over(Window.partitionBy(*keys).orderBy("event_time"))
    repeats = times.withColumn("_before", before).filter(
        F.col("_before") >= F.col("event_time") - F.make_dt_interval(days=F.lit(days))
    )
    return calls.join(repeats.select(*keys, "event_time"), [*keys, "event_time"], "left_semi").select(
        "id", F.lit("pre_fix_24h_cooldown_excess_refire").alias("reason")
    )


def derived_proximity(findings: DataFrame) -> DataFrame:
    """Proximity to events that were themselves derived, told by the subtype."""
    ends = "(" + "|".join(t for t in DERIVED_TYPES if t != "detected_proximity") + ")$"
    derived = F.col("event_subtype").rlike("_" + ends) | F.col("event_subtype").rlike("_sanctioned_(vessel|port)_")
    return active(findings, "detected_proximity").filter(derived).select(
        "id", F.lit("proximity_algo_derived_match_fanout").alias("reason")
    )


def aircraft_pairs(findings: DataFrame) -> DataFrame:
    kinds = ("aircraft_aircraft", "aircraft_vessel", "vessel_aircraft")
    return active(findings, "rendezvous_detected").filter(F.col("event_subtype").isin(*kinds)).select(
        "id", F.lit("airport_taxi_or_arrival_departure").alias("reason")
    )


def test_leakage(findings: DataFrame, tag: str = "sanctioned_port_arrival_test") -> DataFrame:
    return active(findings, "sanctioned_port_arrival").filter(F.col("algorithm") == tag).select(
        "id", F.lit("test_fixture_leakage_into_production_db").alias("reason")
    )


def chained_clusters(findings: DataFrame, members: DataFrame, current: DataFrame, span_deg: float = 1.0) -> DataFrame:
    """Clusters whose members' current positions span more than a degree; `members` is (id, entity_id)."""
    at = current.filter(F.col("lat").isNotNull()).select("entity_id", "lat", "lng")
    spans = active(findings, "shadow_fleet_cluster").select("id").join(members, "id").join(at, "entity_id").groupBy("id").agg(
        (F.max("lat") - F.min("lat")).alias("lat_span"), (F.max("lng") - F.min("lng")).alias("lng_span")
    )
    return spans.filter((F.col("lat_span") > span_deg) | (F.col("lng_span") > span_deg)).select(
        "id", F.lit("dbscan_density_reachability_chain_bug").alias("reason")
    )


def withdraw(findings: DataFrame, flagged: DataFrame, at: Column, audit: str) -> DataFrame:
    """All findings, with the flagged ones marked; a finding flagged twice keeps the first reason."""
    reasons = flagged.groupBy("id").agg(F.min("reason").alias("_reason"))
    hit = F.col("_reason").isNotNull()
    note = F.to_json(F.struct(
        F.lit(True).alias("withdrawn"), F.col("_reason").alias("withdrawal_reason"), at.cast("string").alias("withdrawn_at"),
        F.lit(audit).alias("withdrawal_audit"),
    ))
    merged = F.when(F.col("properties").isNull() | (F.col("properties") == "{}"), note).otherwise(
        F.concat(F.regexp_replace("properties", "\\}$", ","), F.substr(note, F.lit(2)))
    )
    return findings.join(reasons, "id", "left").withColumns({
        "properties": F.when(hit, merged).otherwise(F.col("properties")),
        "withdrawn": F.col("withdrawn") | hit,
        "withdrawal_reason": F.col("_reason"),
    }).drop("_reason")
