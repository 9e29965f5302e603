"""Port detectors: calls, arrivals and departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import geodesic_m
from tidemark.operators.bounds import since
from tidemark.operators.detectors.base import finding, hours, metres, minutes, not_found_before, text_of
from tidemark.operators.spatial import within_of_places

AT_PORT = ("port_call", "port_arrival")


def vessels_in_port(
    current: DataFrame, ports: DataFrame, as_of: Column, radius_m: float = 5000, fresh_minutes: float = 60,
    max_velocity: float = 1.5,
) -> DataFrame:
    vessels = current.filter(
        (F.col("entity_type") == "vessel")
        & (F.col("position_time") >= as_of - minutes(fresh_minutes))
        & (F.col("velocity_ms") < max_velocity)
    )
    return within_of_places(vessels, ports, radius_m)


def _port_finding(rows: DataFrame, event_type: str, algorithm: str, grave: float, plain: float, title, description, extra) -> DataFrame:
    return finding(
        rows,
        event_type=event_type,
        algorithm=algorithm,
        subtype=F.col("port_country"),
        time=F.col("position_time"),
        severity=F.when(F.col("port_kind") == "strategic", grave).otherwise(plain),
        title=title,
        description=description,
        key=F.col("port_id"),
        lat="port_lat",
        lng="port_lng",
        properties={
            "vessel_id": F.col("entity_id"), "vessel_canonical_id": F.col("canonical_id"),
            "vessel_name": F.col("display_name"), "port_id": F.col("port_id"), "port_name": F.col("port_name"),
            "port_country": F.col("port_country"), "port_kind": F.col("port_kind"),
            "distance_m": metres(F.col("distance_m")), **extra,
        },
    )


def port_calls(
    current: DataFrame, ports: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "port_call_v1", cooldown_hours: float = 7 * 24, **limits,
) -> DataFrame:
    """Vessels lying in port, at most once per vessel and port within the cooldown."""
    rows = vessels_in_port(current, ports, as_of, **limits)
    who = F.coalesce("display_name", "canonical_id")
    found = _port_finding(
        rows, "port_call", algorithm, 6.0, 3.0,
        title=F.concat(who, F.lit(" at "), F.col("port_name")),
        description=F.concat(
            F.lit("Vessel within "), text_of(F.col("distance_m"), 0), F.lit(" m of "), F.col("port_name"), F.lit(" ("),
            F.col("port_country"), F.lit("); v="), text_of(F.col("velocity_ms"), 1), F.lit(" m/s"),
        ),
        extra={"velocity_ms": F.round("velocity_ms", 2)},
    )
    return not_found_before(found, prior, as_of - hours(cooldown_hours), ("port_call",))


def port_arrivals(
    current: DataFrame, ports: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "port_arrival_v1", lookback_hours: float = 168, **limits,
) -> DataFrame:
    """Vessels in port without any call or arrival there within the look-back."""
    rows = vessels_in_port(current, ports, as_of, **limits)
    who = F.coalesce("display_name", "canonical_id")
    found = _port_finding(
        rows, "port_arrival", algorithm, 7.0, 4.0,
        title=F.concat(who, F.lit(" arrived at "), F.col("port_name")),
        description=F.concat(
            F.lit("Vessel newly within "), text_of(F.col("distance_m"), 0), F.lit(" m of "), F.col("port_name"),
            F.lit(" ("), F.col("port_country"), F.lit("); v="), text_of(F.col("velocity_ms"), 1),
            F.lit(" m/s; first port_call in window"),
        ),
        extra={"velocity_ms": F.round("velocity_ms", 2), "transition": F.lit("arrival")},
    )
    return not_found_before(found, prior, as_of - hours(lookback_hours), AT_PORT)


def port_departures(
    current: DataFrame, ports: DataFrame, as_of: Column, prior: DataFrame, algorithm: str = "port_departure_v1",
    radius_m: float = 5000, fresh_minutes: float = 60, lookback_hours: float = 36,
) -> DataFrame:
    """Vessels that were in port recently, still broadcast, and are now outside the radius."""
    recent = since(prior, as_of - hours(lookback_hours))
    was_in = recent.filter(F.col("event_type").isin(*AT_PORT) & F.col("entity_id").isNotNull()).groupBy("entity_id", F.col("key").alias("port_id")).agg(F.max("event_time").alias("last_at_port"))
    fresh = current.filter((F.col("position_time") >= as_of - minutes(fresh_minutes)) & F.col("lat").isNotNull())
    distance = geodesic_m(F.col("lat"), F.col("lng"), F.col("port_lat"), F.col("port_lng"))
    rows = was_in.join(fresh, "entity_id").join(ports, "port_id").withColumn("distance_m", distance)
    left = rows.filter(F.col("distance_m") > radius_m)
    # A departure before the look-back cannot be later than a visit within it.
    logged = recent.filter(F.col("event_type") == "port_departure").groupBy(
        "entity_id", F.col("key").alias("port_id")
    ).agg(F.max("event_time").alias("last_departure"))
    new = left.join(logged, ["entity_id", "port_id"], "left").filter(
        F.col("last_departure").isNull() | (F.col("last_departure") <= F.col("last_at_port"))
    )
    minutes_ago = F.floor((F.unix_seconds(as_of) - F.unix_seconds("last_at_port")) / 60)
    who = F.coalesce("display_name", "canonical_id")
    return _port_finding(
        new, "port_departure", algorithm, 7.0, 4.0,
        title=F.concat(who, F.lit(" departed "), F.col("port_name")),
        description=F.concat(
            F.lit("Vessel last at port "), minutes_ago.cast("string"), F.lit(" min ago; now "),
            text_of(F.col("distance_m"), 0), F.lit(" m from "), F.col("port_name"), F.lit(" ("), F.col("port_country"), F.lit(")"),
        ),
        extra={
            "last_at_port_ts": F.date_format("last_at_port", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "transition": F.lit("departure"),
        },
    )
