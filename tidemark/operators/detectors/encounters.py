"""Detectors over pairs: proximity to events and entities, rendezvous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import chord, chord_limit, geodesic_of, unit_vector
from tidemark.operators.detectors.base import (
    age_hours, finding, hours, metres, minutes, not_found_before, pair_key, text_of,
)
from tidemark.operators.bounds import since
from tidemark.operators.latest import recent_max
from tidemark.operators.lineage import durable
from tidemark.operators.spatial import cell_of, cell_size_deg, explode_cells, prefixed, radius_join, salted, self_pairs

# Types this library derives itself; they never feed event proximity.
DERIVED_TYPES = (
    "detected_proximity", "rendezvous_detected", "dark_vessel_detected", "loitering_detected", "port_call",
    "port_arrival", "port_departure", "sanctioned_vessel_went_dark", "sanctioned_vessel_rendezvous",
    "sanctioned_vessel_underway", "sanctioned_port_arrival", "aircraft_in_sanctioned_airspace",
    "military_aircraft_underway", "shadow_fleet_cluster", "sanctioned_vessel_multijurisdictional",
)

FRAME = 256  # slots of the tolerance that share a row of the join of tracks


def _named(prefix: str = "") -> Column:
    kind, ident = F.col(prefix + "entity_type"), F.col(prefix + "canonical_id")
    return F.coalesce(F.col(prefix + "display_name"), F.concat_ws(" ", kind, ident))


def events_near(
    current: DataFrame, events: DataFrame, as_of: Column, radius_m: float = 50_000, window_min: int = 60, longest_decay_min: int | None = None,
) -> DataFrame:
    """Pairs of a fresh entity and a live event (source_*) near it that was not itself derived, with `distance_m`; no row cap.

    `longest_decay_min` is the longest decay in `events`, if the caller keeps it with the
    table; else one column of it is read to find it.
    """
    entities = current.filter(
        (F.col("position_time") >= as_of - minutes(window_min)) & (F.col("entity_type") != "satellite")
    ).select("entity_id", "entity_type", "canonical_id", "display_name", "lat", "lng", "position_time")
    life = F.make_dt_interval(mins=F.coalesce("decay_half_life_min", F.lit(window_min)))
    # No event outlives the longest decay, which bounds the days to read.
    longest = F.greatest(events.agg(F.coalesce(F.max("decay_half_life_min"), F.lit(0))).scalar(), F.lit(window_min))
    recent = since(events, as_of - F.make_dt_interval(mins=longest if longest_decay_min is None else F.lit(max(longest_decay_min, window_min))))
    live = recent.filter(~F.col("event_type").isin(*DERIVED_TYPES) & (F.col("event_time") >= as_of - life)).select(
        F.col("id").alias("source_id"), F.col("event_type").alias("source_type"), F.col("event_time").alias("source_time"),
        F.col("severity").alias("source_severity"), F.col("title").alias("source_title"),
        F.col("lat").alias("source_lat"), F.col("lng").alias("source_lng"),
    )
    return radius_join(entities, live, radius_m, ("lat", "lng"), ("source_lat", "source_lng"))


def event_proximity(
    current: DataFrame, events: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "proximity", radius_m: float = 50_000, window_min: int = 60, longest_decay_min: int | None = None,
) -> DataFrame:
    """The pairs of `events_near` as findings."""
    found = finding(
        events_near(current, events, as_of, radius_m, window_min, longest_decay_min),
        event_type="detected_proximity",
        algorithm=algorithm,
        subtype=F.concat_ws("_", "entity_type", "source_type"),
        time=F.greatest("position_time", "source_time"),
        severity=F.col("source_severity"),
        title=F.concat(
            F.col("entity_type"), F.lit(" "), F.coalesce("display_name", "canonical_id"), F.lit(" near "), F.col("source_title")
        ),
        description=F.concat(
            F.lit("Proximity finding: "), F.col("entity_type"), F.lit(" "), F.col("canonical_id"), F.lit(" within "),
            text_of(F.col("distance_m"), 0), F.lit(" m of event "), F.coalesce("source_title", F.lit("<untitled>")),
        ),
        key=F.col("source_id"),
        entity_ids=F.array("entity_id"),
        event_ids=F.array("source_id"),
        domain="geo",
        decay_min=60,
        properties={
            "radius_m": F.lit(int(radius_m)), "window_min": F.lit(window_min), "distance_m": metres(F.col("distance_m")),
        },
    )
    return not_found_before(found, prior, as_of - minutes(window_min), ("detected_proximity",), algorithm)


def entity_proximity(
    current: DataFrame, as_of: Column, prior: DataFrame | None = None, algorithm: str = "proximity_cross",
    radius_m: float = 50_000, window_min: int = 60,
) -> DataFrame:
    """Fresh entities of different types near each other; each pair once, satellites left out."""
    fresh = current.filter(
        (F.col("position_time") >= as_of - minutes(window_min)) & (F.col("entity_type") != "satellite")
    ).select("entity_id", "entity_type", "canonical_id", "display_name", "lat", "lng", "position_time")
    pairs = radius_join(
        prefixed(fresh, "a_"), prefixed(fresh, "b_"), radius_m, ("a_lat", "a_lng"), ("b_lat", "b_lng"),
        condition=F.col("a_entity_type") < F.col("b_entity_type"),
    )
    found = finding(
        pairs,
        event_type="detected_proximity",
        algorithm=algorithm,
        subtype=F.concat_ws("_", "a_entity_type", "b_entity_type"),
        time=F.greatest("a_position_time", "b_position_time"),
        severity=F.lit(None),
        title=F.concat(
            F.col("a_entity_type"), F.lit(" "), F.coalesce("a_display_name", "a_canonical_id"), F.lit(" near "),
            F.col("b_entity_type"), F.lit(" "), F.coalesce("b_display_name", "b_canonical_id"),
        ),
        description=F.concat(
            F.lit("Cross-entity proximity: "), F.col("a_entity_type"), F.lit(" "), F.col("a_canonical_id"),
            F.lit(" within "), text_of(F.col("distance_m"), 0), F.lit(" m of "), F.col("b_entity_type"), F.lit(" "),
            F.col("b_canonical_id"),
        ),
        key=pair_key(F.col("a_entity_id"), F.col("b_entity_id")),
        entity_id=F.lit(None).cast("string"),
        entity_ids=F.array("a_entity_id", "b_entity_id"),
        lat="a_lat",
        lng="a_lng",
        domain="geo",
        decay_min=60,
        properties={
            "pair_kind": F.lit("entity_to_entity"), "radius_m": F.lit(int(radius_m)), "window_min": F.lit(window_min),
            "distance_m": metres(F.col("distance_m")), "entity_types": F.array("a_entity_type", "b_entity_type"),
        },
    )
    return not_found_before(found, prior, as_of - minutes(window_min), ("detected_proximity",), algorithm)


def sustained_pairs(
    track: DataFrame, since: Column, radius_m: float, among: DataFrame | None = None, tolerance_s: int = 60,
    min_samples: int = 2, min_minutes: float = 20,
) -> DataFrame:
    """Pairs (a_entity_id < b_entity_id) that stayed close, over samples taken close in time; `among` holds the ids to look at.

    Pings meet by place and time, so what was near at another time never meets. A row of the join
    is an entity's pings in a cell and a frame of FRAME slots of the tolerance; the second entity's
    go into their own slot and both neighbours, and into all cells they reach, so every match meets
    exactly once. Samples are added up where they arise: few rows of a pair are shuffled.
    """
    tick = int(tolerance_s * 1_000_000)
    pings = track.filter((F.col("time") >= since) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "entity_id", "lat", "lng", F.unix_micros("time").alias("at")
    ).withColumn("slot", F.floor(F.col("at") / tick))
    if among is not None:
        pings = pings.join(among.select("entity_id"), "entity_id", "left_semi")
    size = cell_size_deg(2 * radius_m)
    place = unit_vector(F.col("lat"), F.col("lng"))
    ping = lambda side, *more: F.struct(*more, F.col("at").alias(side + "at"), *[v.alias(side + n) for n, v in zip("xyz", place)]).alias("ping")
    frame = F.floor(F.col("slot") / FRAME).alias("_frame")
    home = pings.select("entity_id", cell_of(F.col("lat"), F.col("lng"), size).alias("_cell"), frame, ping("a_", "slot"))
    near = pings.withColumn("slot", F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])))
    reach = explode_cells(near, ("lat", "lng"), radius_m, size).select("entity_id", "_cell", frame, "slot", ping("b_"))
    reach, home, keys = salted(reach, home, ["entity_id"])
    keys = [*keys, "_frame"]
    first = home.repartition(*keys).groupBy(*keys, F.col("entity_id").alias("a_entity_id")).agg(F.collect_list("ping").alias("a_pings"))
    second = reach.repartition(*keys).groupBy(*keys, F.col("entity_id").alias("b_entity_id"), "slot").agg(F.collect_list("ping").alias("pings"))
    second = second.groupBy(*keys, "b_entity_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "pings"))).alias("b_slots"))
    ids = ["a_entity_id", "b_entity_id"]
    met = first.join(second, keys).filter(F.col("a_entity_id") < F.col("b_entity_id")).select(*ids, "b_slots", F.inline("a_pings"))
    samples = met.select(*ids, "a_at", "a_x", "a_y", "a_z", F.inline(F.try_element_at("b_slots", F.col("slot"))))
    u, v = ([F.col(side + n) for n in "xyz"] for side in ("a_", "b_"))
    close = samples.filter(
        (F.abs(F.col("a_at") - F.col("b_at")) <= tick) & (chord(u, v) <= chord_limit(radius_m, 1.02)) & (geodesic_of(u, v) <= radius_m)
    )
    span = (F.max("a_at") - F.min("a_at")) / 6e7
    return (
        close.groupBy(*ids)
        .agg(F.count(F.lit(1)).alias("samples"), span.alias("span_minutes"))
        .filter((F.col("samples") >= min_samples) & (F.col("span_minutes") >= min_minutes))
    )


def entities_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a_entity_id", "b_entity_id")).alias("entity_id")).distinct()


def slow_movers(
    current: DataFrame, as_of: Column, types: tuple[str, ...], fresh_minutes: float = 30,
    min_velocity: float = 0.5, max_velocity: float = 3.0,
) -> DataFrame:
    return current.filter(
        F.col("entity_type").isin(*types)
        & (F.col("position_time") >= as_of - minutes(fresh_minutes))
        & F.col("velocity_ms").between(min_velocity, max_velocity)
    )


def rendezvous(
    current: DataFrame, track: DataFrame, as_of: Column, prior: DataFrame | None = None,
    algorithm: str = "rendezvous", radius_m: float = 1000, max_recent_velocity: float = 50.0,
    fresh_minutes: float = 30, recent_minutes: float = 30, track_minutes: float = 90,
    tolerance_s: int = 60, min_minutes: float = 20, dedup_hours: float = 24, **speeds,
) -> DataFrame:
    """Slow pairs that have stayed together, neither of which was fast shortly before."""
    movers = slow_movers(current, as_of, ("vessel", "aircraft"), fresh_minutes, **speeds).join(
        recent_max(track, as_of - minutes(recent_minutes)), "entity_id", "left"
    ).filter(F.col("recent_max").isNull() | (F.col("recent_max") <= max_recent_velocity))
    movers = durable(movers.select("entity_id", "entity_type", "canonical_id", "display_name", "lat", "lng", "velocity_ms"))
    pairs = durable(self_pairs(movers, "entity_id", radius_m))
    kept = sustained_pairs(
        track, as_of - minutes(track_minutes), radius_m, entities_of(pairs), tolerance_s=tolerance_s, min_minutes=min_minutes
    )
    rows = pairs.join(kept, ["a_entity_id", "b_entity_id"])
    d = F.col("distance_m")
    both = (F.col("a_entity_type") == "vessel") & (F.col("b_entity_type") == "vessel")
    found = finding(
        rows,
        event_type="rendezvous_detected",
        algorithm=algorithm,
        subtype=F.concat_ws("_", "a_entity_type", "b_entity_type"),
        time=as_of,
        severity=F.least(
            F.lit(10.0), F.when(d < 250, 9.0).when(d < 500, 8.0).otherwise(7.0) + F.when(both, 1.0).otherwise(0.0)
        ),
        title=F.concat(
            F.lit("Rendezvous: "), _named("a_"), F.lit(" near "), _named("b_"), F.lit(" ("), text_of(d, 0), F.lit("m)")
        ),
        description=F.concat(
            F.concat_ws(" ", "a_entity_type", "a_canonical_id"), F.lit(" and "),
            F.concat_ws(" ", "b_entity_type", "b_canonical_id"), F.lit(" are within "), text_of(d, 0),
            F.lit("m of each other; both at low velocity (a="), text_of(F.col("a_velocity_ms"), 1),
            F.lit(" m/s, b="), text_of(F.col("b_velocity_ms"), 1), F.lit(" m/s)"),
        ),
        key=pair_key(F.col("a_entity_id"), F.col("b_entity_id")),
        entity_id=F.col("a_entity_id"),
        entity_ids=F.array("a_entity_id", "b_entity_id"),
        lat="a_lat",
        lng="a_lng",
        properties={
            "pair_kind": F.concat_ws("_", "a_entity_type", "b_entity_type"),
            "a_canonical_id": F.col("a_canonical_id"), "a_display_name": F.col("a_display_name"),
            "a_velocity_ms": F.col("a_velocity_ms"), "b_canonical_id": F.col("b_canonical_id"),
            "b_display_name": F.col("b_display_name"), "b_velocity_ms": F.col("b_velocity_ms"),
            "distance_m": metres(d),
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("rendezvous_detected",), algorithm)
