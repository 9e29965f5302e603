"""The shape of a finding, and the anti-join that makes detectors idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounds import since

FINDING_COLUMNS = (
    "event_type", "event_subtype", "event_time", "lat", "lng", "severity", "title", "description",
    "domain", "decay_half_life_min", "entity_id", "entity_ids", "event_ids", "key", "algorithm",
    "properties",
)
FINDING_SCHEMA = (
    "event_type string, event_subtype string, event_time timestamp, lat double, lng double, "
    "severity double, title string, description string, domain string, decay_half_life_min int, "
    "entity_id string, entity_ids array<string>, event_ids array<string>, key string, "
    "algorithm string, properties string"
)


def hours(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n * 3600.0))


def minutes(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n * 60.0))


def age_hours(as_of: Column, at: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 3.6e9


def finding(
    rows: DataFrame,
    *,
    event_type: str,
    algorithm: str,
    subtype: Column,
    time: Column,
    severity: Column,
    title: Column,
    description: Column,
    key: Column,
    properties: dict[str, Column],
    entity_id: Column | None = None,
    entity_ids: Column | None = None,
    event_ids: Column | None = None,
    lat: str = "lat",
    lng: str = "lng",
    domain: Column | str = "maritime",
    decay_min: int = 1440,
) -> DataFrame:
    """Project candidate rows onto the finding columns; `key` identifies repeats."""
    own = F.col("entity_id") if entity_id is None else entity_id
    none = F.lit(None).cast("array<string>")
    columns = {
        "event_type": F.lit(event_type),
        "event_subtype": subtype,
        "event_time": time,
        "lat": F.col(lat),
        "lng": F.col(lng),
        "severity": severity.cast("double"),
        "title": title,
        "description": description,
        "domain": F.lit(domain) if isinstance(domain, str) else domain,
        "decay_half_life_min": F.lit(decay_min),
        "entity_id": own,
        "entity_ids": none if entity_ids is None else entity_ids,
        "event_ids": none if event_ids is None else event_ids,
        "key": key,
        "algorithm": F.lit(algorithm),
        "properties": F.to_json(F.struct(*[v.alias(k) for k, v in properties.items()])),
    }
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def not_found_before(
    found: DataFrame,
    prior: DataFrame | None,
    start: Column,
    event_types: tuple[str, ...] | None = None,
    algorithm: str | None = None,
    ignore_withdrawn: bool = False,
) -> DataFrame:
    """Drop findings whose (entity_id, key) occurs among earlier ones of the look-back.

    Withdrawn findings still suppress new ones unless `ignore_withdrawn` is set.
    """
    if prior is None:
        return found
    old = since(prior, start)
    if event_types:
        old = old.filter(F.col("event_type").isin(*event_types))
    if algorithm:
        old = old.filter(F.col("algorithm") == algorithm)
    if ignore_withdrawn:
        old = old.filter(F.get_json_object("properties", "$.withdrawn").isNull())
    seen = old.select(F.col("entity_id").alias("_e"), F.col("key").alias("_k")).distinct()
    same = F.col("entity_id").eqNullSafe(F.col("_e")) & F.col("key").eqNullSafe(F.col("_k"))
    return found.join(seen, same, "left_anti")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def metres(distance: Column) -> Column:
    return F.round(distance, 0).cast("bigint")


def text_of(value: Column, places: int) -> Column:
    """Fixed-point text, rounded half away from zero."""
    return F.format_string(f"%.{places}f", F.round(value.cast("double"), places))
