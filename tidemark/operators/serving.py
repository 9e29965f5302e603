"""Read queries as parameterised DataFrames. Time bounds come first so that partitions prune."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import in_bbox
from tidemark.functions.stats import cosine_distance
from tidemark.functions.text import trigram_similarity
from tidemark.operators.bounds import Box, since, within
from tidemark.operators.detectors.base import hours
from tidemark.operators.latest import latest_by, newest, top_per_group
from tidemark.operators.merge import union_first
from tidemark.operators.spatial import radius_join
from tidemark.sources.refdata import RARE_TIER1_TYPES, TEXT_EVENT_TYPES


def _events_in(events: DataFrame, box: Box, start: Column, end: Column) -> DataFrame:
    return within(since(events, start, end).filter(~F.col("withdrawn")), box)


def viewport_entities(current: DataFrame, box: Box, start: Column, end: Column, types: list[str], limit: int = 1000) -> DataFrame:
    rows = current.filter(
        F.col("entity_type").isin(*types) & F.col("position_time").between(start, end) & in_bbox(F.col("lat"), F.col("lng"), *box)
    )
    return newest(rows, [F.desc("position_time"), F.asc("entity_id")], limit)


def viewport_events(events: DataFrame, box: Box, start: Column, end: Column, limit: int = 1000, listed_limit: int = 1000, rare_limit: int = 500) -> DataFrame:
    """The newest events, plus rare findings that newer ordinary events would crowd out."""
    rows = _events_in(events, box, start, end)
    order = [F.desc("event_time"), F.asc("id")]
    page = newest(rows, order, limit)
    listed = newest(rows.filter(F.col("event_type") == "sanctioned_vessel_underway"), order, listed_limit)
    rare = newest(rows.filter(F.col("event_type").isin(*RARE_TIER1_TYPES)), order, rare_limit)
    return union_first(page, listed.unionByName(rare), "id")


def entity_track(track: DataFrame, entity_id: str, as_of: Column, window_hours: int = 24, limit: int = 5000) -> DataFrame:
    rows = track.filter((F.col("entity_id") == entity_id) & (F.col("time") >= as_of - hours(window_hours)))
    return newest(rows, [F.desc("time"), F.desc("ping_id")], limit)


def entity_events(current: DataFrame, events: DataFrame, entity_id: str, as_of: Column, radius_m: float = 50_000, window_hours: int = 24, limit: int = 100) -> DataFrame:
    """Events near the latest position of one entity: a radius join with a single probing row."""
    one = current.filter(F.col("entity_id") == entity_id).select(F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"))
    rows = since(events, as_of - hours(window_hours))
    near = radius_join(one, rows, radius_m, ("at_lat", "at_lng"), ("lat", "lng"), hot_cell=None).drop("at_lat", "at_lng")
    return newest(near, [F.desc("event_time"), F.asc("id")], limit)


def membership(findings: DataFrame) -> DataFrame:
    """(id, member_id): the exploded form that replaces an array index."""
    return findings.select("id", F.explode("entity_ids").alias("member_id"))


def partners(findings: DataFrame, entities: DataFrame, entity_id: str, as_of: Column, window_hours: int = 24, types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Findings that contain an entity, each with its other members and their names."""
    rows = since(findings, as_of - hours(window_hours)).filter(F.array_contains("entity_ids", entity_id))
    return _with_partners(rows, entities, entity_id, types, limit)


def partners_of(membership: DataFrame, entities: DataFrame, entity_id: str, as_of: Column, window_hours: int = 24, types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The same from the table that `sinks.write_membership` keeps: one bucket is read, and in it the row groups of the member."""
    rows = membership.filter((F.col("member_id") == entity_id) & (F.col("event_time") >= as_of - hours(window_hours)))
    return _with_partners(rows.drop("member_id"), entities, entity_id, types, limit)


def _with_partners(rows: DataFrame, entities: DataFrame, entity_id: str, types: list[str] | None, limit: int) -> DataFrame:
    if types:
        rows = rows.filter(F.col("event_type").isin(*types))
    page = newest(rows, [F.desc("event_time"), F.asc("id")], limit)
    others = page.select("id", F.explode(F.filter("entity_ids", lambda x: x != entity_id)).alias("member_id"))
    named = others.join(
        entities.select(F.col("entity_id").alias("member_id"), "display_name", "entity_type", "canonical_id"), "member_id", "left"
    )
    entry = F.struct(
        F.col("display_name").isNull().alias("nameless"), "display_name", "member_id", "entity_type", "canonical_id"
    )
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("partners"))
    return page.join(lists, "id", "left")


def lookup_entity(entities: DataFrame, entity_type: str, id_type: str, canonical_id: str) -> DataFrame:
    return entities.filter(
        (F.col("entity_type") == entity_type) & (F.col("canonical_id_type") == id_type) & (F.col("canonical_id") == canonical_id)
    )


def similar_vectors(rows: DataFrame, seed: Column, limit: int = 10, exclude: Column | None = None) -> DataFrame:
    """Exact nearest rows by cosine distance; the seed is one vector (a literal or a scalar)."""
    near = rows.withColumn("_seed", seed).withColumn("distance", cosine_distance(F.col("embedding"), F.col("_seed"))).drop("_seed")
    if exclude is not None:
        near = near.filter(F.col("id") != exclude)
    return newest(near.filter(F.col("distance").isNotNull()), [F.asc("distance"), F.asc("id")], limit)


def similar_events(events: DataFrame, seed: Column, as_of: Column, within_days: int = 30, exclude: Column | None = None, limit: int = 10) -> DataFrame:
    recent = since(events, as_of - hours(24 * within_days))
    rows = recent.filter(F.col("event_type").isin(*TEXT_EVENT_TYPES) & F.col("embedding").isNotNull())
    return similar_vectors(rows, seed, limit, exclude)


def approximate_neighbours(rows: DataFrame, seed: list[float], limit: int = 10, tables: int = 8, bucket: float = 0.5):
    """Approximate version by random projections of normalised vectors; returns a DataFrame."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    vectors = rows.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>")))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(vectors)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(unit)
    norm = sum(x * x for x in seed) ** 0.5 or 1.0
    key = Vectors.dense([x / norm for x in seed])
    found = model.approxNearestNeighbors(unit, key, limit, distCol="euclid")
    return found.withColumn("distance", F.col("euclid") * F.col("euclid") / 2).drop("raw", "unit", "hashes", "euclid")


def signals_today(events: DataFrame, categories: DataFrame, as_of: Column, window_hours: int = 24, per_category: int = 10) -> DataFrame:
    """Newest findings per category with the category's true count."""
    rows = since(events, as_of - hours(window_hours)).filter(~F.col("withdrawn")).join(categories, "event_type")
    counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("category_count"))
    return top_per_group(rows, ["event_type"], [F.desc("event_time"), F.asc("id")], per_category).join(counts, "event_type")


def _may_reach(name: Column, text: str, floor: float) -> Column:
    """False only where the similarity is below the floor: too few letters of the text's grams occur in the name.

    Plain byte searches, so that grams are made of few names; a text beyond ASCII refuses none.
    """
    grams = {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", text.lower()) for i in range(len(w) + 1)}
    if not text.isascii() or not grams:
        return F.lit(True)
    low = F.lower(F.upper(name))
    shared = sum((F.contains(low, F.lit(g.strip())).cast("int") for g in sorted(grams)), F.lit(0))
    return F.coalesce(shared >= math.ceil(floor * len(grams) - 1e-9), F.lit(False))


def search_listed(listed: DataFrame, query: str, limit: int = 50, floor: float = 0.4) -> DataFrame:
    """Listed entries by IMO, similar name or part of the name, best first."""
    text = query.strip()
    imo = F.lit(text) if text.isdigit() and len(text) >= 6 else F.lit(None).cast("string")
    name = F.col("listed_name")
    same_imo = F.coalesce(F.col("listed_imo") == imo, F.lit(False))
    within = F.coalesce(F.contains(F.lower(name), F.lit(text.lower())), F.lit(False))
    may_hit = same_imo | within | _may_reach(name, text, floor)
    similarity = F.when(name.isNotNull() & may_hit, trigram_similarity(F.upper(name), F.lit(text.upper()))).otherwise(0.0)
    rows = listed.withColumn("similarity", similarity)
    fuzzy = F.col("similarity") >= floor
    kind = F.when(same_imo, "imo_match").when(fuzzy, "name_fuzzy").when(within, "name_substring")
    hit = same_imo | (F.lit(len(text) >= 4) & fuzzy) | within
    return rows.withColumn("match_kind", kind).filter(hit).orderBy(
        F.when(same_imo, 0).otherwise(1), F.desc_nulls_last("similarity"), "listed_name", "listed_id"
    ).limit(limit)


def listed_by_regime(listed: DataFrame, regime: str, limit: int = 200) -> DataFrame:
    rows = listed.filter(F.upper("regime") == regime.upper())
    return newest(rows, [F.asc("id_type"), F.asc("listed_name"), F.asc("listed_id")], limit)


def top_anomalies(anomalies: DataFrame, limit: int = 100) -> DataFrame:
    return newest(anomalies, [F.desc("anomaly_severity"), F.asc("layer"), F.asc("region")], limit)


def recent_alerts(events: DataFrame, types: list[str], as_of: Column, window_hours: int = 6, limit: int = 200) -> DataFrame:
    rows = since(events, as_of - hours(window_hours)).filter(F.col("event_type").isin(*types))
    return newest(rows, [F.desc("event_time"), F.asc("id")], limit)


def latest_per_subtype(events: DataFrame, event_type: str, limit: int = 2000) -> DataFrame:
    rows = latest_by(events.filter(F.col("event_type") == event_type), ["event_subtype"], ["event_time", "id"])
    return newest(rows, [F.asc("event_subtype")], limit)


def findings_by_algorithm(findings: DataFrame, algorithm: str, as_of: Column, window_hours: int = 24, limit: int = 100) -> DataFrame:
    rows = since(findings, as_of - hours(window_hours)).filter(F.col("algorithm") == algorithm)
    return newest(rows, [F.desc("event_time"), F.asc("id")], limit)


def events_in_box(events: DataFrame, box: Box, start: Column, end: Column, limit: int = 500) -> DataFrame:
    return newest(_events_in(events, box, start, end), [F.desc("event_time"), F.asc("id")], limit)


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def layer_top(events: DataFrame, layers: list[str], box: Box, k: int = 200) -> DataFrame:
    """Most severe events per layer inside a box that may cross the date line."""
    rows = events.filter(F.col("layer").isin(*layers) & in_bbox(F.col("lat"), F.col("lng"), *box))
    return top_per_group(rows, ["layer"], [F.desc_nulls_last("severity"), F.desc("event_time"), F.asc("event_id")], k)


def news_pins(events: DataFrame, limit: int = 200) -> DataFrame:
    """Most severe articles."""
    return newest(events, [F.desc_nulls_last("severity"), F.desc("event_time"), F.asc("event_id")], limit)
