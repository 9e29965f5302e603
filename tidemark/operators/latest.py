"""Latest rows, top-k and change detection.

A latest row is an aggregate (`max_by`), not a window: it combines before the shuffle, so
an entity that holds a third of all rows costs one partial row per input task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import content_hash


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the greatest by the order columns, of which later ones break ties."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def current_entities(entities: DataFrame, track: DataFrame) -> DataFrame:
    """Entities with their latest position (time, lat, lng, velocity, heading, altitude)."""
    last = latest_by(
        track, ["entity_id"], ["time", "ping_id"],
        ["time", "lat", "lng", "velocity_ms", "heading_deg"],
    ).withColumnRenamed("time", "position_time")
    return entities.join(last, "entity_id")


def recent_max(track: DataFrame, since: Column, column: str = "velocity_ms") -> DataFrame:
    """Greatest value per entity over the pings since a moment."""
    return track.filter(F.col("time") >= since).groupBy("entity_id").agg(F.max(column).alias("recent_max"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark cuts to k per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def newest(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def changed_only(events: DataFrame) -> DataFrame:
    """Events whose coarse state differs from the previous one of the same id.

    The comparison needs each id's rows in time order. Ids with very long histories are
    cut by day; the last state before each day is carried in, so that no day starts blind.
    """
    state = content_hash(F.col("lat"), F.col("lng"), F.col("severity"), F.col("kind"), F.col("altitude_m"))
    rows = events.withColumn("_hash", state).withColumn("_day", F.to_date("event_time"))
    day_end = rows.groupBy("id", "_day").agg(
        F.max_by("_hash", F.struct("event_time", "seq")).alias("_last")
    )
    by_day = Window.partitionBy("id").orderBy("_day")
    carried = day_end.withColumn("_before", F.lag("_last").over(by_day)).select("id", "_day", "_before")
    within = Window.partitionBy("id", "_day").orderBy("event_time", "seq")
    previous = F.coalesce(F.lag("_hash").over(within), F.col("_before"))
    return (
        rows.join(carried, ["id", "_day"])
        .withColumn("_previous", previous)
        .filter(~F.col("_hash").eqNullSafe(F.col("_previous")))
        .drop("_hash", "_day", "_before", "_previous")
    )


def bounded_queue(events: DataFrame, max_depth: int = 500) -> DataFrame:
    """The `max_depth` highest priorities; of equal ones the earlier arrival stays."""
    return newest(events, [F.desc("priority"), F.asc("arrival")], max_depth)
