"""Writers: partitioned tables, idempotent appends, snapshots and feeds, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bounds import DATE, PLACE, place_key, since
from tidemark.operators.detectors.base import hours
from tidemark.operators.latest import latest_by, newest
from tidemark.operators.merge import insert_absent
from tidemark.operators.records import authority, facts
from tidemark.sources.refdata import CATEGORIES, LEVEL_RANK

def append_events(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Insert what the table lacks, by (id, event_time). Running a batch again adds nothing."""
    fresh = batch if not _exists(spark, path) else insert_absent(spark.read.parquet(path).select(*batch.columns, DATE), batch)
    dated = fresh.dropDuplicates(["id", "event_time"]).withColumn(DATE, F.to_date("event_time"))
    # The hint lets adaptive execution split a busy day and merge small ones.
    dated.hint("rebalance", DATE, "event_type").write.mode("append").partitionBy(DATE, "event_type").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_by_place(events: DataFrame, path: str) -> None:
    """Events by day and, inside a day, in the order of a space-filling curve.

    Rows are dealt by ranges of (day, place), so a day with a third of all events is many tasks
    and files, and a harbour is a narrow stretch of one or a few of them. `bounds.within` reads it.
    """
    placed = events.withColumns({DATE: F.to_date("event_time"), PLACE: place_key(F.col("lat"), F.col("lng"))})
    placed.repartitionByRange(DATE, PLACE, F.xxhash64("id")).sortWithinPartitions(DATE, PLACE).write.mode("overwrite").partitionBy(DATE).parquet(path)


def write_membership(findings: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Findings once per member, in buckets by member, sorted by member and time: the index behind `serving.partners_of`.

    A row holds what the partner query returns, so reading one member opens one bucket and
    no other table. `buckets` is to grow with the table; a bucket is a file or a few.
    """
    rows = findings.withColumn("member_id", F.explode(F.array_distinct("entity_ids")))
    dealt = rows.repartition(buckets, "member_id")
    dealt.write.mode("overwrite").bucketBy(buckets, "member_id").sortBy("member_id", "event_time").option("path", path).saveAsTable(table)


def read_events(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Events of a time range; the partition predicate is derived from the bounds."""
    return since(spark.read.parquet(path), F.lit(start), F.lit(end))


def retained(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows inside the retention period (90 days for tracks and events, 30 for audit logs)."""
    return rows.filter(F.col(time) >= as_of - hours(24 * days))


def expired_partitions(spark: SparkSession, path: str, as_of_day: str, days: int) -> list[str]:
    """Partition folders past retention; dropping them needs no rewrite of data."""
    cut = spark.sql(f"SELECT date_sub(DATE '{as_of_day}', {int(days)})").first()[0].isoformat()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(DATE + "=") and n.split("=", 1)[1] < cut)


def drop_expired(spark: SparkSession, path: str, as_of_day: str, days: int) -> list[str]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    dropped = expired_partitions(spark, path, as_of_day, days)
    for name in dropped:
        folder = fs_path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return dropped


SNAPSHOT_COLUMNS = (
    "event_time_utc", "severity", "category", "event_type", "title", "description", "vessel_name", "mmsi", "imo", "icao24", "callsign",
    "hours_dark", "distance_m", "partner", "lat", "lng", "authority", "authority_canonical_id", "entity_id", "entity_url", "event_url",
)


def snapshot(events: DataFrame, as_of: Column, window_hours: int = 24, floor: str = "high", limit: int = 500, base: str = "") -> DataFrame:
    """The newest findings at or above a level, as 21 text columns; null cells are written empty."""
    wanted = [t for _, t, level in CATEGORIES if LEVEL_RANK[level] >= LEVEL_RANK[floor]]
    of_type = lambda i: F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c[1], c[i])])
    rows = since(events, as_of - hours(window_hours)).filter(F.col("event_type").isin(*wanted))
    page = newest(rows, [F.desc("event_time"), F.asc("id")], limit).withColumns({"f": facts(), "a": authority()})
    fact = lambda *keys: F.coalesce(*[F.try_element_at("f", F.lit(k)) for k in keys])
    names = F.from_json(F.when(F.col("event_type") == "shadow_fleet_cluster", fact("members")), "array<string>")
    values = {
        "event_time_utc": F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "severity": of_type(2)[F.col("event_type")], "category": of_type(0)[F.col("event_type")], "event_type": F.col("event_type"),
        "title": F.col("title"), "description": F.col("description"),
        "vessel_name": F.coalesce(F.get(names, F.lit(0)), fact("vessel", "entity_name", "a_name")), "mmsi": fact("mmsi", "a_mmsi"), "imo": fact("imo"),
        "icao24": fact("icao24"), "callsign": fact("callsign"), "hours_dark": fact("hours_dark", "duration_h"), "distance_m": fact("distance_m", "radius_m"),
        "partner": F.coalesce(F.nullif(F.array_join(F.slice(names, 2, 4), ", "), F.lit("")), fact("b_name")), "lat": F.col("lat").cast("string"), "lng": F.col("lng").cast("string"),
        "authority": F.col("a.name"), "authority_canonical_id": F.col("a.canonical_id"), "entity_id": F.col("entity_id"),
        "entity_url": F.concat(F.lit(base + "/entity/"), "entity_id"), "event_url": F.concat(F.lit(base + "/api/v1/event/"), "id"),
    }
    return page.select(*[values[c].alias(c) for c in SNAPSHOT_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header="true", lineSep="\r\n", emptyValue="", nullValue="", escape='"').csv(path)


def feed_items(events: DataFrame, as_of: Column, window_hours: int = 24, floor: str = "high", limit: int = 50) -> DataFrame:
    """The same selection as items of a JSON or RSS feed."""
    wanted = [t for _, t, level in CATEGORIES if LEVEL_RANK[level] >= LEVEL_RANK[floor]]
    rows = since(events, as_of - hours(window_hours)).filter(F.col("event_type").isin(*wanted))
    page = newest(rows, [F.desc("event_time"), F.asc("id")], limit)
    return page.select(
        F.col("id").alias("guid"), "title", "description", F.date_format("event_time", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
        F.col("event_type").alias("category"), F.to_json(facts()).alias("facts"),
    )


def write_json_feed(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def write_rss(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").format("xml").options(rootTag="channel", rowTag="item").save(path)


def geojson_features(events: DataFrame, event_type: str, per_subtype: bool = False, limit: int = 2000) -> DataFrame:
    """One GeoJSON feature per row as text: the newest of each subtype, or the newest of all."""
    rows = events.filter(F.col("event_type") == event_type)
    if per_subtype:
        rows = newest(latest_by(rows, ["event_subtype"], ["event_time", "id"]), [F.asc("event_subtype")], limit)
    else:
        rows = newest(rows, [F.desc("event_time"), F.asc("id")], limit)
    own = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    added = F.map_filter(
        F.create_map(
            F.lit("_event_id"), F.col("id"), F.lit("_event_time"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ssXXX"),
            F.lit("_event_subtype"), F.col("event_subtype"),
        ),
        lambda k, v: v.isNotNull(),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.map_concat(own, added).alias("properties"))
    return rows.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("id", F.to_json(feature).alias("feature"))
