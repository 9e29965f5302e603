"""Streams from landed files or topics to tables, alerts and windows."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import in_bbox
from tidemark.operators.dedup import near_duplicates
from tidemark.operators.lineage import durable, shared_folder
from tidemark.operators.merge import MOTION, upsert_entities, with_event_ids
from tidemark.operators.watch import Rules, rule_matches, share_out, watch_rules
from tidemark.sources.feeds import Feed, conform, read
from tidemark.sources.sinks import _exists, append_events

log = logging.getLogger(__name__)


def feed_stream(spark: SparkSession, feed: Feed, path: str, late: str = "1 hour") -> DataFrame:
    """Landed files of a feed as a stream of conformed events with ids."""
    events = with_event_ids(conform(read(spark, feed, path, stream=True), feed, F.current_timestamp()))
    return events.withWatermark("event_time", late)


def two_sinks(deliver: Callable[[DataFrame, int], None], store: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A micro-batch goes to both sinks; delivery does not depend on the store.

    Each sink gets its try; the batch fails afterwards if one did, so that the stream
    retries it. Both sinks are idempotent, so a retry repeats nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        errors = []
        batch.persist()
        try:
            for name, sink in (("deliver", deliver), ("store", store)):
                try:
                    sink(batch, epoch)
                except Exception as error:  # noqa: BLE001 - reported below
                    log.exception("%s failed in batch %s", name, epoch)
                    errors.append((name, error))
        finally:
            batch.unpersist()
        if errors:
            raise RuntimeError(f"batch {epoch}: " + ", ".join(name for name, _ in errors)) from errors[0][1]

    return run


def store_events(path: str) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, epoch: int) -> None:
        append_events(batch.sparkSession, batch, path)

    return sink


POSITION_KEYS = ["entity_type", "canonical_id_type", "canonical_id"]
POSITIONS = (
    "entity_type string, canonical_id_type string, canonical_id string, display_name string, properties map<string,string>, last_seen timestamp, "
    "position_time timestamp, " + ", ".join(f"{c} double" for c in MOTION)
)


def _epochs(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The finished versions in a folder: those that a writer marked as complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(name + "=") and done(n))


def positions(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Latest state per entity of a table that `merge_positions` keeps, as of the epochs before `before`.

    The newest compacted base and the deltas after it; of an entity's rows the one of the
    latest epoch counts. `buckets` are those to open.
    """
    bases = [e for e in _epochs(spark, f"{path}/base", "upto") if before is None or e < before]
    base = bases[-1] if bases else -1
    deltas = [e for e in _epochs(spark, f"{path}/log", "epoch") if e > base and (before is None or e < before)]
    parts = [(f"{path}/base/upto={base}", base)] * bool(bases) + [(f"{path}/log/epoch={e}", e) for e in deltas]
    rows = empty_state(spark).withColumns({"bucket": F.lit(0), "_epoch": F.lit(-1)})
    for place, epoch in parts:
        part = spark.read.schema(POSITIONS + ", bucket int").parquet(place).withColumn("_epoch", F.lit(epoch))
        rows = rows.unionByName(part if buckets is None else part.filter(F.col("bucket").isin(*buckets)))
    rest = [c for c in rows.columns if c not in (*POSITION_KEYS, "_epoch", "bucket")]
    latest = rows.groupBy("bucket", *POSITION_KEYS).agg(F.max_by(F.struct(*rest), "_epoch").alias("_s"))
    return latest.select(*POSITION_KEYS, "_s.*", "bucket")


def merge_positions(path: str, buckets: int = 64, compact_every: int = 50) -> Callable[[DataFrame, int], None]:
    """Latest position per entity as a log: log/epoch=N holds only the entities that epoch N touched.

    An epoch opens the buckets of its entities, merges those, and writes their new rows, so what
    it writes follows the batch and not the table. Every `compact_every` epochs all that came
    before is written as one base, and what the base before it replaced goes. A retried epoch
    reads earlier epochs only and rewrites its own files, so it is idempotent; if the epoch
    before is missing it fails, as going on without it would lose entities.
    """
    home = F.pmod(F.xxhash64(*POSITION_KEYS), F.lit(buckets)).cast("int")

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [*_epochs(spark, f"{path}/base", "upto"), *_epochs(spark, f"{path}/log", "epoch")]
        if epoch and epoch - 1 not in done and not any(e >= epoch for e in done):
            raise RuntimeError(f"the version before epoch {epoch} is missing: {path}")
        rows = durable(batch.withColumn("arrival", F.unix_micros("event_time")).withColumn("bucket", home))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        old = positions(spark, path, epoch, touched).join(rows.select(*POSITION_KEYS).distinct(), POSITION_KEYS, "left_semi")
        new = upsert_entities(old.drop("bucket"), rows).withColumn("bucket", home)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/epoch={epoch}")
        if epoch and epoch % compact_every == 0:
            compact_positions(spark, path, epoch - 1)

    return sink


def compact_positions(spark: SparkSession, path: str, upto: int) -> None:
    """Write everything up to an epoch as one base. Readers that began before keep their files: only what an older base replaced goes."""
    older = [e for e in _epochs(spark, f"{path}/base", "upto") if e < upto]
    positions(spark, path, upto + 1).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={upto}")
    gone = [f"{path}/base/upto={e}" for e in older[:-1]]
    if older:
        gone += [f"{path}/log/epoch={e}" for e in _epochs(spark, f"{path}/log", "epoch") if e <= older[-1]]
    for place in gone:
        old = spark._jvm.org.apache.hadoop.fs.Path(place)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


NEWS = "event_id string, subcategory string, timestamp timestamp, title string, actor1_name string, actor2_name string, lat double, lng double"


def filter_news(folder: str, window_minutes: float = 60, threshold: float = 0.85, radius_km: float = 50) -> Callable[[DataFrame, int], None]:
    """Sink for news: verdicts (event_id, duplicate_of, similarity) of each micro-batch in folder/verdicts.

    A batch is judged as a table against the accepted events of the window before it, so its
    work spreads over tasks by chain and block of time and no key holds a subcategory. Accepted
    events are kept by epoch and day, of which only the days of the window are read; a retried
    epoch reads earlier epochs only and rewrites its own files.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = f"{folder}/accepted"
        columns = [x.split()[0] for x in NEWS.split(", ")]
        rows = durable(batch.select(*columns).filter(F.col("event_id").isNotNull()))
        first = rows.agg(F.min("timestamp").alias("t")).first()["t"]
        past = None
        if _exists(spark, kept) and first is not None:
            start = F.lit(first) - F.make_dt_interval(mins=F.lit(window_minutes).cast("int") + 1)
            past = spark.read.schema(NEWS + ", epoch int, day date").parquet(kept).filter((F.col("epoch") < epoch) & (F.col("day") >= start.cast("date")) & (F.col("timestamp") >= start))
        verdicts = durable(near_duplicates(rows, window_minutes, threshold, radius_km, past))
        news = rows.join(verdicts.filter("duplicate_of is null").select("event_id"), "event_id", "left_semi").withColumn("day", F.to_date("timestamp"))
        news.write.mode("overwrite").partitionBy("day").parquet(f"{kept}/epoch={epoch}")
        verdicts.write.mode("overwrite").parquet(f"{folder}/verdicts/epoch={epoch}")

    return sink


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSITIONS)


def alert_tail(events: DataFrame, types: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Findings of some types, optionally in a box. A stream source hands over late rows too."""
    rows = events.filter(F.col("event_type").isin(*types))
    return rows if box is None else rows.filter(in_bbox(F.col("lat"), F.col("lng"), *box))


def watch_rule_stream(events: DataFrame, rules: Rules, late: str = "1 day") -> DataFrame:
    """Stream of (rule, event) matches: each once while the watermark remembers the event.

    Repeats are dropped before rules are met, so the state follows the events and not their
    matches, of which an event has many. A report that comes again with another place or severity
    is one of its own. `share_out` gives the lists of a match, also after it has been stored: lists
    that ask for the same are written once.
    """
    rows = events.withWatermark("event_time", late).withColumns(
        {"event_layers": F.array("layer"), "match_id": F.concat_ws(":", "layer", F.col("event_id").cast("string"))}
    ).dropDuplicatesWithinWatermark(["match_id", "lat", "lng", "severity"])
    return rule_matches(rows, rules.rules).select("_rule", "match_id", "event_time", "severity", "distance_km")


def watch_stream(events: DataFrame, watchlists: DataFrame, late: str = "1 day") -> DataFrame:
    """Stream of (list, event) matches. A list of several circles gives a match by the first that holds the event."""
    rules = watch_rules(watchlists, once=True)
    return share_out(watch_rule_stream(events, rules, late), rules).select("watch_id", "match_id", "event_time", "severity", "distance_km")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width, slide), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity")
    )


def track_segments(track: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Track segments without a silence longer than the gap (works on streams and tables)."""
    return track.withWatermark("time", late).groupBy(F.session_window("time", gap), "entity_id").agg(
        F.count(F.lit(1)).alias("pings"), F.max("velocity_ms").alias("max_velocity")
    )


def start(stream: DataFrame, batch_sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "30 seconds"):
    writer = stream.writeStream.foreachBatch(batch_sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()



ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over everything that has landed, and read back what it wrote.

    Files and progress go to the shared folder, so any executor can read them.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/drain-{uuid.uuid4().hex}"
    # Custom state with timers and several variables needs this store; it also spills to disk.
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", folder + "/progress").option("path", folder + "/rows")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(folder + "/rows")
