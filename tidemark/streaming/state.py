"""Custom keyed state: change-only emission, near-duplicate windows, baselines, silence timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions.ids import content_hash
from tidemark.operators.dedup import GreedyWindow

HOUR_MS = 3_600_000
BUCKETS = 1024  # of ids that share a state; a batch rewrites the buckets that it touches


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value)).read_pandas()


def bucket_of(ident: str, buckets: int):
    """Key of a state that many ids share: what Python and the store say to each other is by bucket, not by id."""
    return F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int").alias("bucket")


class ChangeOnly(StatefulProcessor):
    """Emits an event when its coarse state differs from the last one of the id, in order of event time.

    The ids of a bucket share a state, in which many rows are one value. Rows wait in a buffer until the watermark has passed them,
    so one that comes late, but within the bound, takes its place before it is compared. An id that
    has been silent for `idle_ms` leaves the state altogether; its next event counts as new.
    """

    COLUMNS = ["id", "event_time", "seq", "severity"]

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")  # id, state_hash, at_ms
        self.waiting = handle.getListState("waiting", "rows binary")  # id, at_us, seq, severity, state_hash

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf[["id", "at_us", "seq", "severity", "state_hash"]] for pdf in rows]
        if parts:
            part = pd.concat(parts)
            self.waiting.appendValue((packed(part),))
            # One timer more for a row that is due before the others; when one fires, all that is due goes.
            self.handle.registerTimer(int(part["at_us"].min()) // 1000)
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = unpacked(self.last.get()[0]) if self.last.exists() else pd.DataFrame({"id": [], "state_hash": [], "at_ms": []})
        out = pd.DataFrame([], columns=self.COLUMNS)
        later = pd.DataFrame({"id": [], "at_us": []})
        if self.waiting.exists():
            held = pd.concat([unpacked(r[0]) for r in self.waiting.get()]).sort_values(["at_us", "seq", "severity", "state_hash"])
            due = held["at_us"] // 1000 <= now
            ready, later = held[due], held[~due]
            ready = ready.assign(at_ms=ready["at_us"] // 1000)
            rows = pd.concat([known.assign(new=False), ready.assign(new=True)])
            before = rows.groupby("id", dropna=False, sort=False)[["state_hash", "at_ms"]].shift()
            changed = (rows["state_hash"] != before["state_hash"]) | (rows["at_ms"] - before["at_ms"] >= self.idle_ms)
            out = rows[changed & rows["new"]]
            out = pd.DataFrame({"id": out["id"], "event_time": pd.to_datetime(out["at_us"].astype("int64"), unit="us"), "seq": out["seq"].astype("int64"), "severity": out["severity"].astype("int64")})
            known = rows.drop_duplicates("id", keep="last")[["id", "state_hash", "at_ms"]].astype({"at_ms": "int64"})
            self.waiting.clear()
            if len(later):
                self.waiting.appendValue((packed(later),))
        waits = known["id"].isin(later["id"])
        idle = known["at_ms"] + self.idle_ms
        known, idle = known[waits | (idle > now)], idle[~waits & (idle > now)]
        if len(known):
            self.last.update((packed(known),))
        elif self.last.exists():
            self.last.clear()
        following = [int(later["at_us"].min()) // 1000] if len(later) else []
        following += [int(idle.min())] if len(idle) else []
        if following:
            self.handle.registerTimer(min(following))
        yield out

    def close(self) -> None:
        pass


def changed_only_stream(events: DataFrame, late: str = "10 minutes", idle_days: float = 7, buckets: int = BUCKETS) -> DataFrame:
    """State per id is one hash and the rows of the last `late`; ids leave it after `idle_days` of silence."""
    state = content_hash(F.col("lat"), F.col("lng"), F.col("severity"), F.col("kind"), F.col("altitude_m"))
    rows = events.withWatermark("event_time", late).withColumns({"state_hash": state, "at_us": F.unix_micros(F.col("event_time").cast("timestamp")), "severity": F.coalesce("severity", F.lit(0)).cast("int")})
    rows = rows.select(bucket_of("id", buckets), "id", "event_time", "at_us", F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), "severity", "state_hash")
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ChangeOnly(int(idle_days * 24 * HOUR_MS)), outputStructType=StructType.fromDDL("id string, event_time timestamp, seq long, severity int"),
        outputMode="Append", timeMode="EventTime",
    )


class NearDuplicates(StatefulProcessor):
    """Greedy window per subcategory; the state is the accepted rows of one window only."""

    def __init__(self, window_minutes: float, threshold: float, radius_km: float) -> None:
        self.limits = (window_minutes * 60, threshold, radius_km)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "at double, event_id string, toks array<string>, lat double, lng double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = GreedyWindow(*self.limits)
        nan = float("nan")
        window.rows = [
            (r[0], r[1], frozenset(r[2]), nan if r[3] is None else r[3], nan if r[4] is None else r[4])
            for r in (self.accepted.get() if self.accepted.exists() else [])
        ]
        out = []
        for row in _rows(rows, ["at", "event_id"]).itertuples(index=False):
            lat, lng = (nan if v is None else float(v) for v in (row.lat, row.lng))
            out.append((row.event_id, *window.judge(row.at, row.event_id, row.toks, lat, lng)))
        if window.rows:
            self.accepted.put([(at, i, sorted(t), None if a != a else a, None if b != b else b) for at, i, t, a, b in window.rows])
        else:
            self.accepted.clear()
        yield pd.DataFrame(out, columns=["event_id", "duplicate_of", "similarity"])

    def close(self) -> None:
        pass


def near_duplicates_stream(events: DataFrame, window_minutes: float = 60, threshold: float = 0.85, radius_km: float = 50) -> DataFrame:
    from tidemark.functions.text import tokens

    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "actor1_name", "actor2_name", "subcategory")])
    rows = events.select(
        "subcategory", "event_id", (F.unix_micros("timestamp") / 1e6).alias("at"), F.array_sort(tokens(text)).alias("toks"), "lat", "lng"
    )
    return rows.groupBy("subcategory").transformWithStateInPandas(
        statefulProcessor=NearDuplicates(window_minutes, threshold, radius_km),
        outputStructType=StructType.fromDDL("event_id string, duplicate_of string, similarity double"), outputMode="Append", timeMode="None",
    )


class Baselines(StatefulProcessor):
    """Moving baseline per bucket; each row leaves with the baseline from before its update."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "mean double, std double, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.base.get()) if self.base.exists() else None
        out = []
        for row in _rows(rows, ["cycle"]).itertuples(index=False):
            mean, std, n = known or (None, None, 0)
            out.append((row.layer, row.region, int(row.cycle), int(row.count), mean, std, int(n)))
            base_mean, base_std = (float(row.count), 1.0) if known is None else (mean, std)
            new_mean = (1 - self.alpha) * base_mean + self.alpha * row.count
            variance = (1 - self.alpha) * base_std**2 + self.alpha * (row.count - new_mean) ** 2
            known = (new_mean, max(1.0, variance**0.5), n + 1)
        self.base.update(known)
        yield pd.DataFrame(out, columns=["layer", "region", "cycle", "count", "mean_before", "std_before", "cycles_before"])

    def close(self) -> None:
        pass


def baseline_stream(counts: DataFrame, alpha: float = 0.25) -> DataFrame:
    """`counts` has one row per (layer, region, cycle): an aggregate, so keys stay small."""
    return counts.select("layer", "region", "cycle", "count").groupBy("layer", "region").transformWithStateInPandas(
        statefulProcessor=Baselines(alpha),
        outputStructType=StructType.fromDDL(
            "layer string, region string, cycle long, count long, mean_before double, std_before double, cycles_before int"
        ),
        outputMode="Append", timeMode="None",
    )


class Silence(StatefulProcessor):
    """Fires for each silence of a number of hours of event time that begins while moving.

    A silence shows either as a gap between two pings or, if no ping follows, when the
    watermark passes the timer. Either way it fires once, however the batches fall. The entities
    of a bucket share a state and a timer.
    """

    COLUMNS = ["entity_id", "last_seen", "lat", "lng", "velocity_ms"]

    def __init__(self, silent_hours: float, min_velocity: float) -> None:
        self.silent_ms, self.min_velocity = int(silent_hours * HOUR_MS), min_velocity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")  # one row an entity, as they came

    def _known(self) -> pd.DataFrame | None:
        return unpacked(self.last.get()[0]) if self.last.exists() else None

    def _keep(self, known: pd.DataFrame) -> None:
        """The new state, and one timer for the entity that is silent first."""
        if len(known):
            self.last.update((packed(known),))
            self.handle.registerTimer(int(known["at_ms"].min()) + self.silent_ms)
        elif self.last.exists():
            self.last.clear()

    def _found(self, pings: pd.DataFrame) -> pd.DataFrame:
        """Those of the pings before a silence that were made while moving."""
        found = pings[pings["velocity_ms"] > self.min_velocity]
        return found.assign(last_seen=pd.to_datetime(found["at_ms"], unit="ms"))[self.COLUMNS]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        pings = _rows(rows, ["at_ms", "ping_id"])[["entity_id", "at_ms", "lat", "lng", "velocity_ms"]]
        if known is not None:
            at = known.set_index("entity_id")["at_ms"]
            pings = pd.concat([known, pings[~(pings["at_ms"] < pings["entity_id"].map(at))]])
        follows = pings.groupby("entity_id", dropna=False, sort=False)["at_ms"].shift(-1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._keep(pings.drop_duplicates("entity_id", keep="last"))
        yield self._found(pings[follows - pings["at_ms"] >= self.silent_ms])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known is None:
            yield pd.DataFrame([], columns=self.COLUMNS)
            return
        silent = known["at_ms"] + self.silent_ms <= timerValues.getCurrentWatermarkInMs()
        self._keep(known[~silent])
        yield self._found(known[silent])

    def close(self) -> None:
        pass


def silent_vessels_stream(track: DataFrame, silent_hours: float = 6, min_velocity: float = 0.5, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Candidates of the gone-dark detector as they arise; state is one row per entity."""
    rows = track.withWatermark("time", late).select(
        bucket_of("entity_id", buckets), "entity_id", "time", F.unix_millis("time").alias("at_ms"), "ping_id", "lat", "lng", F.coalesce("velocity_ms", F.lit(0.0)).alias("velocity_ms")
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Silence(silent_hours, min_velocity),
        outputStructType=StructType.fromDDL("entity_id string, last_seen timestamp, lat double, lng double, velocity_ms double"),
        outputMode="Append", timeMode="EventTime",
    )


def suppress_cohorts(found: DataFrame, cohort: int = 6) -> DataFrame:
    """Second stage on a micro-batch of silent vessels: drop those lost in a crowd of one second."""
    second = F.date_trunc("second", "last_seen")
    sizes = found.groupBy(second.alias("_s")).agg(F.count(F.lit(1)).alias("cohort_size"))
    return found.withColumn("_s", second).join(sizes, "_s").filter(F.col("cohort_size") < cohort).drop("_s")
