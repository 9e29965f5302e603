"""Keyed merges: idempotent event sinks, guarded entity upserts, unions with precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import event_id
from tidemark.operators.bounds import since
from tidemark.operators.latest import latest_by


def with_event_ids(events: DataFrame) -> DataFrame:
    return events.withColumn("id", event_id(F.col("event_type"), F.col("external_id")))


def insert_absent(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch that a table lacks, by (id, event_time); one per key within the batch."""
    keys = ["id", "event_time"]
    # The time range of the batch prunes the partitions of the table.
    span = batch.agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"))
    seen = since(existing, span.select("lo").scalar(), span.select("hi").scalar())
    return batch.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def insert_absent_by_id(existing: DataFrame, batch: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The same by id only, looking back a month: for feeds whose time stamps drift."""
    seen = since(existing, as_of - F.make_interval(days=F.lit(days)))
    first = latest_by(batch, ["id"], ["event_time"])
    return first.select(*batch.columns).join(seen.select("id").distinct(), "id", "left_anti")


MOTION = ("lat", "lng", "velocity_ms", "heading_deg", "altitude_m")


def upsert_entities(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge a batch into entity state, keyed by (entity_type, canonical_id_type, canonical_id).

    Names: the last arrival that has one wins. Properties merge in arrival order, newer
    arrivals win per key, even if their position is older. Motion and position time change
    only for a strictly newer position. `batch` has `arrival` (order of arrival) and
    `position_time`; `properties` is map<string,string>.
    """
    keys = ["entity_type", "canonical_id_type", "canonical_id"]
    names = batch.groupBy(*keys).agg(
        F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("arrival"))).alias("new_name"),
        F.max("position_time").alias("new_seen"),
    )
    # Newest value per property, aggregated per (entity, property): no list of all arrivals.
    props = (
        batch.select(*keys, "arrival", F.explode("properties").alias("k", "v"))
        .groupBy(*keys, "k").agg(F.max_by("v", "arrival").alias("v"))
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new_properties"))
    )
    earliest_of_ties = F.struct("position_time", (-F.col("arrival")).alias("first"))
    motion = batch.filter(F.col("position_time").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("position_time", *MOTION), earliest_of_ties).alias("new_motion")
    )
    new = names.join(props, keys, "left").join(motion, keys, "left")
    old = state.select(
        *keys, F.col("display_name").alias("old_name"), F.col("properties").alias("old_properties"),
        F.col("last_seen").alias("old_seen"), F.struct("position_time", *MOTION).alias("old_motion"),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old_p, new_p = (F.coalesce(c, empty) for c in ("old_properties", "new_properties"))
    newer = F.col("old_motion.position_time").isNull() | (
        F.col("new_motion.position_time") > F.col("old_motion.position_time")
    )
    moved = F.when(newer & F.col("new_motion").isNotNull(), F.col("new_motion")).otherwise(F.col("old_motion"))
    return (
        old.join(new, keys, "full_outer")
        .withColumn("_motion", moved)
        .select(
            *keys,
            F.coalesce("new_name", "old_name").alias("display_name"),
            F.map_concat(
                F.map_filter(old_p, lambda k, _: ~F.array_contains(F.map_keys(new_p), k)), new_p
            ).alias("properties"),
            F.greatest("old_seen", "new_seen").alias("last_seen"),
            "_motion.*",
        )
    )


def first_feed_wins(feeds: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of feeds in order of preference; the first feed that has a key supplies its row."""
    tagged = [f.withColumn("_feed", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, f in enumerate(feeds)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in (key, "_feed", "_row")]
    best = F.min_by(F.struct(*rest, "_feed"), F.struct("_feed", "_row")).alias("_best")
    valid = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return union.filter(valid).groupBy(key).agg(best).select(key, "_best.*").withColumnRenamed("_feed", "feed_rank")


def fill_missing(positions: DataFrame, static: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Left join that fills only what a position lacks; blank text counts as missing."""
    known = static.select(key, *[F.col(f).alias("_s_" + f) for f in fields])

    def blank(df: DataFrame, name: str, column: str) -> Column:
        is_text = dict(df.dtypes)[name] == "string"
        return F.nullif(F.trim(column), F.lit("")) if is_text else F.col(column)

    filled = [F.coalesce(blank(positions, f, f), blank(static, f, "_s_" + f)).alias(f) for f in fields]
    keep = [c for c in positions.columns if c not in fields]
    return positions.join(known, key, "left").select(*keep, *filled)


def union_first(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Main rows, then the extra rows whose key the main part lacks."""
    return main.unionByName(extra.join(main.select(key), key, "left_anti").select(*main.columns))


def merge_topics(articles: DataFrame) -> DataFrame:
    """Articles of one synthesised id as one row: topics as a set, the highest severity."""
    digest = lambda c: F.substring(F.md5(c), 1, 14)
    has_url = F.coalesce(F.trim("url"), F.lit("")) != ""
    ident = F.when(has_url, digest(F.trim("url"))).otherwise(digest(F.concat_ws("|", "country", "topic")))
    return (
        articles.withColumn("id", ident)
        .groupBy("id")
        .agg(
            F.array_sort(F.collect_set("topic")).alias("topics"),
            F.max("severity").alias("severity"),
            F.min_by("topic", "seq").alias("topic"),
            F.min_by("title", "seq").alias("title"),
        )
    )


def valid_at(attributes: DataFrame, at: Column) -> DataFrame:
    """Attribute values in force at a moment; of overlapping ones the latest start wins."""
    live = attributes.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return latest_by(live, ["entity_id", "attribute_name"], ["valid_from", "attribute_id"])


UNIT_S = 256  # seconds of the finest cell of the interval index
LEVELS = 25  # a cell of level k is 2 ** k units long; together they span the years 1834 to 2106
_ORIGIN_US = 1_000_000 << 32


def _unit(at: Column) -> Column:
    unit = F.floor((F.unix_micros(at.cast("timestamp")) + _ORIGIN_US) / F.lit(UNIT_S * 1_000_000)).cast("long")
    return F.when(at.isNotNull(), F.least(F.greatest(unit, F.lit(0).cast("long")), F.lit(1 << LEVELS)))


def interval_cells(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """`intervals` once for every aligned cell (`level`, `cell`) that makes up its inside, and for the units at its ends (level -1).

    An interval [start, end) without end lasts for ever. Its whole units fall into O(log n) cells
    of lengths 2 ** level, none of which overlap; only the units at its ends are covered in part.
    """
    first, last = _unit(F.col(start)), F.coalesce(_unit(F.col(end)), F.lit(1 << LEVELS))
    inside = F.expr(f"""
        flatten(transform(sequence(0, {LEVELS}), k -> filter(array(
          if(shiftright(_a + shiftleft(1L, k) - 1, k) < shiftright(_b, k) and shiftright(_a + shiftleft(1L, k) - 1, k) % 2 = 1,
             struct(k as level, shiftright(_a + shiftleft(1L, k) - 1, k) as cell), null),
          if(shiftright(_a + shiftleft(1L, k) - 1, k) < shiftright(_b, k) and shiftright(_b, k) % 2 = 1,
             struct(k as level, shiftright(_b, k) - 1 as cell), null)), x -> x is not null)))""")
    ends = F.transform(F.array_distinct(F.filter(F.array(first, F.when(F.col(end).isNotNull(), last)), lambda x: x.isNotNull())), lambda x: F.struct(F.lit(-1).alias("level"), x.alias("cell")))
    cells = F.explode(F.concat(inside, ends))
    return intervals.withColumns({"_a": first + 1, "_b": last}).withColumn("_c", cells).withColumns({"level": F.col("_c.level"), "cell": F.col("_c.cell")}).drop("_a", "_b", "_c")


def valid_at_events(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """The attribute values in force at each event of the same entity; of overlapping ones the latest start wins.

    Intervals are cut into aligned cells of time, and an event probes the one cell of each length
    that holds it: an equi-join on (entity, level, cell), in which an entity with much history
    and many events is many keys. All intervals of a cell cover the whole of it, so only their
    winner is kept: an event meets a row per attribute and level, however long the history. In
    the units at the ends of intervals the moments themselves are compared.
    """
    history = attributes.filter(F.col("valid_from").isNotNull()).select("entity_id", "attribute_name", "attribute_value", "valid_from", "valid_to", "attribute_id")
    cells = interval_cells(history, "valid_from", "valid_to")
    winner = F.max_by(F.struct("attribute_value", "valid_from", "valid_to", "attribute_id"), F.struct("valid_from", "attribute_id")).alias("w")
    key = ["entity_id", "attribute_name", "level", "cell"]
    inner = cells.filter("level >= 0").groupBy(*key).agg(winner).select(*key, "w.*")
    index = inner.unionByName(cells.filter("level < 0").select(*inner.columns))
    rows = events.select("entity_id", "event_id", "event_time")
    # Only lengths that occur are probed.
    levels = cells.select(F.array_sort(F.collect_set("level"))).scalar()
    probes = rows.withColumn("level", F.explode(levels)).withColumn("_u", _unit(F.col("event_time")))
    probes = probes.withColumn("cell", F.when(F.col("level") < 0, F.col("_u")).otherwise(F.expr("shiftright(_u, greatest(level, 0))"))).drop("_u")
    at = F.col("event_time")
    # Both sides are many times what they are read from, which is what the optimizer judges them by: neither is ever to be broadcast.
    live = probes.hint("merge").join(index, ["entity_id", "level", "cell"]).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return live.groupBy("event_id", "entity_id", "attribute_name").agg(
        F.max_by("attribute_value", F.struct("valid_from", "attribute_id")).alias("attribute_value")
    )


def code_lookup(rows: DataFrame, codes: DataFrame, unknown: str = "999") -> DataFrame:
    """Most specific known prefix (two characters at least) of `code`, else the unknown entry.

    The lookup runs over distinct codes only; `codes` has `code` and payload columns.
    """
    table = codes.withColumnRenamed("code", "matched_code")
    distinct = rows.select("code").distinct()
    prefixes = distinct.select(
        "code",
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("code"))),
                lambda i: F.substr("code", F.lit(1), i),
            )
        ).alias("matched_code"),
    )
    best = prefixes.join(table, "matched_code").groupBy("code").agg(
        F.max_by("matched_code", F.length("matched_code")).alias("matched_code")
    )
    resolved = distinct.join(best, "code", "left").withColumn(
        "matched_code", F.coalesce("matched_code", F.lit(unknown))
    )
    return rows.join(resolved, "code", "left").withColumn(
        "matched_code", F.coalesce("matched_code", F.lit(unknown))
    ).join(table, "matched_code", "left")
