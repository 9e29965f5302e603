"""Aggregations: bucket statistics, time buckets, breakdowns, health, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounds import since
from tidemark.functions.geo import region_for
from tidemark.functions.scoring import at_least
from tidemark.functions.stats import round_even
from tidemark.operators.detectors.base import hours


def bucket_stats(events: DataFrame) -> DataFrame:
    """Count and severity statistics per (layer, region); rows without coordinates are left out."""
    severity = F.coalesce(F.col("severity"), F.lit(0)).cast("int")
    return (
        events.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer"), region_for(F.col("lat"), F.col("lng")).alias("region"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            round_even(F.avg(severity), 2).alias("avg_severity"),
            F.max(severity).alias("max_severity"),
            F.sum(severity).alias("sev_sum"),
        )
    )


def dashboard(events: DataFrame, subscriptions: DataFrame, categories: DataFrame, as_of: Column, window_hours: int = 24) -> DataFrame:
    """One row of conditional counts, from one pass over the events of the window."""
    levels = categories.select("event_type", "level")
    recent = since(events, as_of - hours(max(window_hours, 1))).join(levels, "event_type", "left")
    inside = F.col("event_time") >= as_of - hours(window_hours)
    signal = inside & F.col("level").isNotNull()
    critical = inside & (F.col("level") == "critical")
    subscribers = subscriptions.filter(F.col("verified") & F.col("unsubscribed_at").isNull()).agg(
        F.count(F.lit(1)).alias("subscribers")
    )
    return recent.agg(
        F.count_if(signal).alias("signals"),
        F.count_if(critical).alias("critical"),
        F.count_distinct(F.when(critical, F.col("entity_id"))).alias("open_cases"),
        F.count_if(signal & F.col("lat").isNotNull()).alias("geolocated"),
        F.count_distinct(F.when(F.col("event_time") >= as_of - hours(1), F.col("source_id"))).alias("sources"),
    ).withColumn("subscribers", subscribers.scalar())


def counts_by_type(events: DataFrame, as_of: Column, window_hours: int = 24, include_withdrawn: bool = False) -> DataFrame:
    rows = since(events, as_of - hours(window_hours))
    if not include_withdrawn:
        rows = rows.filter(~F.col("withdrawn"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))


def sanctions_breakdown(listed: DataFrame) -> DataFrame:
    """Entries per authority with totals per entity type and a sorted list of regimes."""
    kind, authority = F.col("entity_type"), F.coalesce("authority", F.lit("Unknown"))
    cells = listed.groupBy(kind.alias("entity_type"), authority.alias("authority"), "id_type", "regime").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = lambda t: F.sum(F.when(F.col("entity_type") == t, F.col("n")).otherwise(0))
    row = F.struct((-F.col("n")).alias("minus_n"), F.col("entity_type"), F.coalesce("regime", F.lit("")).alias("regime"))
    return (
        cells.groupBy("authority")
        .agg(
            F.min("id_type").alias("id_type"),
            total("sanctioned_vessel").alias("vessels"),
            total("sanctioned_aircraft").alias("aircraft"),
            F.array_sort(F.collect_list(row)).alias("regimes"),
        )
        .withColumn("total", F.col("vessels") + F.col("aircraft"))
        .orderBy(F.desc("total"), "authority")
    )


def time_buckets(events: DataFrame, categories: DataFrame, as_of: Column, window_hours: int = 24, bucket_min: int = 60) -> DataFrame:
    """Epoch-aligned buckets: total, counts per category (map) and per level; withdrawn rows count."""
    width = bucket_min * 60
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("event_time") / width) * width).alias("bucket")
    counts = (
        since(events, as_of - hours(window_hours))
        .groupBy(bucket, "event_type").agg(F.count(F.lit(1)).alias("n"))
        .join(categories, "event_type")
    )
    level = lambda name: F.sum(F.when(F.col("level") == name, F.col("n")).otherwise(0)).alias(name)
    return counts.groupBy("bucket").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "n")))).alias("by_category"),
        *[level(name) for name in ("critical", "high", "medium", "low")],
    )


def dense_series(events: DataFrame, types: list[str], start: Column, window_hours: int = 24, bucket_min: int = 60) -> DataFrame:
    """Counts per type on a zero-filled axis of buckets that starts at `start`."""
    spark, last = events.sparkSession, window_hours * 60 // bucket_min
    # The axis is (types x buckets) constants of the request, not data.
    axis = spark.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in types])).alias("event_type"), F.lit(0).alias("_")
    ).select("event_type", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("slot"))
    slot = F.floor((F.unix_micros("event_time") - F.unix_micros(start)) / (bucket_min * 60_000_000))
    counted = (
        since(events, start).filter(F.col("event_type").isin(*types))
        .groupBy("event_type", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.timestamp_micros(F.unix_micros(start) + F.col("slot") * (bucket_min * 60_000_000))
    return axis.join(counted, ["event_type", "slot"], "left").select(
        "event_type", at.alias("bucket"), F.coalesce("n", F.lit(0)).alias("n")
    )


def web_summary(hits: DataFrame, as_of: Column, window_hours: int = 24, approximate: bool = False) -> DataFrame:
    """Totals, unique visitors and the top paths, sources, referrers and countries, as (section, item, hits, uniques)."""
    rows = hits.filter(F.col("ts") > as_of - hours(window_hours))
    unique = (lambda c: F.approx_count_distinct(c)) if approximate else F.count_distinct
    view, signup = F.col("event_type") == "pageview", F.col("event_type") == "waitlist_signup"
    numbers = [F.count(F.lit(1)).alias("hits"), unique(F.col("visitor")).alias("uniques")]

    def section(name: str, where: Column, item: str, order: str, k: int) -> DataFrame:
        top = rows.filter(where).groupBy(F.col(item).alias("item")).agg(*numbers)
        return top.orderBy(F.desc(order), "item").limit(k).select(F.lit(name).alias("section"), "item", "hits", "uniques")

    total = rows.agg(*numbers).select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("item"), "hits", "uniques")
    return (
        total.unionByName(section("path", view, "path", "hits", 20))
        .unionByName(section("source", signup, "source", "hits", 10))
        .unionByName(section("referrer", view & (F.col("referrer") != ""), "referrer", "hits", 10))
        .unionByName(section("country", F.col("country") != "", "country", "uniques", 15))
    )


def visitor_hash(ip: Column, day: Column, salt: Column) -> Column:
    """Visitor id that cannot be joined across days."""
    return F.substring(F.sha2(F.concat_ws("|", ip, day.cast("string"), salt), 256), 1, 32)


def feed_health(feeds: DataFrame, as_of: Column, multiplier: float = 3.0) -> DataFrame:
    """Per feed: seconds since the last fetch, breach of its limit, and the resulting health."""
    poll, override = F.col("poll_interval_sec"), F.nullif(F.greatest(F.col("breach_override_sec"), F.lit(0.0)), F.lit(0.0))
    since = F.unix_seconds(as_of) - F.unix_seconds("last_fetch")
    limit = F.coalesce(override, F.greatest(F.lit(60.0), poll * multiplier))
    alive = F.unix_seconds(as_of) - F.unix_seconds("created_at")
    never = F.when(override.isNotNull() & F.col("created_at").isNotNull(), alive > override).otherwise(True)
    breach = F.when(F.coalesce(poll, F.lit(0.0)) <= 0, False).when(F.col("last_fetch").isNull(), never).otherwise(since > limit)
    health = F.lower(F.coalesce("health", F.lit("ok")))
    return feeds.select(
        "layer", since.alias("seconds_since_fetch"), breach.alias("sla_breach"),
        F.when(breach & (health == "ok"), "degraded").otherwise(health).alias("health"),
    )


def system_status(health: DataFrame) -> DataFrame:
    """Roll-up of feed health into one state."""
    ok, degraded = F.count_if(F.col("health") == "ok"), F.count_if(F.col("health") == "degraded")
    down = F.count_if(~F.col("health").isin("ok", "degraded"))
    return health.agg(
        ok.alias("ok"), degraded.alias("degraded"), down.alias("down"), F.count_if("sla_breach").alias("breaches"),
        F.when((down > 0) & (ok == 0), "down").when((degraded > 0) | (down > 0), "degraded").otherwise("ok").alias("status"),
    )


def audit_counts(findings: DataFrame) -> DataFrame:
    """Active and withdrawn findings per algorithm."""
    return findings.groupBy("event_type", "algorithm").agg(
        F.count_if(~F.col("withdrawn")).alias("active"), F.count_if("withdrawn").alias("withdrawn_rows")
    )


def article_density(articles: DataFrame, min_articles: int = 3) -> DataFrame:
    """Articles of countries with enough of them; the count gives the severity.

    An aggregate and a join instead of a window: one country may hold a third of the batch.
    """
    counts = articles.groupBy("country").agg(F.count(F.lit(1)).alias("article_count")).filter(
        F.col("article_count") >= min_articles
    ).withColumn("severity", at_least(F.col("article_count"), "articles"))
    return articles.join(counts, "country")


def prefilter_stats(judged: DataFrame) -> DataFrame:
    """Outcome per rule and reason."""
    return judged.groupBy("rule", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def shadow_matrix(judged: DataFrame) -> DataFrame:
    """Agreement of two configurations: pass and drop of one against the other."""
    verdict = lambda c: F.when(F.col(c).isNull(), "pass").otherwise("drop")
    return judged.groupBy(verdict("reject_reason").alias("main"), verdict("shadow_reason").alias("shadow")).agg(
        F.count(F.lit(1)).alias("n")
    )


def situation_facts(events: DataFrame, as_of: Column, window_hours: int = 24) -> DataFrame:
    """Per event type: count, highest severity and its title, longest darkness and loitering."""
    rows = since(events, as_of - hours(window_hours)).filter(~F.col("withdrawn"))
    number = lambda key: F.get_json_object("properties", f"$.{key}").try_cast("double")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("event_subtype").alias("subtypes"),
        F.max("severity").alias("max_severity"),
        F.max_by("title", F.struct("severity", "event_time", "id")).alias("top_title"),
        F.max(number("hours_dark")).alias("longest_dark_h"),
        F.max(number("span_hours")).alias("longest_loiter_h"),
    )


def situation_sentence(facts: DataFrame) -> DataFrame:
    return facts.select(
        "event_type",
        F.format_string("%d %s; highest severity %.1f: %s", F.col("n"), F.regexp_replace("event_type", "_", " "), "max_severity",
                        F.coalesce("top_title", F.lit("-"))).alias("sentence"),
    )


def ewma_baselines(cycles: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Baseline per (layer, region) after all its cycles, in cycle order.

    Each step uses the mean it has just updated for the deviation, and the standard
    deviation never falls below 1. Input has one count per bucket and cycle, i.e. it is an
    aggregate already; the fold runs over those numbers.
    """
    keep = 1 - alpha
    start = F.struct(
        F.element_at("counts", 1)["count"].cast("double").alias("mean"), F.lit(1.0).alias("std"), F.lit(0).alias("n")
    )

    def step(acc: Column, x: Column) -> Column:
        mean = keep * acc["mean"] + alpha * x["count"]
        deviation = x["count"] - mean
        std = F.sqrt(keep * acc["std"] * acc["std"] + alpha * deviation * deviation)
        return F.struct(mean.alias("mean"), F.greatest(F.lit(1.0), std).alias("std"), (acc["n"] + 1).alias("n"))

    ordered = cycles.groupBy("layer", "region").agg(
        F.array_sort(F.collect_list(F.struct("cycle", "count"))).alias("counts")
    )
    return ordered.select("layer", "region", F.aggregate("counts", start, step).alias("b")).select(
        "layer", "region", F.col("b.mean").alias("mean_count"), F.col("b.std").alias("std_count"), F.col("b.n").alias("n_cycles")
    )


def update_baselines(baselines: DataFrame, counts: DataFrame, alpha: float = 0.25) -> DataFrame:
    """One cycle's update; buckets without a count keep their baseline."""
    keep = 1 - alpha
    joined = baselines.join(counts.select("layer", "region", "count"), ["layer", "region"], "full_outer")
    old_mean, old_std = F.coalesce("mean_count", F.col("count").cast("double")), F.coalesce("std_count", F.lit(1.0))
    mean = keep * old_mean + alpha * F.col("count")
    std = F.greatest(F.lit(1.0), F.sqrt(keep * old_std * old_std + alpha * (F.col("count") - mean) * (F.col("count") - mean)))
    seen = F.col("count").isNotNull()
    return joined.select(
        "layer", "region",
        F.when(seen, mean).otherwise(F.col("mean_count")).alias("mean_count"),
        F.when(seen, std).otherwise(F.col("std_count")).alias("std_count"),
        (F.coalesce("n_cycles", F.lit(0)) + seen.cast("int")).alias("n_cycles"),
    )


def table_summary(name: str, table: DataFrame, time: str, as_of: Column) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(time) >= as_of - hours(1)).alias("last_hour"), F.max(time).alias("latest")
    ).select(F.lit(name).alias("table_name"), "*")


def digest_groups(items: DataFrame) -> DataFrame:
    """A subscriber's chosen items grouped by category, in the order of their best item."""
    entry = F.struct("position", "id", "title", "event_time")
    return items.groupBy("email", "category_id", "level").agg(
        F.min("position").alias("first_position"), F.count(F.lit(1)).alias("items"),
        F.max("category_total").alias("total"), F.array_sort(F.collect_list(entry)).alias("entries"),
    )


