"""Cross-layer correlation by grid cell, and the audit of how often each rule fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import grid_index
from tidemark.functions.stats import binomial_upper_tail, round_even
from tidemark.operators.latest import top_per_group
from tidemark.sources.refdata import PAIR_RULES


def _cells(events: DataFrame, size_deg: float, bucket_hours: float | None) -> tuple[DataFrame, list[str]]:
    keys = ["cell_x", "cell_y"]
    rows = events.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns(
        {"cell_x": grid_index(F.col("lng"), size_deg), "cell_y": grid_index(F.col("lat"), size_deg)}
    )
    if bucket_hours is not None:
        rows = rows.withColumn("time_bucket", F.floor(F.unix_seconds("event_time") / (bucket_hours * 3600)))
        keys.append("time_bucket")
    return rows, keys


def _fired(layers: Column) -> Column:
    """Rules with both layers present, in rule order; the rule table has twenty rows."""
    rules = F.array(*[
        F.struct(F.lit(a).alias("layer_a"), F.lit(b).alias("layer_b"), F.lit(s).alias("severity"), F.lit(t).alias("rule"))
        for a, b, s, t in PAIR_RULES
    ])
    return F.filter(rules, lambda r: F.array_contains(layers, r["layer_a"]) & F.array_contains(layers, r["layer_b"]))


def correlations(events: DataFrame, size_deg: float = 5.0, min_layers: int = 2, bucket_hours: float | None = None) -> DataFrame:
    """Cells (optionally per time bucket) where several layers meet, with the rules that fire.

    Layers are few, so the set per cell is small; everything else is a combinable aggregate.
    """
    rows, keys = _cells(events, size_deg, bucket_hours)
    severity = F.coalesce(F.col("severity"), F.lit(0)).cast("int")
    cells = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("layer") != "", F.col("layer")))).alias("layers"),
        F.count(F.lit(1)).alias("event_count"),
        round_even(F.avg("lat"), 3).alias("center_lat"), round_even(F.avg("lng"), 3).alias("center_lng"),
        F.max(severity).alias("max_severity"),
    ).filter(F.size("layers") >= min_layers)
    fired = cells.withColumn("rules_fired", _fired(F.col("layers")))
    blend = F.least(F.lit(8), 2 + F.size("layers") + F.floor(F.col("max_severity") / 3).cast("int"))
    top = F.array_max(F.transform("rules_fired", lambda r: r["severity"]))
    return fired.withColumn("severity", F.coalesce(top, blend))


def correlation_samples(events: DataFrame, size_deg: float = 5.0, k: int = 6) -> DataFrame:
    rows, keys = _cells(events, size_deg, None)
    return top_per_group(rows, keys, [F.asc("event_time"), F.asc("event_id")], k).select(*keys, "rank", "layer", "event_id", "severity")


def rule_counts(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.explode("rules_fired.rule").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("k"))


def firing_audit(
    today: DataFrame, history: DataFrame, elevation_threshold: float = 3.0, p_threshold: float = 0.05, min_firings: int = 2
) -> DataFrame:
    """Per rule: today's rate against its history, with a one-sided binomial test."""
    total = lambda df: F.coalesce(df.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    n, hn = total(today), total(history)
    counts = rule_counts(today).withColumnRenamed("k", "today_firings").join(
        rule_counts(history).withColumnRenamed("k", "history_firings"), "rule", "full_outer"
    ).select(
        "rule", F.coalesce("today_firings", F.lit(0)).alias("today_firings"),
        F.coalesce("history_firings", F.lit(0)).alias("history_firings"), n.alias("today_total"), hn.alias("history_total"),
    )
    rate = lambda k, m: F.coalesce(F.col(k) / F.nullif(F.col(m), F.lit(0)), F.lit(0.0))
    rows = counts.withColumns({"rate": rate("today_firings", "today_total"), "base": rate("history_firings", "history_total")})
    elevation = F.when(F.col("rate") > 0, F.col("rate") / F.greatest(F.lit(1e-6), F.col("base"))).otherwise(0.0)
    p = F.when(F.col("today_total") > 0, binomial_upper_tail(F.col("today_firings"), F.col("today_total"), F.col("base"))).otherwise(1.0)
    rows = rows.withColumns({"lift": elevation, "p": p})
    flag = (F.col("today_firings") >= min_firings) & (F.col("lift") > elevation_threshold) & (F.col("p") < p_threshold)
    return rows.select(
        "rule", "today_firings", "today_total", round_even(F.col("rate"), 6).alias("today_rate"), "history_firings", "history_total",
        round_even(F.col("base"), 6).alias("baseline_rate"), round_even(F.col("lift"), 3).alias("elevation"), round_even(F.col("p"), 6).alias("p_value"),
        flag.alias("elevated"),
    )
