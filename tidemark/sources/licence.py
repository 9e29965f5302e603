"""Licence gate: which feeds may contribute, decided by joins with the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(feeds: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """Adds `allowed` and the first refusal `reason` to feeds (feed, source_ids array).

    Every id of a compound feed must be registered, enabled and, in strict mode, licensed
    for commercial use.
    """
    ids = feeds.select("feed", F.posexplode_outer("source_ids").alias("position", "source_id"))
    joined = ids.join(registry, "source_id", "left")
    reason = (
        F.when(F.coalesce("source_id", F.lit("")) == "", "no_source_id")
        .when(F.col("enabled").isNull(), "not_registered")
        .when(~F.col("enabled"), "disabled")
    )
    if strict:
        reason = reason.when(~F.coalesce("commercial_use_ok", F.lit(False)), "not_commercial")
    refusal = joined.withColumn("_reason", reason).filter(F.col("_reason").isNotNull()).groupBy("feed").agg(
        F.min_by("_reason", F.coalesce("position", F.lit(-1))).alias("reason")
    )
    return feeds.join(refusal, "feed", "left").withColumn("allowed", F.col("reason").isNull())


def split(events: DataFrame, gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of allowed feeds, and the refused ones with their reason."""
    judged = events.join(gated.select("feed", "allowed", "reason"), "feed", "left")
    ok = F.coalesce("allowed", F.lit(False))
    refused = judged.filter(~ok).withColumn("reason", F.coalesce("reason", F.lit("not_registered")))
    return judged.filter(ok).select(*events.columns), refused.select(*events.columns, "reason")
