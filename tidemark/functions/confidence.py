"""Confidence of an event: a platform baseline plus additive evidence, clamped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scoring import mapped
from tidemark.functions.stats import clamp, round_even
from tidemark.sources.refdata import LAYER_PLATFORM, PLATFORM_BASELINE


@dataclass(frozen=True)
class Evidence:
    """Columns the score reads; literals do for what a feed does not carry."""

    platform: Column
    has_media: Column
    has_coordinates: Column
    precision_km: Column
    has_url: Column
    source_tier: Column
    verified: Column
    articles: Column
    other_sources: Column
    corroborated: Column
    age_hours: Column


def evidence(**given) -> Evidence:
    """Evidence with the neutral value for every factor that is not given."""
    neutral = dict(
        platform=F.lit(None).cast("string"), has_media=F.lit(False), has_coordinates=F.lit(False),
        precision_km=F.lit(50.0), has_url=F.lit(True), source_tier=F.lit(3), verified=F.lit(False),
        articles=F.lit(1), other_sources=F.lit(0), corroborated=F.lit(False), age_hours=F.lit(0.0),
    )
    return Evidence(**{**neutral, **given})


def factors(e: Evidence) -> Column:
    """Adjustment per factor as map<string,double>; factors of zero are left out."""
    p, n, a = e.precision_km, e.other_sources, e.articles
    parts = {
        "platform_baseline": mapped(e.platform, PLATFORM_BASELINE, 0.45),
        "has_media": F.when(e.has_media, 0.12),
        "coordinate_precision": F.when(
            e.has_coordinates, F.when(p <= 1, 0.15).when(p <= 10, 0.10).when(p <= 50, 0.05)
        ),
        "no_url": F.when(~e.has_url, -0.08),
        "source_tier": F.when(e.source_tier == 1, 0.15).when(e.source_tier == 2, 0.07),
        "verified_account": F.when(e.verified, 0.08),
        "article_count": F.when(a >= 10, 0.15).when(a >= 5, 0.10).when(a >= 3, 0.05),
        "cross_source": F.when(n >= 3, 0.20).when(n == 2, 0.14).when(n == 1, 0.08)
        .when(e.source_tier > 1, -0.08),
        "corroborated": F.when(e.corroborated, 0.12),
        "temporal_decay": -age_decay(e.age_hours),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in parts.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull() & (x["value"] != 0)))


def age_decay(age_hours: Column) -> Column:
    """Nothing in the first hour, then three linear pieces, flat after 72 h."""
    h = age_hours
    return round_even(
        F.when(h <= 1, 0.0)
        .when(h <= 6, 0.02 * (h - 1))
        .when(h <= 24, 0.10 + 0.01 * (h - 6))
        .otherwise(0.28 + 0.005 * F.least(h - 24, F.lit(48.0))),
        3,
    )


def score(factor_map: Column) -> Column:
    total = F.aggregate(F.map_values(factor_map), F.lit(0.0), lambda acc, v: acc + v)
    return round_even(clamp(total, 0.05, 0.98), 3)


def label(value: Column) -> Column:
    return (
        F.when(value >= 0.80, "CONFIRMED").when(value >= 0.65, "HIGH").when(value >= 0.50, "MODERATE")
        .when(value >= 0.35, "LOW").otherwise("SPECULATIVE")
    )


def severity_cap(value: Column) -> Column:
    """Highest severity an event of this confidence may show."""
    return (
        F.when(value >= 0.80, 10.0).when(value >= 0.65, 9.0).when(value >= 0.50, 7.0)
        .when(value >= 0.35, 5.0).otherwise(3.5)
    )


def platform_of(layer: Column) -> Column:
    return mapped(layer, LAYER_PLATFORM, None)
