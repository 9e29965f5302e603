"""News prefilter: an ordered chain of rejections and a priority score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geo import in_bbox
from tidemark.functions.scoring import mapped
from tidemark.functions.stats import clamp, linear_decay
from tidemark.sources.refdata import PRECISION_LEVELS


@dataclass(frozen=True)
class PrefilterRules:
    """Configuration of the chain; the defaults are those of the reference configuration."""

    mode: str = "allow"
    subcategories: tuple[str, ...] = ()
    flags_required: tuple[str, ...] = ()
    flags_blocked: tuple[str, ...] = ()
    min_severity: float = 0.6
    category_severity: dict[str, float] = field(default_factory=dict)
    precision_min: str = "region"
    bboxes: tuple[tuple[float, float, float, float], ...] = ()
    iso_allow: tuple[str, ...] = ()
    iso_block: tuple[str, ...] = ()
    min_source_score: float = 0.5
    max_age_hours: float = 6.0


def reject_reason(rules: PrefilterRules, as_of: Column, source_score: Column) -> Column:
    """Reason of the first rule that fails, in rule order, or null for an accepted event."""
    return F.coalesce(
        _category(rules),
        F.when(
            F.col("severity") < mapped(F.col("category"), rules.category_severity, rules.min_severity)
            if rules.category_severity else F.col("severity") < rules.min_severity,
            "severity_below_threshold",
        ),
        _geography(rules),
        F.when(source_score < rules.min_source_score, "source_quality_below_min"),
        F.when(hours_between(as_of, F.col("timestamp")) > rules.max_age_hours, "event_too_old"),
    )


def rule_of(reason: Column) -> Column:
    return (
        F.when(reason.isin("category_not_allowed", "category_blocked", "flag_required_missing", "flag_blocked"), "category")
        .when(reason == "severity_below_threshold", "severity")
        .when(reason == "source_quality_below_min", "source_quality")
        .when(reason == "event_too_old", "recency")
        .when(reason == "duplicate", "dedup")
        .when(reason.isNotNull(), "geography")
    )


def _category(rules: PrefilterRules) -> Column:
    listed = F.col("subcategory").isin(*rules.subcategories) if rules.subcategories else F.lit(False)
    wrong = ~listed if rules.mode == "allow" else listed
    out = F.when(wrong, "category_not_allowed" if rules.mode == "allow" else "category_blocked")
    names = lambda flags: F.array(*[F.lit(f) for f in flags])
    if rules.flags_required:
        missing = F.size(F.array_except(names(rules.flags_required), F.col("flags"))) > 0
        out = out.when(missing, "flag_required_missing")
    if rules.flags_blocked:
        out = out.when(F.arrays_overlap(names(rules.flags_blocked), F.col("flags")), "flag_blocked")
    return out


def _geography(rules: PrefilterRules) -> Column:
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECISION_LEVELS]), F.col("geocode_quality"))
    out = F.when(rank == 0, "geocode_quality_unrecognized").when(
        rank > PRECISION_LEVELS.index(rules.precision_min) + 1, "geocode_below_precision_floor"
    )
    iso = F.upper(F.nullif(F.col("iso_country"), F.lit("")))
    if rules.iso_block:
        out = out.when(iso.isin(*[c.upper() for c in rules.iso_block]), "iso_country_blocked")
    if rules.iso_allow:
        out = out.when(iso.isNull(), "iso_country_missing_with_allowlist")
        out = out.when(~iso.isin(*[c.upper() for c in rules.iso_allow]), "iso_country_not_allowed")
    if rules.bboxes:
        inside = F.lit(False)
        for box in rules.bboxes:
            inside = inside | in_bbox(F.col("lat"), F.col("lng"), *box)
        out = out.when(F.col("lat").isNull() | F.col("lng").isNull(), "coordinates_missing_with_bbox_allowlist")
        out = out.when(~inside, "bbox_not_allowed")
    return out


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


@dataclass(frozen=True)
class PriorityWeights:
    severity: float = 0.30
    source: float = 0.20
    duplication: float = 0.20
    recency: float = 0.10
    category: float = 0.10
    area: float = 0.10


def priority_parts(weights: PriorityWeights, as_of, source_score, duplicates, bonus, in_area) -> Column:
    """Components in [0, 1] and their weighted mean, as one struct."""
    parts = {
        "severity": clamp(F.col("severity"), 0.0, 1.0),
        "source": clamp(source_score, 0.0, 1.0),
        "duplication": clamp(F.log1p(duplicates) / F.log1p(F.lit(10)), 0.0, 1.0),
        "recency": linear_decay(hours_between(as_of, F.col("timestamp")), 6.0),
        "category": clamp(bonus, 0.0, 1.0),
        "area": F.when(in_area, 1.0).otherwise(0.0),
    }
    total = sum(getattr(weights, k) for k in parts)
    mean = sum((getattr(weights, k) * v for k, v in parts.items()), F.lit(0.0)) / F.lit(total or 1.0)
    final = clamp(mean, 0.0, 1.0) if total > 0 else F.lit(0.0)
    return F.struct(*[v.alias(k) for k, v in parts.items()], final.alias("final"))
