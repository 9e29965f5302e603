"""Severity rules: threshold tables and value maps turned into one expression each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.stats import clamp
from tidemark.sources import refdata as R

# Fixed values: "at least" steps, highest first, then the value below them and for null.
AT_LEAST = {
    "quake": ([(7.5, 10), (7.0, 9), (6.0, 8), (5.5, 7), (5.0, 6), (4.5, 5), (4.0, 4), (3.0, 2)], 1, 1),
    "quake_list_b": ([(8.0, 10), (7.0, 9), (6.0, 7), (5.0, 6), (4.0, 5), (2.5, 3)], 1, 1),
    "storm_kp": ([(9, 10), (8, 8), (7, 7), (6, 6), (5, 5), (4, 3)], 1, 3),
    "wave_height": ([(10, 10), (6, 8), (4, 6), (3, 5), (2, 3), (1, 2)], 1, 1),
    "wind_kt": ([(113, 10), (96, 9), (83, 8), (64, 7), (35, 5)], 3, 5),
    "story_score": ([(1000, 10), (300, 8), (100, 6), (1, 4)], 3, 3),
    "articles": ([(500, 9), (200, 8), (100, 7), (50, 6), (20, 5), (10, 4), (5, 3), (3, 2)], 1, 1),
    "fire_brightness": ([(360, 8), (340, 7), (320, 6), (300, 5)], 4, 5),
}
# Fixed values: "at most" steps, lowest first, then the value above them.
AT_MOST = {"aqi": ([(50, 1), (100, 3), (150, 5), (200, 6), (300, 8)], 10)}
AQI_BUCKETS = (
    [(50, "good"), (100, "moderate"), (150, "unhealthy_sensitive"), (200, "unhealthy"), (300, "very_unhealthy")],
    "hazardous",
)
# Severity of coded fields.
FLARE = {"X": 9, "M": 6, "C": 3, "B": 1, "A": 1}
ALERT_SEVERITY = {"Extreme": 9, "Severe": 7, "Moderate": 5, "Minor": 3, "Unknown": 2}
ALERT_URGENCY = {"Immediate": 1, "Expected": 0, "Future": -1, "Past": -2, "Unknown": 0}
VOLCANO_LEVEL = {"NORMAL": 0, "ADVISORY": 5, "WATCH": 7, "WARNING": 10}
VOLCANO_COLOUR = {"GREEN": 0, "YELLOW": 1, "ORANGE": 2, "RED": 3}
INCIDENT_BASE = {
    "Hurricane": 9, "Tropical Storm": 7, "Coastal Storm": 6, "Severe Storm": 6, "Severe Storm(s)": 6,
    "Severe Ice Storm": 7, "Tornado": 7, "Flood": 7, "Earthquake": 9, "Tsunami": 9, "Volcano": 9,
    "Volcanic Eruption": 9, "Wildfire": 7, "Fire": 6, "Snowstorm": 5, "Winter Storm": 5,
    "Mud/Landslide": 6, "Drought": 5, "Other": 4, "Pandemic": 8, "Biological": 7, "Chemical": 7,
    "Toxic Substances": 6, "Dam/Levee Break": 8, "Terrorist": 9, "Human Cause": 5,
}
DECLARATION_BOOST = {"DR": 1, "EM": 0, "FM": -1}
NATURAL_CATEGORY = {
    "wildfires": 7, "severeStorms": 8, "volcanoes": 8, "earthquakes": 7, "floods": 7, "drought": 4,
    "dustHaze": 3, "landslides": 6, "manmade": 5, "seaLakeIce": 4, "snow": 4, "tempExtremes": 5,
    "waterColor": 3,
}
FILING_FORM = {"8-K": 6, "S-1": 7, "10-K": 4, "10-Q": 3, "13F": 2, "424B": 5}
DISASTER_ALERT = {"green": 4, "orange": 7, "red": 9}
AIRPORT_TYPE = {"large_airport": 2, "medium_airport": 1, "small_airport": 0}
NEWS_CATEGORY = {
    "world": 6, "politics": 6, "crime": 7, "top": 5, "business": 4, "technology": 4,
    "environment": 5, "health": 4, "science": 3,
}
QUAKE_ALERT_FLOOR = {"yellow": 7, "orange": 8, "red": 10}


def at_least(x: Column, rule: str) -> Column:
    """Value of the highest threshold reached."""
    steps, below, missing = AT_LEAST[rule]
    expr = F.when(x.isNull(), missing)
    for threshold, value in steps:
        expr = expr.when(x >= threshold, value)
    return expr.otherwise(below)


def at_most(x: Column, steps: Sequence[tuple], above) -> Column:
    expr = F.when(x.isNull(), F.lit(None))
    for threshold, value in steps:
        expr = expr.when(x <= threshold, F.lit(value))
    return expr.otherwise(F.lit(above))


def mapped(key: Column, values: Mapping, default) -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def quake(magnitude: Column, tsunami: Column, alert: Column) -> Column:
    base = at_least(magnitude, "quake") + F.coalesce(tsunami, F.lit(False)).cast("int")
    return F.greatest(F.least(base, F.lit(10)), mapped(F.lower(alert), QUAKE_ALERT_FLOOR, 0))


def fire(brightness_k: Column, confidence: Column) -> Column:
    """Brightness step, one up for high and two down for low detection confidence."""
    base = at_least(brightness_k, "fire_brightness")
    c = F.lower(confidence)
    number = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return (
        F.when(c.isin("h", "high") | (number >= 80), F.least(F.lit(10), base + 1))
        .when(c.isin("l", "low") | (number < 30), F.greatest(F.lit(1), base - 2))
        .otherwise(base)
    )


def flare(flare_class: Column) -> Column:
    return mapped(F.upper(F.substring(flare_class, 1, 1)), FLARE, 2)


def near_object(diameter_m: Column, miss_km: Column, hazardous: Column) -> Column:
    base = F.greatest(
        F.when(hazardous, 6).otherwise(2),
        F.when(diameter_m >= 1000, 8).when(diameter_m >= 140, 5).otherwise(2),
    )
    return F.when(miss_km < 384400, F.least(F.lit(10), base + 2)).otherwise(base)


def temperature(t_max: Column) -> Column:
    return (
        F.when(t_max >= 45, 9).when(t_max >= 40, 8).when(t_max >= 35, 6).when(t_max >= 30, 4)
        .when(t_max <= -25, 9).when(t_max <= -20, 8).when(t_max <= -10, 5)
        .otherwise(1)
    )


def exploited_vulnerability(ransomware: Column, date_added: Column, as_of_date: Column) -> Column:
    age = F.datediff(as_of_date, date_added)
    bump = F.when(ransomware == "Known", 2).otherwise(0) + F.when(age.between(0, 30), 1).otherwise(0)
    return F.least(F.lit(10), bump + 7)


def volcano(level: Column, colour: Column) -> Column:
    return clamp(mapped(F.upper(level), VOLCANO_LEVEL, 5) + mapped(F.upper(colour), VOLCANO_COLOUR, 0), 1, 10)


def weather_alert(severity: Column, urgency: Column) -> Column:
    return clamp(mapped(severity, ALERT_SEVERITY, 2) + mapped(urgency, ALERT_URGENCY, 0), 0, 10)


def declaration(incident: Column, kind: Column) -> Column:
    return clamp(mapped(F.trim(incident), INCIDENT_BASE, 5) + mapped(F.upper(kind), DECLARATION_BOOST, 0), 1, 10)


def space_alert(kind: Column, level: Column) -> Column:
    """K index steps; the 1-5 scales count double."""
    k = (
        F.when(level <= 3, 1).when(level == 4, 3).when(level == 5, 5).when(level == 6, 7)
        .when(level == 7, 8).when(level == 8, 9).otherwise(10)
    )
    return F.when(kind == "K", k).otherwise(clamp(level * 2, 1, 10))


def news_categories(categories: Column) -> Column:
    """Highest category severity; 0 when no category of the list is present."""
    scores = F.transform(categories, lambda c: mapped(F.lower(F.trim(c)), NEWS_CATEGORY, 0))
    return F.coalesce(F.array_max(scores), F.lit(0))


def police(low: Column) -> Column:
    return T.keyword_tier(low, R.POLICE_TIERS, R.POLICE_DEFAULT)


def citizen(low: Column) -> Column:
    return T.keyword_tier(low, R.CITIZEN_TIERS, R.CITIZEN_DEFAULT)


def post(low: Column) -> Column:
    """Whole-word keywords of lower-cased text: 6 with a grave one, 4 with any, else 1."""
    whole = lambda words: T.contains_any(low, words) & low.rlike("\\b(" + "|".join(words) + ")\\b")
    return F.when(whole(R.POST_GRAVE_KEYWORDS), 6).when(whole(R.POST_KEYWORDS), 4).otherwise(1)


def topic(low: Column) -> Column:
    """Slug of the first topic, in list order, with a keyword in the lower-cased title; null if none."""
    return F.coalesce(*[F.when(T.contains_any(low, words), F.lit(slug)) for slug, words, *_ in R.TOPICS])


def suspicious_vessel(mmsi: Column, ship_type: Column, speed: Column, name: Column) -> Column:
    """No usable identity, or untyped, moving and unnamed."""
    ident = F.trim(F.coalesce(mmsi.cast("string"), F.lit("")))
    bad_id = (ident == "") | (ident == "0") | ident.startswith("000")
    unnamed = F.trim(F.coalesce(name, F.lit(""))) == ""
    return bad_id | ((F.coalesce(ship_type, F.lit(0)) == 0) & (F.coalesce(speed, F.lit(0.0)) > 3) & unnamed)


def military_aircraft(callsign: Column, icao24: Column, flags: Column) -> Column:
    starts = F.upper(F.trim(F.coalesce(callsign, F.lit("")))).rlike("^(" + "|".join(R.MILITARY_CALLSIGNS) + ")")
    block = F.substring(F.upper(F.coalesce(icao24, F.lit(""))), 1, 3).isin(*R.MILITARY_HEX)
    return F.coalesce(flags.bitwiseAND(1) == 1, F.lit(False)) | block | starts


def aircraft(is_emergency: Column, is_military: Column, on_ground: Column) -> Column:
    return F.when(is_emergency, 10).when(is_military & on_ground, 4).when(is_military, 7).otherwise(1)


# Stations and telescopes that stand out among satellites.
NOTABLE_SATELLITES = ("iss", "tiangong", "hubble")


def satellite(name: Column) -> Column:
    """`name` in lower case."""
    return F.when(name.rlike("|".join(NOTABLE_SATELLITES)), 5).otherwise(1)
