"""Text expressions: trigrams, token sets, keyword tiers, domains, coordinates, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased alphanumeric words, padded two left and one right."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        starts = F.sequence(F.lit(1), F.length(padded) - 2)
        return F.transform(starts, lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements of two sets; both empty gives null."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(set_jaccard(trigrams(a), trigrams(b)), F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.array_distinct(
        F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda t: t != "")
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity: 1 for two empty texts, 0 for one."""
    return F.coalesce(set_jaccard(tokens(a), tokens(b)), F.lit(1.0))


def contains_any(low: Column, words: Sequence[str]) -> Column:
    """Substring (not whole-word) test of lower-cased text against a keyword list.

    A chain of byte searches; on long texts it is far cheaper than one regular expression.
    """
    hit = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def keyword_tier(low: Column, tiers: Sequence[tuple[Sequence[str], float]], default) -> Column:
    """Value of the first tier with a keyword in the lower-cased text."""
    expr = None
    for words, value in tiers:
        hit = contains_any(low, words)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr.otherwise(F.lit(default))


def first_listed(low: Column, words: Sequence[str], whole_word: bool = False) -> Column:
    """First word of the list, in list order, that occurs in the lower-cased text; null if none does."""

    def hit(word: str) -> Column:
        found = F.contains(low, F.lit(word))
        return found & low.rlike("\\b" + _quote(word) + "\\b") if whole_word else found

    return F.coalesce(*[F.when(hit(w), F.lit(w)) for w in words])


def _quote(word: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch in " #_") else ch for ch in word)


def domain_of(url: Column) -> Column:
    """Lower-cased host without port and leading 'www.'; a bare path counts as the host."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    netloc = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host).otherwise(bare)
    return F.regexp_replace(F.split_part(F.lower(F.coalesce(netloc, F.lit(""))), F.lit(":"), F.lit(1)), "^www\\.", "")


_PAIR = "(-?\\d{1,3}\\.\\d{2,6})[,\\s]+(-?\\d{1,3}\\.\\d{2,6})"


def coordinates_in(text: Column) -> Column:
    """First decimal 'lat, lng' pair of the text as a struct, or null when out of range."""
    lat = F.nullif(F.regexp_extract(text, _PAIR, 1), F.lit("")).cast("double")
    lng = F.nullif(F.regexp_extract(text, _PAIR, 2), F.lit("")).cast("double")
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def hemisphere_degrees(text: Column) -> Column:
    """'21.1N', '94.4W' or '-21.1' as signed degrees."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, "^([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*([NSEW]?)$", 1)
    side = F.regexp_extract(clean, "^([-+]?[0-9]+(?:\\.[0-9]+)?)\\s*([NSEW]?)$", 2)
    value = F.nullif(number, F.lit("")).cast("double")
    return (
        F.when(side.isin("S", "W"), -F.abs(value))
        .when(side.isin("N", "E"), F.abs(value))
        .otherwise(value)
    )


def parse_time(text: Column) -> Column:
    """Feed time stamps: ISO with offset or 'Z', 14 digits, RFC-822, or 'YYYY-Mon-DD HH:MM'."""
    clean = F.trim(text)
    digits = F.when(clean.rlike("^\\d{14}$"), F.try_to_timestamp(clean, F.lit("yyyyMMddHHmmss")))
    iso = F.when(clean.rlike("^\\d{4}-\\d{2}-\\d{2}"), clean.try_cast("timestamp"))
    zoned = F.when(clean.rlike("^[A-Za-z]{3}, "), F.try_to_timestamp(
        F.regexp_replace(F.regexp_replace(clean, "^[A-Za-z]{3}, ", ""), "(GMT|UTC|Z)$", "+0000"),
        F.lit("d MMM yyyy HH:mm:ss Z"),
    ))
    month = F.when(clean.rlike("^\\d{4}-[A-Za-z]{3}-"), F.try_to_timestamp(clean, F.lit("yyyy-MMM-dd HH:mm")))
    return F.coalesce(digits, iso, zoned, month)


def event_text(title: Column, description: Column) -> Column:
    """Non-blank parts joined by '. '; null when both are blank."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(". ", part(title), part(description)), F.lit(""))


def callsign_family(name: Column) -> Column:
    """Leading letters of a call sign of four or more characters, else 'unknown'."""
    letters = F.nullif(F.regexp_extract(F.upper(name), "^[A-Z]+", 0), F.lit(""))
    return F.when(name.isNotNull() & (F.length(name) >= 4), letters).otherwise(F.lit("unknown"))
