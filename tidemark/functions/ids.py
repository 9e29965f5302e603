"""Deterministic identifiers built from Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.stats import round_even

# Fixed value: name space of event ids; equal inputs must give equal ids everywhere.
EVENT_NAMESPACE = "a4d92b16-1c4f-4e2c-8f3a-1f0e2c4d8b6a"


def uuid5(name: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    """RFC 4122 version 5 id: SHA-1 of name space and name, with version and variant set."""
    prefix = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.conv((nibble.bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def event_id(event_type: Column, external_id: Column) -> Column:
    return uuid5(F.concat_ws(":", event_type, external_id))


def content_hash(lat, lng, severity, kind, altitude_m) -> Column:
    """Coarse state of an event; positions are kept to about 11 m, altitude to 10 m."""
    return F.md5(
        F.concat_ws(
            "|",
            F.format_string("%.4f", round_even(lat, 4)),
            F.format_string("%.4f", round_even(lng, 4)),
            F.coalesce(severity.cast("string"), F.lit("")),
            F.coalesce(kind, F.lit("")),
            F.coalesce(round_even(altitude_m, -1).cast("bigint").cast("string"), F.lit("")),
        )
    )
