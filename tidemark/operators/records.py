"""Typed projections of findings and entities for readers outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a reader is shown of each finding type, as label -> property keys in order of preference.
FACTS = {
    "sanctioned_vessel_went_dark": {
        "vessel": ["live_vessel_name"], "mmsi": ["mmsi"], "imo": ["live_imo", "sanctioned_imo"], "hours_dark": ["hours_dark"],
        "match_kind": ["match_kind"], "last_seen": ["last_seen_ais"],
    },
    "sanctioned_vessel_rendezvous": {
        "a_name": ["a_name"], "b_name": ["b_name"], "a_mmsi": ["a_mmsi"], "b_mmsi": ["b_mmsi"], "distance_m": ["distance_m"],
        "a_sanctioned": ["a_sanctioned"], "b_sanctioned": ["b_sanctioned"],
    },
    "shadow_fleet_cluster": {"vessels": ["cluster_size"], "members": ["member_names"]},
    "sanctioned_vessel_underway": {
        "vessel": ["live_vessel_name"], "mmsi": ["mmsi"], "imo": ["live_imo", "sanctioned_imo"], "match_kind": ["match_kind"],
    },
    "sanctioned_port_arrival": {"vessel": ["vessel_name", "live_vessel_name"], "port": ["port_name", "port"], "mmsi": ["mmsi"]},
    "aircraft_in_sanctioned_airspace": {"callsign": ["callsign"], "icao24": ["icao24"], "country": ["zone"]},
    "military_aircraft_underway": {"callsign": ["callsign"], "icao24": ["icao24"], "operator": ["operator", "origin_country"]},
    "dark_vessel_detected": {"vessel": ["vessel_name", "live_vessel_name"], "mmsi": ["mmsi"], "hours_dark": ["hours_dark"]},
    "loitering_detected": {
        "entity_name": ["entity_name", "vessel_name"], "mmsi": ["mmsi", "canonical_id"], "icao24": ["icao24"],
        "duration_h": ["span_hours"], "radius_m": ["radius_threshold_m"],
    },
    "nasa_firms": {"satellite": ["satellite", "instrument"], "brightness": ["brightness", "bright_ti4"], "confidence": ["confidence"]},
    "usgs_quake": {"magnitude": ["mag", "magnitude"], "place": ["place"], "depth_km": ["depth_km", "depth"]},
}
FEED_AUTHORITY = {"nasa_firms": "NASA FIRMS", "usgs_quake": "USGS Earthquake Hazards Program"}


def prop(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def facts() -> Column:
    """map<string,string> of the facts of a finding's type; absent ones are left out."""
    expr = None
    for event_type, fields in FACTS.items():
        entries = F.array(*[
            F.struct(F.lit(label).alias("key"), F.coalesce(*[prop(k) for k in keys]).alias("value")) for label, keys in fields.items()
        ])
        value = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        hit = F.col("event_type") == event_type
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def authority() -> Column:
    """Authority behind a finding as struct(name, canonical_id); null where it is only derived."""
    name = prop("sanctioning_authority")
    ident = F.coalesce(*[prop(p + "sanctioned_canonical_id") for p in ("", "a_", "b_")])
    feed = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(n)) for t, n in FEED_AUTHORITY.items()])
    listed = name.isNotNull() | ident.isNotNull()
    return F.when(
        listed | feed.isNotNull(), F.struct(F.when(listed, name).otherwise(feed).alias("name"), ident.alias("canonical_id"))
    )


def interchange(entities: DataFrame) -> DataFrame:
    """Vessels and aircraft (listed ones too) as id, schema and map<string,array<string>>; others are dropped.

    `properties` is map<string,string>.
    """
    kind, p = F.col("entity_type"), F.col("properties")
    schema = F.when(kind.isin("vessel", "sanctioned_vessel"), "Vessel").when(kind.isin("aircraft", "sanctioned_aircraft"), "Airplane")
    get = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(p, F.lit(k)), F.lit("")) for k in keys])
    vessel, plane, listed = schema == "Vessel", schema == "Airplane", kind.startswith("sanctioned_")
    references = F.concat_ws(
        "; ",
        F.concat(F.lit("Authority: "), get("sanctioning_authority")), F.concat(F.lit("EU ref: "), get("eu_ref")),
        F.concat(F.lit("UK OFSI ref: "), get("uk_ofsi_id")), F.concat(F.lit("OFAC ref: "), get("ofac_uid")),
    )
    operator = F.when(plane, F.concat(F.lit("Operator: "), get("operator")))
    description = F.nullif(F.concat_ws("; ", operator, F.nullif(F.when(listed, references), F.lit(""))), F.lit(""))
    fields = {
        "name": get("display_name", "name"),
        "imoNumber": F.when(vessel, get("imo", "imoNumber")),
        "mmsi": F.when(vessel, get("mmsi")),
        "callSign": F.when(vessel, get("callsign", "call_sign")),
        "flag": F.when(vessel, get("flag", "flag_state")),
        "type": F.when(vessel, get("vessel_type", "ship_type")),
        "registrationNumber": F.when(vessel, get("registration_number")).when(plane, get("registration", "reg", "tail_number")),
        "icaoCode": F.when(plane, get("icao24", "icaoCode")),
        "model": F.when(plane, get("model", "aircraft_type")),
        "topics": F.when(listed, F.lit("sanction")),
        "program": F.when(listed, get("regime", "programme")),
        "description": description,
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    kept = F.transform(
        F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), F.array(e["value"]).alias("value"))
    )
    return entities.filter(schema.isNotNull() & F.col("canonical_id").isNotNull()).select(
        F.col("canonical_id").alias("id"), schema.alias("schema"), F.map_from_entries(kept).alias("properties")
    )


# Payload keys that stay with an entity, and those that belong to one position.
STABLE = {
    "aircraft": ("callsign", "military", "emergency", "origin_country"),
    "vessel": ("name", "ship_type", "dark", "imo", "flag_state", "callsign", "mmsi"),
    "satellite": ("name", "group", "norad", "international_designator"),
    "sanctioned_vessel": (
        "type", "display_name", "imo", "mmsi", "aircraft_serial", "regime", "flag", "ship_type", "uk_ref", "ofac_program",
        "programme", "eu_ref", "sanctioning_authority",
    ),
}
PER_POSITION = {
    "aircraft": ("squawk", "on_ground", "time_position"), "vessel": ("cog", "nav_status", "draught", "destination"), "satellite": (),
}


def split_properties(events: DataFrame) -> DataFrame:
    """Adds `entity_properties` and `position_properties` (maps) from `payload` (map<string,string>)."""

    def pick(table: dict[str, tuple[str, ...]]) -> Column:
        keys = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
        wanted = F.coalesce(F.try_element_at(keys, F.col("entity_type")), F.array().cast("array<string>"))
        return F.map_filter("payload", lambda k, v: F.array_contains(wanted, k) & v.isNotNull())

    return events.withColumn("entity_properties", pick(STABLE)).withColumn(
        "position_properties",
        F.map_concat(pick(PER_POSITION), F.create_map(F.lit("severity"), F.col("severity").cast("string"))),
    )
