"""The event model shared by sources, operators and sinks."""

EVENT_SCHEMA = (
    "layer string, external_id string, kind string, lat double, lng double, event_time timestamp, "
    "severity int, altitude_m double, heading_deg double, velocity_ms double, source string, "
    "payload map<string,string>, event_type string, event_subtype string, domain string, "
    "geocode_quality string, decay_half_life_min int"
)
EVENT_COLUMNS = [part.strip().split(" ")[0] for part in EVENT_SCHEMA.split(", ")]

NEWS_SCHEMA = (
    "event_id string, timestamp timestamp, code string, category string, subcategory string, "
    "severity double, goldstein double, flags array<string>, title string, source_url string, "
    "actor1_name string, actor2_name string, lat double, lng double, geocode_quality string, iso_country string"
)
