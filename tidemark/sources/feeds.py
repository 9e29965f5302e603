"""Landed feed files to conformed events.

A feed is a `Feed`: how its file is read and one select list. `conform` turns any of them
into the event model. Rows without an id or place are dropped by the `keep` condition, and
a missing time falls back to the time of landing, passed in as `as_of`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions.geo import mean_vertex
from tidemark.operators.latest import latest_by, top_per_group
from tidemark.schema import EVENT_COLUMNS

_c = F.col


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Feed:
    """Columns of one feed in terms of its raw rows; callables receive `as_of`."""

    layer: str
    event_type: str
    schema: str
    external_id: Column
    severity: Column | Callable[[Column], Column]
    lat: Column = field(default_factory=lambda: _null("double"))
    lng: Column = field(default_factory=lambda: _null("double"))
    time: Column = field(default_factory=lambda: _null("timestamp"))
    keep: Column = field(default_factory=lambda: F.lit(True))
    subtype: Column = field(default_factory=lambda: _null("string"))
    kind: str = "event"
    domain: str = "geo"
    quality: str = "exact"
    decay: int = 60
    altitude_m: Column = field(default_factory=lambda: _null("double"))
    heading: Column = field(default_factory=lambda: _null("double"))
    velocity: Column = field(default_factory=lambda: _null("double"))
    payload: dict[str, Column] = field(default_factory=dict)
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    format: str = "json"
    options: dict[str, str] = field(default_factory=dict)
    first_id_wins: bool = False


def read(spark: SparkSession, feed: Feed, path: str, stream: bool = False, files_per_batch: int = 256) -> DataFrame:
    """Rows of landed files. For streams the number of files bounds a micro-batch, and with it
    what keyed state has to hold of one key at a time."""
    reader = (spark.readStream if stream else spark.read).schema(feed.schema).format(feed.format)
    options = {"multiLine": "true"} if feed.format == "json" else {}
    if stream:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    return reader.options(**{**options, **feed.options}).load(path)


def conform(raw: DataFrame, feed: Feed, as_of: Column) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in feed.payload.items()])
    payload = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())) if feed.payload else F.create_map().cast("map<string,string>")
    severity = feed.severity(as_of) if callable(feed.severity) else feed.severity
    values = {
        "layer": F.lit(feed.layer), "external_id": feed.external_id, "kind": F.lit(feed.kind), "lat": feed.lat, "lng": feed.lng,
        "event_time": F.coalesce(feed.time, as_of), "severity": severity.cast("int"), "altitude_m": feed.altitude_m,
        "heading_deg": feed.heading, "velocity_ms": feed.velocity, "source": F.lit(feed.event_type), "payload": payload,
        "event_type": F.lit(feed.event_type), "event_subtype": feed.subtype, "domain": F.lit(feed.domain),
        "geocode_quality": F.lit(feed.quality), "decay_half_life_min": F.lit(feed.decay),
    }
    rows = feed.rows(raw).filter(feed.external_id.isNotNull() & (feed.external_id != "") & feed.keep)
    events = rows.select(*[values[c].alias(c) for c in EVENT_COLUMNS])
    return events.dropDuplicates(["external_id"]) if feed.first_id_wins else events


def _features(df: DataFrame) -> DataFrame:
    return df.select(F.explode("features").alias("f")).select("f.*")


def _placed(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))


def _num(name: str) -> Column:
    return _c(name).try_cast("double")


def _pair_lists(json_text: Column) -> Column:
    """All [lng, lat] pairs of GeoJSON coordinates of any depth, found in the text of the nested lists."""
    pairs = F.regexp_extract_all(json_text, F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)[^\[\]]*\]"), 1)
    return F.transform(pairs, lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")))


# Severity of flight rules.
FLIGHT_RULES = {"VFR": 1, "MVFR": 3, "IFR": 5, "LIFR": 7}

# Storm classes.
STORM_CLASS = {
    "TD": "tropical_depression", "TS": "tropical_storm", "HU": "hurricane", "MH": "major_hurricane", "STD": "subtropical_depression", "STS": "subtropical_storm",
    "PT": "post_tropical", "DB": "disturbance", "WV": "tropical_wave", "EX": "extratropical", "PTC": "potential_tropical_cyclone",
}


def _per_disaster(df: DataFrame) -> DataFrame:
    """The endpoint lists one row per area; one event per disaster keeps the first row's fields."""
    rows = df.select(F.posexplode("DisasterDeclarationsSummaries").alias("seq", "d")).select("seq", "d.*").filter(_c("disasterNumber").isNotNull())
    rest = [c for c in rows.columns if c not in ("disasterNumber", "seq")]
    return rows.groupBy("disasterNumber").agg(
        F.min_by(F.struct(*rest), "seq").alias("first"), F.count(F.lit(1)).alias("area_count")
    ).select("disasterNumber", "area_count", "first.*")


def feeds() -> dict[str, Feed]:
    """The catalogue. Columns need a running session, so the table is built on demand."""
    _POINT = "geometry struct<type:string,coordinates:array<double>>"
    _LNG, _LAT = _c("geometry.coordinates")[0], _c("geometry.coordinates")[1]

    QUAKES = Feed(
        layer="earthquakes", event_type="usgs_quake", kind="alert", quality="city", rows=_features,
        schema=f"features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,tsunami:int,alert:string,title:string,url:string>,{_POINT.replace(' struct', ':struct')}>>",
        external_id=_c("id"), lat=_LAT, lng=_LNG, time=F.timestamp_millis(_c("properties.time")), keep=_placed(_LAT, _LNG),
        severity=S.quake(F.coalesce(_c("properties.mag"), F.lit(0.0)), _c("properties.tsunami") == 1, _c("properties.alert")),
        altitude_m=-1000.0 * F.coalesce(F.get(_c("geometry.coordinates"), F.lit(2)), F.lit(0.0)),
        payload={"mag": _c("properties.mag"), "place": _c("properties.place"), "title": _c("properties.title"), "alert": _c("properties.alert")},
    )
    QUAKES_B = Feed(
        layer="earthquakes", event_type="emsc_quake", rows=_features,
        schema=f"features array<struct<id:string,properties:struct<source_id:string,unid:string,mag:double,magtype:string,time:string,flynn_region:string,auth:string>,{_POINT.replace(' struct', ':struct')}>>",
        external_id=F.concat(F.lit("emsc:"), F.coalesce(_c("properties.source_id"), _c("properties.unid"), _c("id"))), lat=_LAT, lng=_LNG,
        time=T.parse_time(_c("properties.time")), keep=F.size("geometry.coordinates") >= 2,
        severity=S.at_least(F.coalesce(_c("properties.mag"), F.lit(0.0)), "quake_list_b"),
        altitude_m=F.get(_c("geometry.coordinates"), F.lit(2)) * -1000,
        payload={"magnitude": _c("properties.mag"), "region": _c("properties.flynn_region"), "agency": _c("properties.auth")},
    )
    _fire_lat, _fire_lng = _num("latitude"), _num("longitude")
    _fire_id = F.concat_ws(
        ":", F.coalesce(_c("dataset"), F.lit("firms")), F.format_string("%.4f", _fire_lat), F.format_string("%.4f", _fire_lng), "acq_date", "acq_time"
    )
    _bright = F.nullif(F.coalesce(_num("bright_ti4"), _num("brightness"), F.lit(0.0)), F.lit(0.0))
    FIRES = Feed(
        layer="wildfires", event_type="nasa_firms", format="csv", options={"header": "true", "enforceSchema": "false"}, decay=120, first_id_wins=True,
        schema="latitude string, longitude string, bright_ti4 string, brightness string, acq_date string, acq_time string, satellite string, instrument string, confidence string, frp string, daynight string, dataset string",
        external_id=_fire_id, lat=_fire_lat, lng=_fire_lng, keep=_placed(_fire_lat, _fire_lng), severity=S.fire(_bright, _c("confidence")),
        time=F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm")), subtype=_c("satellite"),
        payload={"brightness_k": _bright, "confidence": _c("confidence"), "frp_mw": _num("frp"), "satellite": _c("satellite"), "instrument": _c("instrument"), "daynight": _c("daynight")},
    )
    _last = F.element_at("geometry", -1)
    _vertices = _pair_lists(F.concat(F.lit("["), _last["coordinates"], F.lit("]")))
    NATURAL = Feed(
        layer="natural_events", event_type="nasa_eonet", decay=720,
        schema="events array<struct<id:string,title:string,description:string,link:string,categories:array<struct<id:string,title:string>>,geometry:array<struct<date:string,type:string,coordinates:string>>>>",
        rows=lambda df: df.select(F.explode("events").alias("e")).select("e.*"), keep=F.size(_vertices) > 0,
        external_id=_c("id"), lat=F.get(F.get(_vertices, F.lit(0)), F.lit(1)), lng=F.get(F.get(_vertices, F.lit(0)), F.lit(0)), time=T.parse_time(_last["date"]),
        severity=F.coalesce(F.array_max(F.transform("categories.id", lambda c: S.mapped(c, S.NATURAL_CATEGORY, 4))), F.lit(4)),
        subtype=F.get("categories.id", F.lit(0)), payload={"title": _c("title"), "description": _c("description"), "link": _c("link")},
    )
    _area = _pair_lists(_c("geometry.coordinates"))
    _centre = mean_vertex(_area)
    ALERTS = Feed(
        layer="weather_alerts", event_type="noaa_alert", kind="alert", quality="polygon_centroid", decay=30, rows=_features,
        schema="features array<struct<id:string,properties:struct<id:string,event:string,headline:string,severity:string,urgency:string,certainty:string,areaDesc:string,sent:string>,geometry:struct<type:string,coordinates:string>>>",
        external_id=F.coalesce(_c("properties.id"), _c("id")), lat=_centre["lat"], lng=_centre["lng"], keep=F.size(_area) > 0, time=T.parse_time(_c("properties.sent")),
        severity=S.weather_alert(F.coalesce(_c("properties.severity"), F.lit("Unknown")), F.coalesce(_c("properties.urgency"), F.lit("Unknown"))),
        subtype=F.coalesce(_c("properties.event"), F.lit("Weather Alert")),
        payload={"event": _c("properties.event"), "headline": _c("properties.headline"), "severity_raw": _c("properties.severity"), "urgency": _c("properties.urgency"), "area_desc": _c("properties.areaDesc")},
    )
    _kind = _c("_event_type")
    _kp = F.array_max(F.transform("allKpIndex", lambda k: k["kpIndex"]))
    _speed = F.get(_c("cmeAnalyses"), F.lit(0))["speed"]
    SPACE = Feed(
        layer="space_weather", event_type="donki", kind="watch", quality="none",
        schema="_event_type string, flrID string, classType string, peakTime string, beginTime string, sourceLocation string, activityID string, startTime string, cmeAnalyses array<struct<speed:double>>, gstID string, allKpIndex array<struct<kpIndex:double>>",
        external_id=F.when(_kind.isin("FLR", "CME", "GST"), F.concat(F.lit("donki:"), _kind, F.lit(":"), F.when(_kind == "FLR", _c("flrID")).when(_kind == "CME", _c("activityID")).otherwise(_c("gstID")))),
        time=T.parse_time(F.regexp_replace(F.when(_kind == "FLR", F.coalesce("peakTime", "beginTime")).otherwise(_c("startTime")), "Z$", ":00Z")),
        severity=F.when(_kind == "FLR", S.flare(_c("classType"))).when(_kind == "CME", F.when(_speed > 1000, 5).otherwise(3)).otherwise(S.at_least(_kp, "storm_kp")),
        subtype=_kind, payload={"class": _c("classType"), "speed_km_s": _speed, "kp_max": _kp},
    )
    _product = lambda i: F.regexp_extract(F.trim("product_id"), "^([KGRS])0*([0-9]+)([WASP])$", i)
    SPACE_ALERTS = Feed(
        layer="space_weather", event_type="swpc_alert", kind="swpc_alert", quality="none", schema="product_id string, issue_datetime string, message string",
        external_id=F.concat_ws(":", F.lit("swpc"), F.trim("product_id"), F.coalesce("issue_datetime", F.lit(""))), keep=_product(1) != "",
        lat=F.when(_product(1).isin("K", "G"), 60.0).when(_product(1) == "S", 85.0).otherwise(0.0), lng=F.lit(0.0), time=T.parse_time(_c("issue_datetime")),
        severity=S.space_alert(_product(1), _product(2).try_cast("int")), subtype=_product(1), payload={"product_id": _c("product_id"), "message": _c("message")},
    )
    _approach = F.get(_c("close_approach_data"), F.lit(0))
    _size = (_c("estimated_diameter.meters.estimated_diameter_min") + _c("estimated_diameter.meters.estimated_diameter_max")) / 2
    _miss = _approach["miss_distance"]["kilometers"].try_cast("double")
    NEAR_OBJECTS = Feed(
        layer="neo_asteroids", event_type="neo_close_approach", kind="watch", quality="none",
        schema="id string, neo_reference_id string, name string, is_potentially_hazardous_asteroid boolean, estimated_diameter struct<meters:struct<estimated_diameter_min:double,estimated_diameter_max:double>>, close_approach_data array<struct<close_approach_date_full:string,miss_distance:struct<kilometers:string>>>",
        external_id=F.concat(F.lit("neo:"), F.coalesce("id", "neo_reference_id")), keep=F.size("close_approach_data") > 0,
        time=T.parse_time(_approach["close_approach_date_full"]), altitude_m=_miss * 1000,
        severity=S.near_object(_size, _miss, F.coalesce("is_potentially_hazardous_asteroid", F.lit(False))),
        subtype=F.when(_c("is_potentially_hazardous_asteroid"), "hazardous").otherwise("normal"), payload={"name": _c("name"), "diameter_m": _size, "miss_km": _miss},
    )
    _obs = F.coalesce("obsTime", "reportTime")
    _rules = F.upper(F.coalesce("fltCat", "fltcat_alt"))
    METAR = Feed(
        layer="metar", event_type="metar", kind="state",
        schema="icaoId string, lat double, lon double, obsTime string, reportTime string, fltCat string, fltcat_alt string, rawOb string",
        external_id=F.concat(F.lit("metar:"), F.nullif(F.trim("icaoId"), F.lit(""))), lat=_c("lat"), lng=_c("lon"), keep=_placed(_c("lat"), _c("lon")),
        time=F.when(_obs.rlike("^[0-9]{10,}$"), F.timestamp_seconds(_obs.try_cast("bigint"))).otherwise(T.parse_time(_obs)),
        severity=S.mapped(_rules, FLIGHT_RULES, 2), subtype=_rules, payload={"raw": _c("rawOb")},
    )
    _aqi = F.nullif(_c("aqi"), F.lit("-")).try_cast("double")
    AIR = Feed(
        layer="air_quality", event_type="aqi_reading", kind="state", schema="uid bigint, lat double, lon double, aqi string, station struct<name:string,time:string>",
        external_id=F.concat(F.lit("waqi:"), _c("uid").cast("string")), lat=_c("lat"), lng=_c("lon"), keep=_placed(_c("lat"), _c("lon")) & _aqi.isNotNull(),
        time=T.parse_time(_c("station.time")), severity=S.at_most(_aqi, *S.AT_MOST["aqi"]), subtype=S.at_most(_aqi, *S.AQI_BUCKETS), payload={"aqi": _aqi, "station": _c("station.name")},
    )
    _storm_lat, _storm_lng = T.hemisphere_degrees(F.coalesce("latitude", "latitudeNumeric")), T.hemisphere_degrees(F.coalesce("longitude", "longitudeNumeric"))
    _class = F.upper(F.trim(F.coalesce("classification", F.lit(""))))
    STORMS = Feed(
        layer="tropical_storms", event_type="tropical_storm", kind="tropical_storm",
        schema="id string, stormId string, name string, classification string, intensity string, pressure string, latitude string, longitude string, latitudeNumeric string, longitudeNumeric string, lastUpdate string, issuedTime string",
        external_id=F.concat(F.lit("nhc:"), F.coalesce("id", "stormId")), lat=_storm_lat, lng=_storm_lng, keep=_storm_lat.isNotNull() & _storm_lng.isNotNull(),
        time=T.parse_time(F.coalesce("lastUpdate", "issuedTime")), severity=S.at_least(_num("intensity"), "wind_kt"),
        subtype=F.coalesce(S.mapped(_class, STORM_CLASS, None), F.nullif(F.lower(_class), F.lit("")), F.lit("unknown")),
        payload={"name": F.initcap("name"), "wind_kt": _num("intensity"), "pressure_mb": _num("pressure")},
    )
    VOLCANOES = Feed(
        layer="volcanic_activity", event_type="volcanic_alert", kind="volcanic_alert", quality="needs_match",
        schema="volcano_name string, vnum string, alert_level string, color_code string, obs_fullname string, notice_identifier string, sent_utc string",
        external_id=F.concat_ws(":", F.lit("usgs_volcano"), F.nullif(F.trim("vnum"), F.lit("")), F.coalesce(F.nullif(F.trim("notice_identifier"), F.lit("")), _c("sent_utc"))),
        keep=(F.trim("volcano_name") != "") & (F.trim("vnum") != ""), time=T.parse_time(_c("sent_utc")), severity=S.volcano(F.trim("alert_level"), F.trim("color_code")),
        subtype=F.lower(F.trim("alert_level")), payload={"volcano_name": _c("volcano_name"), "color_code": _c("color_code")},
    )
    DISASTERS = Feed(
        layer="gdacs", event_type="gdacs_alert", kind="gdacs_alert", format="xml", options={"rowTag": "item", "ignoreNamespace": "true"},
        schema="title string, description string, eventtype string, eventid string, episodeid string, alertlevel string, alertscore string, fromdate string, todate string, country string, iso3 string, Point struct<lat:double,long:double>",
        external_id=F.concat_ws(":", F.lit("gdacs"), "eventtype", "eventid", "episodeid"), keep=_c("eventid").isNotNull() & _c("eventtype").isNotNull() & _c("Point.lat").isNotNull(),
        lat=_c("Point.lat"), lng=_c("Point.long"), time=T.parse_time(_c("fromdate")), severity=S.mapped(F.lower("alertlevel"), S.DISASTER_ALERT, 4),
        subtype=_c("eventtype"), payload={"title": _c("title"), "country": _c("country"), "alert_level": F.lower("alertlevel")},
    )

    DECLARATIONS = Feed(
        layer="fema_declarations", event_type="fema_declaration", kind="fema_declaration", quality="approximate", rows=_per_disaster,
        schema="DisasterDeclarationsSummaries array<struct<disasterNumber:int,state:string,declarationType:string,incidentType:string,declarationTitle:string,declarationDate:string,femaDeclarationString:string>>",
        external_id=F.concat(F.lit("openfema:"), F.coalesce("femaDeclarationString", F.concat_ws("-", F.lit("DR"), "disasterNumber", "state"))),
        time=T.parse_time(_c("declarationDate")), severity=S.declaration(F.coalesce("incidentType", F.lit("")), F.coalesce("declarationType", F.lit(""))),
        subtype=_c("incidentType"), payload={"state": _c("state"), "area_count": _c("area_count"), "title": _c("declarationTitle")},
    )
    _added = _c("dateAdded").try_cast("date")
    VULNERABILITIES = Feed(
        layer="cyber_kev", event_type="kev_disclosure", kind="kev_disclosure", domain="tech", quality="none",
        schema="vulnerabilities array<struct<cveID:string,dateAdded:string,vendorProject:string,product:string,vulnerabilityName:string,shortDescription:string,knownRansomwareCampaignUse:string>>",
        rows=lambda df: df.select(F.explode("vulnerabilities").alias("v")).select("v.*"), external_id=F.concat(F.lit("kev:"), F.nullif(F.trim("cveID"), F.lit(""))),
        time=_added.cast("timestamp"), severity=lambda as_of: S.exploited_vulnerability(F.coalesce("knownRansomwareCampaignUse", F.lit("")), _added, F.to_date(as_of)),
        subtype=_c("vendorProject"), payload={"title": F.coalesce("vulnerabilityName", F.concat(F.lit("KEV: "), "cveID")), "product": _c("product"), "ransomware": _c("knownRansomwareCampaignUse")},
    )
    FILINGS = Feed(
        layer="securities_filings", event_type="sec_filing", kind="watch", domain="macro", quality="none", schema="id string, form string, title string, updated string, link string",
        external_id=_c("id"), time=T.parse_time(_c("updated")), severity=S.mapped(F.coalesce("form", F.lit("")), S.FILING_FORM, 3), subtype=_c("form"), payload={"title": _c("title"), "link": _c("link")},
    )
    _story = F.lower(F.trim("title"))
    STORIES = Feed(
        layer="hacker_news", event_type="hn_story", domain="tech", quality="none", schema="id bigint, score int, type string, title string, url string, by string, descendants int, time bigint",
        external_id=F.concat(F.lit("hn:"), _c("id").cast("string")), keep=(_c("score") >= 30) & F.coalesce(_c("type").isin("story", "poll"), F.lit(True)) & (_story != ""),
        time=F.timestamp_seconds("time"), severity=S.at_least(_c("score"), "story_score"),
        subtype=F.when(_c("type") == "poll", "poll").when(_story.startswith("ask hn"), "ask_hn").when(_story.startswith("show hn"), "show_hn").otherwise("story"),
        payload={"title": _c("title"), "url": _c("url"), "score": _c("score"), "domain": T.domain_of(_c("url"))},
    )
    NEWS = Feed(
        layer="news", event_type="newsdata", kind="alert", quality="country", decay=240,
        schema="article_id string, title string, link string, pubDate string, country array<string>, category array<string>, centroid struct<lat:double,lng:double>",
        external_id=F.concat(F.lit("newsdata:"), F.nullif(F.trim("article_id"), F.lit(""))), keep=(F.trim("title") != "") & _c("centroid").isNotNull() & (S.news_categories(_c("category")) > 0),
        lat=_c("centroid.lat"), lng=_c("centroid.lng"), time=T.parse_time(_c("pubDate")), severity=S.news_categories(_c("category")), subtype=F.get(_c("category"), F.lit(0)),
        payload={"title": _c("title"), "url": _c("link"), "country": F.get(_c("country"), F.lit(0))},
    )
    _t_max = F.get(_c("daily.temperature_2m_max"), F.lit(0))
    FORECASTS = Feed(
        layer="climate_forecast", event_type="climate_forecast", decay=1440,
        schema="city string, city_lat double, city_lng double, daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_sum:array<double>>",
        external_id=F.concat_ws(":", F.lit("om-forecast"), "city", F.get(_c("daily.time"), F.lit(0))), keep=(F.size("daily.time") > 0) & (F.size("daily.temperature_2m_max") > 0),
        lat=_c("city_lat"), lng=_c("city_lng"), time=T.parse_time(F.get(_c("daily.time"), F.lit(0))), severity=S.temperature(_t_max), subtype=_c("city"),
        payload={"t_max": _t_max, "t_min": F.get(_c("daily.temperature_2m_min"), F.lit(0)), "precip": F.get(_c("daily.precipitation_sum"), F.lit(0))},
    )
    AIRPORTS = Feed(
        layer="airports", event_type="airport", kind="state", format="csv", options={"header": "true", "enforceSchema": "false"},
        schema="ident string, type string, name string, latitude_deg string, longitude_deg string, elevation_ft string, iso_country string",
        external_id=F.concat(F.lit("airport:"), F.nullif(F.trim("ident"), F.lit(""))), lat=_num("latitude_deg"), lng=_num("longitude_deg"), keep=_placed(_num("latitude_deg"), _num("longitude_deg")),
        severity=S.mapped(F.coalesce("type", F.lit("")), S.AIRPORT_TYPE, 0), altitude_m=_num("elevation_ft") * 0.3048, subtype=_c("type"), payload={"name": _c("name"), "country": _c("iso_country")},
    )
    _now, _before = F.nullif(_c("value"), F.lit(".")).try_cast("double"), F.nullif(_c("prior_value"), F.lit(".")).try_cast("double")
    MACRO = Feed(
        layer="macro", event_type="macro_release", kind="macro_release", domain="macro", quality="none", schema="series_id string, date string, value string, prior_value string, market_severity int",
        external_id=F.concat_ws(":", "series_id", "date"), time=T.parse_time(_c("date")), severity=_c("market_severity"), subtype=_c("series_id"),
        payload={"value": _now, "prior": _before, "change": F.format_string("%+.2f (%+.2f%%)", _now - _before, F.coalesce((_now - _before) / F.nullif(_before, F.lit(0.0)) * 100, F.lit(0.0)))},
    )
    _incident = F.coalesce("itype", F.lit("Incident"))
    INCIDENTS = Feed(
        layer="police_incidents", event_type="police_incident", kind="alert", schema="city string, itype string, addr string, iid string, lat double, lng double, ts string",
        external_id=F.substring(F.md5(F.concat_ws(":", F.coalesce("city", F.lit("unknown")), F.coalesce("iid", F.lit("0")))), 1, 16),
        lat=_c("lat"), lng=_c("lng"), keep=_placed(_c("lat"), _c("lng")) & _c("lat").between(-90, 90) & _c("lng").between(-180, 180),
        time=T.parse_time(_c("ts")), severity=S.police(_c("low")), rows=lambda df: df.withColumn("low", F.lower(_incident)), payload={"incident_type": _incident, "address": _c("addr"), "city": _c("city")},
    )
    POSTS = Feed(
        layer="social_bluesky", event_type="bluesky_post", schema="did string, rkey string, text string, lat double, lng double, ts string", quality="unknown",
        external_id=F.concat_ws(":", F.lit("bsky"), "did", "rkey"), lat=_c("lat"), lng=_c("lng"), time=T.parse_time(_c("ts")), severity=S.post(_c("low")), rows=lambda df: df.withColumn("low", F.lower(F.coalesce("text", F.lit("")))),
        subtype=T.first_listed(_c("low"), S.R.POST_SUBTYPES, whole_word=True), payload={"text": _c("text")},
        keep=T.first_listed(_c("low"), S.R.POST_KEYWORDS, whole_word=True).isNotNull() & _c("lat").isNotNull() & _c("lng").isNotNull(),
    )
    _sat_name = F.lower(F.coalesce("name", F.lit("")))
    SATELLITES = Feed(
        layer="satellites", event_type="satellite_position", kind="position", schema="norad string, name string, `group` string, lat double, lng double, alt_km double, vel_km_s double",
        external_id=F.trim("norad"), lat=_c("lat"), lng=_c("lng"), keep=_c("lat").isNotNull() & _c("lng").isNotNull(), severity=S.satellite(_sat_name),
        altitude_m=_c("alt_km") * 1000, velocity=_c("vel_km_s") * 1000, payload={"norad": _c("norad"), "name": _c("name"), "group": _c("group")},
    )
    _spot = T.coordinates_in(_c("text"))
    CITIZEN = Feed(
        layer="citizen_osint", event_type="citizen_post", kind="alert", schema="source string, uid string, text string, ts string",
        external_id=F.substring(F.md5(F.concat_ws(":", "source", "uid")), 1, 16), lat=_spot["lat"], lng=_spot["lng"], keep=_spot.isNotNull(),
        time=T.parse_time(_c("ts")), severity=S.citizen(_c("low")), rows=lambda df: df.withColumn("low", F.lower("text")), payload={"text": _c("text"), "platform": _c("source")},
    )

    return {
        "quakes": QUAKES, "quakes_b": QUAKES_B, "fires": FIRES, "natural": NATURAL, "alerts": ALERTS, "space": SPACE, "space_alerts": SPACE_ALERTS,
        "near_objects": NEAR_OBJECTS, "metar": METAR, "air": AIR, "storms": STORMS, "volcanoes": VOLCANOES, "disasters": DISASTERS,
        "declarations": DECLARATIONS, "vulnerabilities": VULNERABILITIES, "filings": FILINGS, "stories": STORIES, "news": NEWS, "forecasts": FORECASTS,
        "airports": AIRPORTS, "macro": MACRO, "incidents": INCIDENTS, "posts": POSTS, "citizen": CITIZEN, "satellites": SATELLITES,
    }


# ---------------------------------------------------------------- bulk news (tab separated)
# Positions of the fields used, of 61, and the precision of each kind of place.
BULK_FIELDS = 61
BULK_POSITIONS = {
    "event_id": 0, "actor1_name": 6, "actor2_name": 16, "code": 26, "geo_type": 51, "title": 52, "iso_country": 53, "lat": 56, "lng": 57,
    "added": 59, "source_url": 60,
}
GEO_QUALITY = {"1": "country", "2": "region", "3": "city", "4": "city", "5": "region"}


def bulk_rows(lines: DataFrame) -> DataFrame:
    """Headerless 61-column lines (`value`) as typed fields, with the reason a row is rejected."""
    parts = F.split("value", "\t", -1)
    fields = lines.select(F.size(parts).alias("width"), *[F.trim(F.get(parts, F.lit(i))).alias(n) for n, i in BULK_POSITIONS.items()])
    lat, lng, at = _num("lat"), _num("lng"), F.when(_c("added").rlike("^[0-9]{14}$"), F.try_to_timestamp("added", F.lit("yyyyMMddHHmmss")))
    reason = (
        F.when(_c("width") < BULK_FIELDS, "short_row").when(lat.isNull() | lng.isNull(), "no_coordinates")
        .when(F.coalesce("source_url", F.lit("")) == "", "no_source").when(at.isNull(), "bad_date")
    )
    blank = lambda c: F.nullif(_c(c), F.lit(""))
    return fields.select(
        "event_id", at.alias("timestamp"), F.coalesce(blank("code"), F.lit("999")).alias("code"), F.coalesce("title", F.lit("")).alias("title"),
        "source_url", blank("actor1_name").alias("actor1_name"), blank("actor2_name").alias("actor2_name"), lat.alias("lat"), lng.alias("lng"),
        S.mapped(_c("geo_type"), GEO_QUALITY, "unknown").alias("geocode_quality"), blank("iso_country").alias("iso_country"), reason.alias("rejected"),
    )


def rejected_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- text feeds
# Measures of a buoy line, in order after the five time fields.
BUOY_MEASURES = (
    "wind_dir", "wind_speed_ms", "gust_speed_ms", "wave_height_m", "dom_period_sec", "avg_period_sec", "wave_dir", "pressure_hpa", "air_temp_c",
    "sea_temp_c", "dewpoint_c", "vis_nmi", "pressure_tendency_hpa", "tide_ft",
)
BUOY_WHOLE = ("wind_dir", "dom_period_sec", "avg_period_sec", "wave_dir")


def buoy_observations(lines: DataFrame, per_file: int | None = None) -> DataFrame:
    """Observation lines (`station_id`, `value`); 'MM' is missing and short lines are tolerated.

    All observations are kept. With `per_file` the newest so many of each station and landed
    file (`file`) are, which is what one poll of the feed takes over.
    """
    parts = F.split(F.trim("value"), "\\s+")
    when = F.try_make_timestamp(*[F.get(parts, F.lit(i)).try_cast("int") for i in range(5)], F.lit(0))

    def measure(i: int, name: str) -> Column:
        value = F.nullif(F.get(parts, F.lit(5 + i)), F.lit("MM")).try_cast("double")
        return (value.cast("int") if name in BUOY_WHOLE else value).alias(name)

    rows = lines.filter(~F.trim("value").startswith("#") & (F.size(parts) >= 5)).select(
        "station_id", *(["file"] if per_file is not None else []), when.alias("event_time"), *[measure(i, n) for i, n in enumerate(BUOY_MEASURES)]
    ).filter(_c("event_time").isNotNull())
    if per_file is not None:
        rows = top_per_group(rows, ["station_id", "file"], [F.desc("event_time")], per_file).drop("rank")
    return rows.drop("file").withColumn("severity", S.at_least(_c("wave_height_m"), "wave_height"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_V4 = f"^({_OCTET}\\.){{3}}{_OCTET}/(3[0-2]|[12]?[0-9])$"
_V6 = "^(?=.*:)([0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}/(12[0-8]|1[01][0-9]|[1-9]?[0-9])$"


def block_list(lines: DataFrame) -> DataFrame:
    """'network ; entry' lines; comments, blanks and malformed networks are dropped."""
    text = F.trim("value")
    line = "^\\s*([0-9a-fA-F:.]+/[0-9]+)\\s*;\\s*(SBL[0-9A-Z]+)\\s*$"
    rows = lines.filter(~text.startswith(";")).select(F.regexp_extract(text, line, 1).alias("cidr"), F.regexp_extract(text, line, 2).alias("entry_id"))
    return rows.filter(_c("cidr").rlike(_V4) | _c("cidr").rlike(_V6)).filter(_c("entry_id") != "")


# ---------------------------------------------------------------- positions
def aircraft_positions(raw: DataFrame) -> DataFrame:
    """First row per aircraft in feed order (`feed_rank`, `seq`), with flags and severity."""
    rows = raw.withColumn("icao24", F.lower(F.trim("icao24"))).filter(_c("icao24") != "")
    rest = [c for c in rows.columns if c != "icao24"]
    first = rows.groupBy("icao24").agg(F.min_by(F.struct(*rest), F.struct("feed_rank", "seq")).alias("r")).select("icao24", "r.*")
    placed = first.filter(_c("lat").isNotNull() & _c("lng").isNotNull())
    military = S.military_aircraft(_c("callsign"), _c("icao24"), F.coalesce("db_flags", F.lit(0)))
    emergency = F.coalesce(_c("squawk").isin(*S.R.EMERGENCY_SQUAWKS), F.lit(False))
    flagged = placed.withColumns({"military": military, "emergency": emergency})
    return flagged.withColumn("severity", S.aircraft(_c("emergency"), _c("military"), F.coalesce("on_ground", F.lit(False)))).withColumn(
        "altitude_m", F.coalesce("baro_altitude", "geo_altitude")
    )


# Knots to metres per second.
KNOT = 0.514444


def vessel_positions(positions: DataFrame, static: DataFrame, type_severity: dict[int, int] | None = None) -> DataFrame:
    """One row per vessel in feed order, completed from static data, with the suspicion flag."""
    rows = positions.withColumn("mmsi", F.trim(_c("mmsi").cast("string"))).filter(_c("mmsi") != "")
    rest = [c for c in rows.columns if c != "mmsi"]
    first = rows.groupBy("mmsi").agg(F.min_by(F.struct(*rest), F.struct("feed_rank", "seq")).alias("r")).select("mmsi", "r.*")
    info = static.withColumn("draught", F.when(_c("draught_dm") > 0, _c("draught_dm") / 10.0)).withColumn(
        "destination", F.when(F.upper(F.trim("destination")) != "UNKNOWN", _c("destination"))
    ).withColumn("imo", F.when(_c("imo") > 0, _c("imo")))
    from tidemark.operators.merge import fill_missing

    full = fill_missing(first, latest_by(info, ["mmsi"], ["seen_at"]), "mmsi", ["name", "imo", "callsign", "ship_type", "destination", "draught"])
    dark = S.suspicious_vessel(_c("mmsi"), _c("ship_type"), _c("sog"), _c("name"))
    base = S.mapped(_c("ship_type"), type_severity, 0) if type_severity else F.lit(0)
    return full.withColumn("dark", dark).withColumns(
        {"severity": F.when(dark, F.greatest(base, F.lit(7))).otherwise(base), "velocity_ms": _c("sog") * KNOT}
    )


def reference_layer(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON file of points of interest as (name, lat, lng, properties)."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = _features(spark.read.schema(schema).option("multiLine", "true").json(path))
    first = F.get(_pair_lists(F.concat(F.lit("["), _c("geometry.coordinates"), F.lit("]"))), F.lit(0))
    return rows.select(
        F.try_element_at("properties", F.lit("name")).alias("name"), F.get(first, F.lit(1)).alias("lat"), F.get(first, F.lit(0)).alias("lng"), "properties"
    ).filter(_c("lat").isNotNull())
