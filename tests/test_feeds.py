"""Landed files of each kind, read and conformed."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.schema import EVENT_COLUMNS
from tidemark.sources import feeds as M
from tidemark.sources import licence, lists

NOW = datetime(2026, 5, 20, 12, 0, 0)

POINT = {"type": "Point", "coordinates": [20.0, 10.0, 7.0]}
SAMPLES = {
    "quakes": ({"features": [{"id": "q1", "properties": {"mag": 6.1, "place": "p", "time": 1770000000000, "tsunami": 1, "alert": "red"}, "geometry": POINT}]}, ("q1", 10, 10.0, 20.0)),
    "quakes_b": ({"features": [{"id": "x", "properties": {"source_id": "77", "mag": 5.2, "time": "2026-05-08T01:00:00.0Z"}, "geometry": POINT}]}, ("emsc:77", 6, 10.0, 20.0)),
    "natural": ({"events": [{"id": "E1", "title": "t", "categories": [{"id": "wildfires"}, {"id": "severeStorms"}], "geometry": [
        {"date": "2026-05-01T00:00:00Z", "type": "Point", "coordinates": [1.0, 2.0]}, {"date": "2026-05-02T00:00:00Z", "type": "Polygon", "coordinates": [[[20.0, 10.0], [21.0, 10.0], [21.0, 11.0]]]}]}]}, ("E1", 8, 10.0, 20.0)),
    "alerts": ({"features": [{"id": "a", "properties": {"id": "A1", "event": "Flood", "severity": "Severe", "urgency": "Immediate", "sent": "2026-05-08T01:00:00-04:00"},
                              "geometry": {"type": "Polygon", "coordinates": [[[19.0, 9.0], [21.0, 9.0], [21.0, 11.0], [19.0, 11.0]]]}}]}, ("A1", 8, 10.0, 20.0)),
    "space": ({"_event_type": "FLR", "flrID": "F1", "classType": "X1.2", "peakTime": "2026-05-07T16:37Z"}, ("donki:FLR:F1", 9, None, None)),
    "space_alerts": ({"product_id": "K07W", "issue_datetime": "2026-05-07 16:37:40.453", "message": "m"}, ("swpc:K07W:2026-05-07 16:37:40.453", 8, 60.0, 0.0)),
    "near_objects": ({"id": "9", "name": "n", "is_potentially_hazardous_asteroid": True, "estimated_diameter": {"meters": {"estimated_diameter_min": 100.0, "estimated_diameter_max": 200.0}},
                      "close_approach_data": [{"close_approach_date_full": "2026-May-13 19:49", "miss_distance": {"kilometers": "1000"}}]}, ("neo:9", 8, None, None)),
    "metar": ({"icaoId": "KJFK", "lat": 10.0, "lon": 20.0, "obsTime": "1770000000", "fltCat": "LIFR"}, ("metar:KJFK", 7, 10.0, 20.0)),
    "air": ({"uid": 5, "lat": 10.0, "lon": 20.0, "aqi": "151", "station": {"name": "s", "time": "2026-05-08T01:00:00Z"}}, ("waqi:5", 6, 10.0, 20.0)),
    "storms": ({"id": "al01", "name": "BOB", "classification": "HU", "intensity": "100", "latitude": "10.0N", "longitude": "20.0W"}, ("nhc:al01", 9, 10.0, -20.0)),
    "volcanoes": ({"volcano_name": "V", "vnum": "1", "alert_level": "WATCH", "color_code": "ORANGE", "notice_identifier": "N"}, ("usgs_volcano:1:N", 9, None, None)),
    "declarations": ({"DisasterDeclarationsSummaries": [{"disasterNumber": 1, "state": "TX", "declarationType": "DR", "incidentType": "Flood", "femaDeclarationString": "DR-1-TX"},
                                                        {"disasterNumber": 1, "state": "TX", "declarationType": "DR", "incidentType": "Flood", "femaDeclarationString": "DR-1-TX"}]}, ("openfema:DR-1-TX", 8, None, None)),
    "vulnerabilities": ({"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2026-05-10", "knownRansomwareCampaignUse": "Known", "vendorProject": "V"}, {"cveID": " "}]}, ("kev:CVE-1", 10, None, None)),
    "filings": ({"id": "f", "form": "8-K", "updated": "2026-05-10T00:00:00Z"}, ("f", 6, None, None)),
    "stories": ({"id": 1, "score": 350, "type": "story", "title": "Ask HN: x", "time": 1770000000}, ("hn:1", 8, None, None)),
    "news": ({"article_id": "n", "title": "t", "pubDate": "2026-05-05 09:25:00", "country": ["spain"], "category": ["sports", "crime"], "centroid": {"lat": 10.0, "lng": 20.0}}, ("newsdata:n", 7, 10.0, 20.0)),
    "forecasts": ({"city": "C", "city_lat": 10.0, "city_lng": 20.0, "daily": {"time": ["2026-05-05"], "temperature_2m_max": [41.0]}}, ("om-forecast:C:2026-05-05", 8, 10.0, 20.0)),
    "macro": ({"series_id": "S", "date": "2026-05-05", "value": "2.0", "prior_value": "1.0", "market_severity": 4}, ("S:2026-05-05", 4, None, None)),
    "posts": ({"did": "d", "rkey": "r", "text": "Missile alert", "lat": 10.0, "lng": 20.0}, ("bsky:d:r", 6, 10.0, 20.0)),
    "citizen": ({"source": "x", "uid": "1", "text": "Shelling near 10.00, 20.00"}, (None, 7, 10.0, 20.0)),
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_json_feeds(spark, tmp_path, name):
    raw, (ident, severity, lat, lng) = SAMPLES[name]
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(raw))
    feed = M.feeds()[name]
    rows = M.conform(M.read(spark, feed, str(path)), feed, F.lit(NOW).cast("timestamp")).collect()
    assert len(rows) == 1 and list(rows[0].asDict()) == EVENT_COLUMNS
    got = rows[0]
    assert ident in (None, got["external_id"]) and got["severity"] == severity
    assert (got["lat"], got["lng"]) == (pytest.approx(lat) if lat is not None else None, pytest.approx(lng) if lng is not None else None)
    assert got["event_time"] is not None and got["layer"] == feed.layer


def test_csv_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "latitude,longitude,bright_ti4,brightness,acq_date,acq_time,satellite,instrument,confidence,frp,daynight,dataset\n"
        "10.0,20.0,345,,2026-05-01,930,N,VIIRS,h,1.5,D,viirs\n10.0,20.0,345,,2026-05-01,930,N,VIIRS,h,1.5,D,viirs\n0,0,345,,2026-05-01,930,N,V,h,1,D,v\n")
    feed = M.feeds()["fires"]
    row = M.conform(M.read(spark, feed, str(tmp_path / "f.csv")), feed, F.lit(NOW).cast("timestamp")).collect()
    assert len(row) == 1 and row[0]["severity"] == 8 and row[0]["event_time"] == datetime(2026, 5, 1, 9, 30)


def test_disaster_xml(spark, tmp_path):
    (tmp_path / "g.xml").write_text(
        '<rss xmlns:gdacs="g" xmlns:geo="w"><channel><item><title>T</title><geo:Point><geo:lat>10.0</geo:lat><geo:long>20.0</geo:long></geo:Point><gdacs:eventtype>EQ</gdacs:eventtype>'
        "<gdacs:eventid>5</gdacs:eventid><gdacs:episodeid>2</gdacs:episodeid><gdacs:alertlevel>Orange</gdacs:alertlevel><gdacs:fromdate>Mon, 04 May 2026 10:11:12 GMT</gdacs:fromdate></item></channel></rss>")
    feed = M.feeds()["disasters"]
    row = M.conform(M.read(spark, feed, str(tmp_path / "g.xml")), feed, F.lit(NOW).cast("timestamp")).collect()
    assert [(r["external_id"], r["severity"], r["lat"], r["lng"]) for r in row] == [("gdacs:EQ:5:2", 7, 10.0, 20.0)]


def test_text_feeds(spark):
    lines = spark.createDataFrame([(l,) for l in ("; comment", "1.10.16.0/20 ; SBL256894", "300.1.1.0/20 ; SBL1", "2a00:1::/32 ; SBL2", "", "1.2.3.0/33 ; SBL3", "x")], "value string")
    assert {(r["cidr"], r["entry_id"]) for r in M.block_list(lines).collect()} == {("1.10.16.0/20", "SBL256894"), ("2a00:1::/32", "SBL2")}
    buoy = spark.createDataFrame([("s", "#YY MM DD hh mm"), ("s", "2026 05 01 12 00 270 4.0 MM 6.5"), ("s", "2026 05"), ("s", "2026 13 01 12 00 1")], "station_id string, value string")
    row = M.buoy_observations(buoy).collect()
    assert len(row) == 1 and (row[0]["wind_dir"], row[0]["gust_speed_ms"], row[0]["wave_height_m"], row[0]["severity"], row[0]["tide_ft"]) == (270, None, 6.5, 8, None)


def test_bulk_rows(spark):
    def line(**cells):
        full = {0: "1", 26: "190", 51: "4", 52: "Mariupol", 53: "UP", 56: "47.1", 57: "37.5", 59: "20260421150000", 60: "https://x.org/a"}
        full.update({int(k[1:]): v for k, v in cells.items()})
        return "\t".join(full.get(i, "") for i in range(61))

    df = spark.createDataFrame([(x,) for x in (line(), line(_56=""), line(_60=" "), line(_59="2026"), "a\tb", line(_26=""))], "value string")
    rows = M.bulk_rows(df)
    assert {r["rejected"]: r["n"] for r in M.rejected_counts(rows).collect()} == {None: 2, "no_coordinates": 1, "no_source": 1, "bad_date": 1, "short_row": 1}
    good = rows.filter("rejected is null").orderBy("code").collect()
    assert [(g["code"], g["geocode_quality"], g["timestamp"]) for g in good] == [("190", "city", datetime(2026, 4, 21, 15)), ("999", "city", datetime(2026, 4, 21, 15))]


def test_vessel_positions(spark):
    pos = spark.createDataFrame(
        [("1", 0, 1, None, None, None, None, 12.0, None, None), ("1", 1, 0, "B", 5, None, None, 1.0, None, None), ("2", 0, 2, " X ", 0, None, None, 9.0, None, None), ("", 0, 3, "N", 1, None, None, 1.0, None, None)],
        "mmsi string, feed_rank int, seq int, name string, imo int, callsign string, ship_type int, sog double, destination string, draught double")
    static = spark.createDataFrame([("1", " ALFA ", 9111, "CS", 70, "UNKNOWN", 118, NOW)], "mmsi string, name string, imo int, callsign string, ship_type int, destination string, draught_dm int, seen_at timestamp")
    rows = {r["mmsi"]: r for r in M.vessel_positions(pos, static, {70: 2}).collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"]["name"], rows["1"]["imo"], rows["1"]["draught"], rows["1"]["destination"], rows["1"]["severity"]) == ("ALFA", 9111, 11.8, None, 2)
    assert rows["2"]["name"] == "X" and rows["2"]["dark"] is False


def test_list_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<Sanctions xmlns="x"><LegalBasis ID="7" LegalBasisShortRef="Executive Order 13662 (Russia)"/><IDRegDocument IdentityID="30" IDRegDocTypeID="1626"><IDRegistrationNo>IMO 9123456</IDRegistrationNo></IDRegDocument>'
        '<DistinctParty FixedRef="100"><Profile ID="200" PartySubTypeID="1"><Identity ID="30" Primary="true"><Alias Primary="true"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">POLA</NamePartValue></DocumentedNamePart>'
        '<DocumentedNamePart><NamePartValue ScriptID="215">SOFIA</NamePartValue></DocumentedNamePart></DocumentedName></Alias><Alias Primary="false"><DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">OLD</NamePartValue></DocumentedNamePart>'
        '</DocumentedName></Alias></Identity></Profile></DistinctParty><SanctionsEntry ProfileID="200"><EntryEvent LegalBasisID="7"/></SanctionsEntry></Sanctions>')
    path = str(tmp_path / "a.xml")
    read = lambda tag, schema: lists.read_xml(spark, path, tag, schema)
    row = lists.list_a(read("DistinctParty", lists.PARTY), read("IDRegDocument", lists.DOCUMENT), read("LegalBasis", lists.BASIS), read("SanctionsEntry", lists.ENTRY)).first()
    assert (row["listed_id"], row["entity_type"], row["listed_name"], row["alt_names"], row["listed_imo"], row["regime"]) == ("100", "sanctioned_vessel", "POLA SOFIA", ["OLD"], "9123456", "RUSSIA")
    (tmp_path / "b.xml").write_text("<L xmlns='y'>" + "".join(
        f"<FinancialSanctionsTarget><GroupID>{g}</GroupID><GroupTypeDescription>{k}</GroupTypeDescription><GrpStatus>{s}</GrpStatus><Name6>{n}</Name6><Ship_IMONumber>IMO 9{g}</Ship_IMONumber><RegimeName>Russia</RegimeName></FinancialSanctionsTarget>"
        for g, k, s, n in (("1", "Ship", "A", "ONE"), ("1", "Ship", "A", "ALIAS"), ("2", "Entity", "A", "E"), ("3", "Ship", "R", "GONE"))) + "</L>")
    rows = lists.list_b(lists.read_xml(spark, str(tmp_path / "b.xml"), "FinancialSanctionsTarget", lists.LIST_B)).collect()
    assert [(r["listed_id"], r["listed_name"], r["listed_imo"]) for r in rows] == [("1", "ONE", "91")]
    (tmp_path / "c.xml").write_text(
        "<E xmlns='z'><sanctionEntity logicalId='5'><nameAlias wholeName='ИМЯ' nameLanguage='ru'/><nameAlias wholeName='NAME' nameLanguage='EN'/><identification identificationTypeCode='imo' number='9-12'/><regulation programme='RUS'/></sanctionEntity>"
        "<sanctionEntity logicalId='6'><nameAlias wholeName='FIRM' nameLanguage='en'/><regulation programme='RUS'/></sanctionEntity></E>")
    rows = lists.list_c(lists.read_xml(spark, str(tmp_path / "c.xml"), "sanctionEntity", lists.LIST_C)).collect()
    assert [(r["listed_id"], r["listed_name"], r["listed_imo"], r["regime"]) for r in rows] == [("5", "NAME", "912", "Russia")]


def test_reference_layer(spark, tmp_path):
    (tmp_path / "bases.geojson").write_text(json.dumps({"features": [{"properties": {"name": "Base"}, "geometry": {"type": "LineString", "coordinates": [[20.0, 10.0], [21.0, 11.0]]}}]}))
    row = M.reference_layer(spark, str(tmp_path / "bases.geojson")).first()
    assert (row["name"], row["lat"], row["lng"]) == ("Base", 10.0, 20.0)


def test_licence_gate(spark):
    reg = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False)], "source_id string, enabled boolean, commercial_use_ok boolean")
    feeds = spark.createDataFrame([("ok", ["a"]), ("both", ["a", "b"]), ("nc", ["c"]), ("none", []), ("new", ["z"])], "feed string, source_ids array<string>")
    assert {r["feed"]: r["reason"] for r in licence.gate(feeds, reg).collect()} == {"ok": None, "both": "disabled", "nc": "not_commercial", "none": "no_source_id", "new": "not_registered"}
    assert {r["feed"]: r["reason"] for r in licence.gate(feeds, reg, strict=False).collect()}["nc"] is None


def test_reference_layer_in_documents_of_bounded_size(spark, monkeypatch):
    import types

    from pyspark.sql import functions as F

    from tidemark.plans import scalar_queries

    rows = spark.range(1, 20_001).select(F.col("id").alias("s_suppkey"), F.col("id").cast("string").alias("s_name"), (F.col("id") % 25).alias("s_nationkey"))
    written, read = [], scalar_queries.feed_module.reference_layer
    monkeypatch.setattr(scalar_queries.feed_module, "reference_layer", lambda session, folder: written.append(folder) or read(session, folder))
    got = scalar_queries.r10(types.SimpleNamespace(spark=spark, raw=lambda name: rows))
    assert {r.name for r in got.collect()} == {str(k) for k in range(1, 20_001) if k % 9 != 4}
    sizes = spark.read.json(written[0]).select(F.size("features").alias("n")).collect()
    assert max(r.n for r in sizes) <= 1000 and sum(r.n for r in sizes) == 20_000
