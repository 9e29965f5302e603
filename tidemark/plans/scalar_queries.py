"""Queries for scalar functions, projections and scoring (S, P) and conformed sources (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import confidence as C
from tidemark.functions import geo as G
from tidemark.functions import ids, stats
from tidemark.functions import prefilter as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import records
from tidemark.operators.names import flag_consistent, flag_of
from tidemark.operators.watch import subscription_join
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, geodesic_sql, haversine_sql, jaccard_sql, trigrams_sql
from tidemark.sources import feeds as feed_module
from tidemark.sources import refdata as R

c = F.col


def r6(x, places: int = 6):
    return F.round(x, places)


@query("s1_uuid5", ("geo",), """
    SELECT event_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-'
      || substr('89ab', CAST(strpos('0123456789abcdef', substr(h,17,1)) - 1 AS INT) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id
    FROM (SELECT event_id, sha1(unhex('a4d92b161c4f4e2c8f3a1f0e2c4d8b6a') || encode(layer || ':' || CAST(event_id AS VARCHAR))) AS h FROM geo)""")
def s1(t: Tables) -> DataFrame:
    return t.geo.select("event_id", ids.event_id(c("layer"), c("event_id").cast("string")).alias("id"))


@query("s2_haversine_km", ("geo",), f"""
    SELECT event_id, round({haversine_sql('lat','lng','1.2655','103.824')}, 6) AS km, round({haversine_sql('lat','lng','1.2655','103.824', 6371.0088)}, 6) AS km_mean
    FROM geo""")
def s2(t: Tables) -> DataFrame:
    d = lambda r: G.haversine_km(c("lat"), c("lng"), F.lit(1.2655), F.lit(103.824), r)
    return t.geo.select("event_id", r6(d(G.EARTH_KM)).alias("km"), r6(d(G.EARTH_KM_MEAN)).alias("km_mean"))


@query("s3_geodesic_m", ("track", "ports"), f"""
    SELECT ping_id, round(distance_m, 3) AS metres FROM {geodesic_sql("(SELECT *, 51.95 AS q_lat, 4.15 AS q_lng FROM track)", 'lat', 'lng', 'q_lat', 'q_lng')}""")
def s3(t: Tables) -> DataFrame:
    return t.track.select("ping_id", r6(G.geodesic_m(c("lat"), c("lng"), F.lit(51.95), F.lit(4.15)), 3).alias("metres"))


@query("s4_within_m", ("track", "ports"), f"""
    SELECT ping_id FROM {geodesic_sql("(SELECT *, 1.2655 AS q_lat, 103.824 AS q_lng FROM track)", 'lat', 'lng', 'q_lat', 'q_lng')} WHERE distance_m <= 2000000""")
def s4(t: Tables) -> DataFrame:
    return t.track.filter(G.within_m(c("lat"), c("lng"), F.lit(1.2655), F.lit(103.824), 2_000_000)).select("ping_id")


@query("s5_web_mercator", ("geo",), """
    SELECT event_id, round(radians(lng) * 6378137.0, 3) AS x, round(ln(tan(pi()/4 + radians(lat)/2)) * 6378137.0, 3) AS y FROM geo""")
def s5(t: Tables) -> DataFrame:
    return t.geo.select("event_id", r6(G.mercator_x(c("lng")), 3).alias("x"), r6(G.mercator_y(c("lat")), 3).alias("y"))


def _ring_sql(points) -> str:
    """Crossing test of the point (lat, lng) with every edge of a closed ring, unrolled."""
    tests = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            tests.append(f"CAST(({ay} > lat) <> ({by} > lat) AND lng < ({bx} - ({ax})) * (lat - ({ay})) / ({by} - ({ay})) + ({ax}) AS INT)")
    return "((" + " + ".join(tests) + ") % 2 = 1)"


ZONE_CASES = " UNION ALL ".join(
    f"SELECT event_id, '{name}' AS zone FROM geo WHERE {_ring_sql(points)}" for name, _, _, points in R.ZONES
)


@query("s6_point_in_polygon", ("geo",), ZONE_CASES)
def s6(t: Tables) -> DataFrame:
    from tidemark.operators.spatial import within_zones

    return within_zones(t.geo, R.zones_df(t.spark)).select("event_id", "zone")


@query("s7_trigram_similarity", ("listed",), f"""
    SELECT listed_id, round({jaccard_sql('a', 'b')}, 6) AS similarity FROM (
      SELECT listed_id, {trigrams_sql('listed_name')} AS a, {trigrams_sql("'large plate 1'")} AS b FROM listed)""")
def s7(t: Tables) -> DataFrame:
    return t.listed.select("listed_id", r6(T.trigram_similarity(c("listed_name"), F.lit("large plate 1"))).alias("similarity"))


def _tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))"


@query("s8_token_jaccard", (), f"""
    SELECT doc_id, round({jaccard_sql('a', 'b')}, 6) AS similarity FROM (
      SELECT doc_id, {_tokens_sql('text')} AS a, {_tokens_sql("'the and with this of that from'")} AS b FROM documents)""")
def s8(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", r6(T.token_jaccard(c("text"), F.lit("the and with this of that from"))).alias("similarity"))


_DOT = "list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * x)))"


@query("s9_cosine_distance", (), f"""
    SELECT vec_id, round(1 - {_DOT} / ({_NORM('a')} * {_NORM('b')}), 6) AS distance
    FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) AS b FROM embeddings)""")
def s9(t: Tables) -> DataFrame:
    rows = t.raw("embeddings")
    seed = rows.agg(F.min_by("embedding", "vec_id")).scalar()
    seeded = rows.withColumn("seed", seed)
    return seeded.select("vec_id", r6(stats.cosine_distance(c("embedding"), c("seed"))).alias("distance"))


@query("s10_bbox_span_m", ("track",), """
    SELECT entity_id, round(greatest(max(lat) - min(lat), (max(lng) - min(lng)) * cos(radians(avg(lat)))) * 111000, 3) AS span_m FROM track GROUP BY 1""")
def s10(t: Tables) -> DataFrame:
    span = G.bbox_span_m(F.max("lat") - F.min("lat"), F.max("lng") - F.min("lng"), F.avg("lat"))
    return t.track.groupBy("entity_id").agg(r6(span, 3).alias("span_m"))


@query("s11_parse_time", (), """
    SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS digits, date_trunc('second', ts) AS rfc, date_trunc('minute', ts) AS named FROM events""")
def s11(t: Tables) -> DataFrame:
    at = c("ts").cast("timestamp")
    texts = {"iso": "yyyy-MM-dd'T'HH:mm:ss'.0Z'", "digits": "yyyyMMddHHmmss", "rfc": "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "named": "yyyy-MMM-dd HH:mm"}
    return t.raw("events").select("event_id", *[T.parse_time(F.date_format(at, f)).alias(n) for n, f in texts.items()])


@query("s12_time_floors", (), """
    SELECT event_id, date_trunc('second', ts) AS s, date_trunc('minute', ts) AS m, time_bucket(INTERVAL 5 MINUTE, ts) AS five FROM events""")
def s12(t: Tables) -> DataFrame:
    at = c("ts").cast("timestamp")
    five = F.timestamp_seconds(F.floor(F.unix_seconds(at) / 300) * 300)
    return t.raw("events").select("event_id", F.date_trunc("second", at).alias("s"), F.date_trunc("minute", at).alias("m"), five.alias("five"))


_AGE = "(epoch_us((SELECT max(ts) FROM events)) - epoch_us(event_time)) / 3.6e9"


@query("s13_decay_weights", ("geo",), f"""
    SELECT event_id, round(exp(-greatest(0, a) / 12.0), 6) AS e_fold, round(greatest(0.0, least(1.0, 1 - a / 6.0)), 6) AS linear,
      round_even(CASE WHEN a <= 1 THEN 0 WHEN a <= 6 THEN 0.02 * (a - 1) WHEN a <= 24 THEN 0.10 + 0.01 * (a - 6) ELSE 0.28 + 0.005 * least(a - 24, 48) END, 3) AS pieces
    FROM (SELECT event_id, {_AGE} AS a FROM geo)""")
def s13(t: Tables) -> DataFrame:
    age = P.hours_between(t.as_of, c("event_time"))
    rows = t.geo.select("event_id", age.alias("a"))
    return rows.select(
        "event_id", r6(stats.exp_decay(c("a"))).alias("e_fold"), r6(stats.linear_decay(c("a"))).alias("linear"), C.age_decay(c("a")).alias("pieces")
    )


@query("s14_json_access", (), """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"layer":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS doc,
      list_contains([CAST(user_id AS VARCHAR), '7'], '7') AS has FROM events""")
def s14(t: Tables) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return t.raw("events").select(
        "event_id", k.alias("k"), F.to_json(F.struct(c("event_type").alias("layer"), k.alias("k"))).alias("doc"),
        F.array_contains(F.array(c("user_id").cast("string"), F.lit("7")), "7").alias("has"),
    )


@query("s15_text_templates", ("entity",), """
    SELECT entity_id, 'Vessel ' || display_name AS strict, 'Vessel ' || coalesce(display_name, 'MMSI ' || canonical_id) AS lenient FROM entity""")
def s15(t: Tables) -> DataFrame:
    return t.entity.select(
        "entity_id", F.concat(F.lit("Vessel "), "display_name").alias("strict"),
        F.concat(F.lit("Vessel "), F.coalesce("display_name", F.concat(F.lit("MMSI "), "canonical_id"))).alias("lenient"),
    )


@query("s16_binomial_tail", ("geo",), """
    SELECT layer, k, n, round((SELECT sum(exp(lgamma(n+1) - lgamma(i+1) - lgamma(n-i+1) + i*ln(0.2) + (n-i)*ln(0.8))) FROM range(k, n+1) AS r(i)), 5) AS p
    FROM (SELECT layer, count(*) FILTER (WHERE severity >= 8) AS k, count(*) AS n FROM geo GROUP BY 1)""")
def s16(t: Tables) -> DataFrame:
    rows = t.geo.groupBy("layer").agg(F.count_if(c("severity") >= 8).alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.select("layer", "k", "n", r6(stats.binomial_upper_tail(c("k"), c("n"), F.lit(0.2)), 5).alias("p"))


@query("s17_quantile_by_index", ("geo",), """
    SELECT entity_id, list_sort(list(severity))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p90 FROM geo GROUP BY 1""")
def s17(t: Tables) -> DataFrame:
    """Severities are eleven values: the index is found in their running counts, not in a list of rows."""
    levels = t.geo.groupBy("entity_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    per = levels.groupBy("entity_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("severity", "n"))).alias("levels"))
    at = F.floor(F.lit(0.9) * (c("total") - 1))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("value"))
    value = F.aggregate(
        "levels", start,
        lambda acc, x: F.when(acc["seen"] > at, acc).otherwise(F.struct((acc["seen"] + x["n"]).alias("seen"), x["severity"].alias("value"))),
    )["value"]
    return per.select("entity_id", value.alias("p90"))


@query("s18_event_text", ("finding",), """
    SELECT id, trim(title) || '. ' || trim(description) AS body FROM finding WHERE event_type = 'newsdata'""")
def s18(t: Tables) -> DataFrame:
    return t.finding.filter(c("event_type").isin(*R.TEXT_EVENT_TYPES)).select("id", T.event_text(c("title"), c("description")).alias("body"))


@query("s19_embedding_backfill", (), """
    SELECT doc_id, CAST(256 AS INT) AS width FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def s19(t: Tables) -> DataFrame:
    from tidemark.operators.embedding import backfill

    return backfill(t.raw("documents").select(c("doc_id").alias("id"), c("text").alias("body")), t.raw("embeddings").select(c("vec_id").alias("id"))).select(
        c("id").alias("doc_id"), F.size("embedding").alias("width")
    )


_STEPS = lambda x, steps, low: "CASE " + " ".join(f"WHEN {x} >= {a} THEN {v}" for a, v in steps) + f" ELSE {low} END"


@query("p1_severity_rules", ("geo",), f"""
    SELECT event_id, {_STEPS('v / 60', S.AT_LEAST['quake'][0], 1)} AS quake,
      CASE WHEN v/60 < 2.5 THEN 1 WHEN v/60 < 4 THEN 3 WHEN v/60 < 5 THEN 5 WHEN v/60 < 6 THEN 6 WHEN v/60 < 7 THEN 7 WHEN v/60 < 8 THEN 9 ELSE 10 END AS quake_b,
      {_STEPS('v / 40', S.AT_LEAST['wave_height'][0], 1)} AS wave, CASE WHEN v <= 50 THEN 1 WHEN v <= 100 THEN 3 WHEN v <= 150 THEN 5 WHEN v <= 200 THEN 6 WHEN v <= 300 THEN 8 ELSE 10 END AS aqi,
      CASE WHEN v < 35 THEN 3 WHEN v < 64 THEN 5 WHEN v < 83 THEN 7 WHEN v < 96 THEN 8 WHEN v < 113 THEN 9 ELSE 10 END AS wind,
      CASE WHEN t >= 45 THEN 9 WHEN t >= 40 THEN 8 WHEN t >= 35 THEN 6 WHEN t >= 30 THEN 4 WHEN t <= -25 THEN 9 WHEN t <= -20 THEN 8 WHEN t <= -10 THEN 5 ELSE 1 END AS temp,
      CASE WHEN v > 200 THEN least(10, {_STEPS('v + 100', S.AT_LEAST['fire_brightness'][0], 4)} + 1) WHEN v < 20 THEN greatest(1, {_STEPS('v + 100', S.AT_LEAST['fire_brightness'][0], 4)} - 2)
        ELSE {_STEPS('v + 100', S.AT_LEAST['fire_brightness'][0], 4)} END AS fire,
      greatest(1, least(10, CASE layer WHEN 'error' THEN 10 WHEN 'click' THEN 5 ELSE 7 END + event_id % 4)) AS volcano,
      least(10, 7 + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN date_diff('day', CAST(event_time AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) BETWEEN 0 AND 30 THEN 1 ELSE 0 END) AS kev
    FROM (SELECT *, value AS v, lat / 2 AS t FROM geo)""")
def p1(t: Tables) -> DataFrame:
    v = c("value")
    level = F.when(c("layer") == "error", "WARNING").when(c("layer") == "click", "ADVISORY").otherwise("watch")
    colour = F.element_at(F.array(*map(F.lit, S.VOLCANO_COLOUR)), (c("event_id") % 4 + 1).cast("int"))
    confidence = F.when(v > 200, "h").when(v < 20, "12").otherwise("n")
    return t.geo.select(
        "event_id", S.at_least(v / 60, "quake").alias("quake"), S.at_least(v / 60, "quake_list_b").alias("quake_b"), S.at_least(v / 40, "wave_height").alias("wave"),
        S.at_most(v, *S.AT_MOST["aqi"]).alias("aqi"), S.at_least(v, "wind_kt").alias("wind"), S.temperature(c("lat") / 2).alias("temp"),
        S.fire(v + 100, confidence).alias("fire"), S.volcano(level, colour).cast("bigint").alias("volcano"),
        S.exploited_vulnerability(F.when(c("event_id") % 2 == 0, "Known").otherwise("Unknown"), F.to_date("event_time"), F.to_date(t.as_of)).alias("kev"),
    )


_RX = lambda words: "|".join(words)


@query("p2_keyword_classes", (), f"""
    SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '{_RX(w)}') THEN {v}" for w, v in R.POLICE_TIERS)} ELSE {R.POLICE_DEFAULT} END AS police,
      CASE {' '.join(f"WHEN regexp_matches(t, '{_RX(w)}') THEN {v}" for w, v in R.CITIZEN_TIERS)} ELSE {R.CITIZEN_DEFAULT} END AS citizen,
      CASE WHEN regexp_matches(t, '\\b({_RX(R.POST_GRAVE_KEYWORDS)})\\b') THEN 6 WHEN regexp_matches(t, '\\b({_RX(R.POST_KEYWORDS)})\\b') THEN 4 ELSE 1 END AS post,
      CASE {' '.join(f"WHEN regexp_matches(t, '{_RX(w)}') THEN '{s}'" for s, w, *_ in R.TOPICS)} END AS topic
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def p2(t: Tables) -> DataFrame:
    x = c("low")
    return t.raw("documents").select("doc_id", F.lower("text").alias("low")).select(
        "doc_id", S.police(x).alias("police"), S.citizen(x).alias("citizen"), S.post(x).alias("post"), S.topic(x).alias("topic")
    )


@query("p3_coordinates_in_text", ("geo",), """
    SELECT event_id, CASE WHEN lat BETWEEN -90 AND 90 THEN round(lat, 2) END AS lat, CASE WHEN lat BETWEEN -90 AND 90 THEN round(lng, 2) END AS lng, round(lat, 1) AS hemi
    FROM geo""")
def p3(t: Tables) -> DataFrame:
    text = F.concat(F.lit("seen at "), F.format_string("%.2f", "lat"), F.lit(", "), F.format_string("%.2f", "lng"), F.lit(" today"))
    hemi = F.concat(F.format_string("%.1f", F.abs("lat")), F.when(c("lat") < 0, "S").otherwise("N"))
    rows = t.geo.select("event_id", T.coordinates_in(text).alias("p"), T.hemisphere_degrees(hemi).alias("hemi"))
    return rows.select("event_id", "p.lat", "p.lng", "hemi")


@query("p4_confidence", ("geo",), f"""
    SELECT event_id, score, CASE WHEN score >= .8 THEN 'CONFIRMED' WHEN score >= .65 THEN 'HIGH' WHEN score >= .5 THEN 'MODERATE' WHEN score >= .35 THEN 'LOW' ELSE 'SPECULATIVE' END AS label,
      CASE WHEN score >= .8 THEN 10.0 WHEN score >= .65 THEN 9.0 WHEN score >= .5 THEN 7.0 WHEN score >= .35 THEN 5.0 ELSE 3.5 END AS cap
    FROM (SELECT event_id, round_even(greatest(0.05, least(0.98,
      CASE event_id % 3 WHEN 0 THEN 0.90 WHEN 1 THEN 0.55 ELSE 0.45 END + CASE WHEN event_id % 2 = 0 THEN 0.12 ELSE 0 END
      + CASE event_id % 4 WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN 0.05 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN -0.08 ELSE 0 END
      + CASE event_id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.07 ELSE 0 END
      + CASE WHEN event_id % 7 >= 3 THEN CASE WHEN event_id % 7 >= 5 THEN 0.10 ELSE 0.05 END ELSE 0 END
      + CASE event_id % 4 WHEN 3 THEN 0.20 WHEN 2 THEN 0.14 WHEN 1 THEN 0.08 ELSE CASE WHEN event_id % 3 <> 0 THEN -0.08 ELSE 0 END END
      - round_even(CASE WHEN a <= 1 THEN 0 WHEN a <= 6 THEN 0.02 * (a - 1) WHEN a <= 24 THEN 0.10 + 0.01 * (a - 6) ELSE 0.28 + 0.005 * least(a - 24, 48) END, 3))), 3) AS score
      FROM (SELECT event_id, {_AGE} AS a FROM geo))""")
def p4(t: Tables) -> DataFrame:
    i = c("event_id")
    e = C.evidence(
        platform=F.when(i % 3 == 0, "ads_b").when(i % 3 == 1, "gdelt").otherwise("elsewhere"), has_media=i % 2 == 0, has_coordinates=F.lit(True),
        precision_km=F.when(i % 4 == 0, 0.5).when(i % 4 == 1, 10.0).when(i % 4 == 2, 50.0).otherwise(80.0), has_url=i % 5 != 0,
        source_tier=(i % 3 + 1).cast("int"), articles=i % 7, other_sources=i % 4, age_hours=c("age_h"),
    )
    score = C.score(C.factors(e))
    aged = t.geo.withColumn("age_h", P.hours_between(t.as_of, c("event_time")))
    rows = aged.select("event_id", score.alias("score"))
    return rows.select("event_id", "score", C.label(c("score")).alias("label"), C.severity_cap(c("score")).alias("cap"))


RULES = P.PrefilterRules(
    subcategories=("armed_conflict.airstrike", "armed_conflict.shelling", "diplomatic.talks", "disaster.flood"), flags_required=("military",), min_severity=0.4,
    category_severity={"disaster": 0.7, "diplomatic": 0.2}, iso_block=("RU",), min_source_score=0.5, max_age_hours=480.0, bboxes=((-180.0, -60.0, 180.0, 80.0),),
)
SHADOW = P.PrefilterRules(mode="block", subcategories=("diplomatic.visit",), min_severity=0.3, precision_min="city", max_age_hours=240.0)


def source_score(url):
    """Quality of a domain; the table is a parameter of the filter."""
    return S.mapped(T.domain_of(url), {f"site{i}.org": i / 8 for i in range(7)}, 0.3)


def judged(t: Tables) -> DataFrame:
    score = source_score(c("source_url"))
    rows = t.news.withColumn("reject_reason", P.reject_reason(RULES, t.as_of, score)).withColumn("shadow_reason", P.reject_reason(SHADOW, t.as_of, score))
    return rows.withColumn("rule", P.rule_of(c("reject_reason")))


_HOURS = "(epoch_us((SELECT max(ts) FROM events)) - epoch_us(timestamp)) / 3.6e9"
_SCORE = "CASE WHEN seq % 8 = 7 THEN 0.3 ELSE (seq % 8) / 8.0 END"
JUDGED_SQL = f"""judged AS (SELECT *, CASE
      WHEN subcategory NOT IN ('armed_conflict.airstrike', 'armed_conflict.shelling', 'diplomatic.talks', 'disaster.flood') THEN 'category_not_allowed'
      WHEN NOT is_military THEN 'flag_required_missing'
      WHEN severity < CASE category WHEN 'disaster' THEN 0.7 WHEN 'diplomatic' THEN 0.2 ELSE 0.4 END THEN 'severity_below_threshold'
      WHEN geocode_quality IN ('country', 'unknown') THEN 'geocode_below_precision_floor' WHEN upper(iso_country) = 'RU' THEN 'iso_country_blocked'
      WHEN lat NOT BETWEEN -60 AND 80 THEN 'bbox_not_allowed' WHEN {_SCORE} < 0.5 THEN 'source_quality_below_min' WHEN {_HOURS} > 480 THEN 'event_too_old' END AS reject_reason,
    CASE WHEN subcategory = 'diplomatic.visit' THEN 'category_blocked' WHEN severity < 0.3 THEN 'severity_below_threshold'
      WHEN geocode_quality NOT IN ('exact', 'city') THEN 'geocode_below_precision_floor' WHEN {_SCORE} < 0.5 THEN 'source_quality_below_min' WHEN {_HOURS} > 240 THEN 'event_too_old' END AS shadow_reason
    FROM news)"""


@query("p5_prefilter_chain", ("news",), "SELECT event_id, reject_reason, shadow_reason FROM judged", JUDGED_SQL)
def p5(t: Tables) -> DataFrame:
    return judged(t).select("event_id", "reject_reason", "shadow_reason")


@query("p6_priority", ("news",), f"""
    SELECT event_id, round(source, 6) AS source, round(duplication, 6) AS duplication, round(recency, 6) AS recency,
      round(0.3 * severity + 0.2 * source + 0.2 * duplication + 0.1 * recency + 0.1 * bonus + 0.1 * area, 6) AS final
    FROM (SELECT event_id, severity, {_SCORE} AS source, least(1.0, ln(1 + seq % 14) / ln(11)) AS duplication, greatest(0.0, least(1.0, 1 - {_HOURS} / 6)) AS recency,
      CASE WHEN category = 'disaster' THEN 0.5 ELSE 0.0 END AS bonus, CASE WHEN lat > 0 THEN 1.0 ELSE 0.0 END AS area FROM news)""")
def p6(t: Tables) -> DataFrame:
    parts = P.priority_parts(
        P.PriorityWeights(), t.as_of, source_score(c("source_url")), (c("seq") % 14), F.when(c("category") == "disaster", 0.5).otherwise(0.0), c("lat") > 0
    )
    rows = t.news.select("event_id", parts.alias("p"))
    return rows.select("event_id", *[r6(c("p." + n)).alias(n) for n in ("source", "duplication", "recency", "final")])


@query("p7_domain", (), """
    SELECT page_id, regexp_replace(split_part(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':', 1), '^www\\.', '') AS domain FROM pages""")
def p7(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.domain_of(c("url")).alias("domain"))


def subscriptions(t: Tables) -> DataFrame:
    """Subscriptions of all customers: boxes, some across the date line, circles, and one in fifty of the whole world."""
    i = c("c_custkey")
    types = F.array(F.lit("usgs_quake"), F.lit("port_call"))
    west, south = (i * 13 % 360 - 180).cast("double"), (i * 7 % 150 - 80).cast("double")
    return t.raw("customer").select(
        i.alias("sub_id"), F.when(i % 2 == 0, types).otherwise(F.array(F.lit("nasa_firms"))).alias("categories"),
        F.array().cast("array<string>").alias("subcategories"), F.lit(0.2).alias("min_confidence"), F.when(i % 50 == 0, 9.0).otherwise((i % 9).cast("double")).alias("min_severity"),
        F.when(i % 50 == 0, "global").when(i % 3 == 0, "circle").otherwise("bbox").alias("area"), west.alias("west"), south.alias("south"),
        F.when(west + 20 > 180, west - 340).otherwise(west + 20).alias("east"), (south + 15).alias("north"), (i % 120 - 60).cast("double").alias("center_lat"),
        (i * 11 % 360 - 180).cast("double").alias("center_lng"), (i % 5 * 200 + 300).cast("double").alias("radius_km"),
    )


_WEST = "CAST(s.c_custkey * 13 % 360 - 180 AS DOUBLE)"


@query("p8_subscription_predicate", ("finding",), f"""
    SELECT s.c_custkey AS sub, f.id FROM customer s JOIN finding f ON
      CASE WHEN s.c_custkey % 2 = 0 THEN f.event_type IN ('usgs_quake', 'port_call') ELSE f.event_type = 'nasa_firms' END
      AND f.confidence >= 0.2 AND f.severity >= CASE WHEN s.c_custkey % 50 = 0 THEN 9 ELSE s.c_custkey % 9 END
      AND (f.lat IS NULL OR CASE WHEN s.c_custkey % 50 = 0 THEN true
        WHEN s.c_custkey % 3 = 0 THEN {haversine_sql('CAST(s.c_custkey % 120 - 60 AS DOUBLE)', 'CAST(s.c_custkey * 11 % 360 - 180 AS DOUBLE)', 'f.lat', 'f.lng')} <= s.c_custkey % 5 * 200 + 300
        ELSE f.lat BETWEEN s.c_custkey * 7 % 150 - 80 AND s.c_custkey * 7 % 150 - 65 AND CASE WHEN {_WEST} + 20 > 180 THEN f.lng >= {_WEST} OR f.lng <= {_WEST} - 340 ELSE f.lng BETWEEN {_WEST} AND {_WEST} + 20 END END)""")
def p8(t: Tables) -> DataFrame:
    return subscription_join(t.finding, subscriptions(t)).select(c("sub_sub_id").alias("sub"), "id")


@query("p9_bbox_filter", ("geo",), """
    SELECT event_id, lat BETWEEN 10 AND 60 AND lng BETWEEN -20 AND 50 AS plain, lat BETWEEN -40 AND 40 AND (lng >= 140 OR lng <= -120) AS wrapped FROM geo""")
def p9(t: Tables) -> DataFrame:
    return t.geo.select(
        "event_id", G.in_bbox(c("lat"), c("lng"), -20, 10, 50, 60).alias("plain"), G.in_bbox(c("lat"), c("lng"), 140, -40, -120, 40).alias("wrapped")
    )


def region_sql(lat: str = "lat", lng: str = "lng") -> str:
    whens = []
    for name, south, north, west, east in R.REGIONS:
        inside = f"{lng} BETWEEN {west} AND {east}" if west <= east else f"({lng} >= {west} OR {lng} <= {east})"
        whens.append(f"WHEN {lat} BETWEEN {south} AND {north} AND {inside} THEN '{name}'")
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


@query("p10_region", ("geo",), f"SELECT event_id, {region_sql()} AS region FROM geo")
def p10(t: Tables) -> DataFrame:
    return t.geo.select("event_id", G.region_for(c("lat"), c("lng")).alias("region"))


@query("p11_grid_cell", ("geo",), "SELECT event_id, CAST(floor(lng / 5) AS BIGINT) AS cell_x, CAST(floor(lat / 5) AS BIGINT) AS cell_y FROM geo")
def p11(t: Tables) -> DataFrame:
    return t.geo.select("event_id", G.grid_index(c("lng")).alias("cell_x"), G.grid_index(c("lat")).alias("cell_y"))


FLAG_CYCLE = ["RU", "IR", "PA", "DE", "CN", "LR", "GB"]
IDENTITY_DIGITS = {d: FLAG_CYCLE[d % 7] for d in range(201, 776)}
FLAG_SQL = f"CASE CAST(floor(CAST(canonical_id AS BIGINT) / 1000000) AS BIGINT) % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{f}{chr(39)}' for i, f in enumerate(FLAG_CYCLE))} END"


@query("p12_flag_consistency", ("entity",), f"""
    SELECT entity_id, flag, flag IN ('PA', 'LR') OR CASE user_id % 3 WHEN 0 THEN flag IN ('RU', 'UA') WHEN 1 THEN flag = 'IR' ELSE true END AS consistent
    FROM (SELECT entity_id, user_id, {FLAG_SQL} AS flag FROM entity)""")
def p12(t: Tables) -> DataFrame:
    regime = F.when(c("user_id") % 3 == 0, "russia ").when(c("user_id") % 3 == 1, "IRAN").otherwise("TERRORISM")
    rows = t.entity.select("entity_id", flag_of(c("canonical_id"), IDENTITY_DIGITS).alias("flag"), regime.alias("regime"))
    return rows.select("entity_id", "flag", flag_consistent(c("flag"), c("regime")).alias("consistent"))


@query("p13_facts", ("finding",), """
    SELECT id, CASE WHEN event_type IN ('sanctioned_vessel_went_dark', 'dark_vessel_detected') THEN json_extract_string(properties, '$.hours_dark') END AS hours_dark,
      CASE WHEN event_type IN ('sanctioned_vessel_went_dark', 'sanctioned_vessel_underway', 'sanctioned_port_arrival', 'dark_vessel_detected') THEN json_extract_string(properties, '$.live_vessel_name') END AS vessel,
      json_extract_string(properties, '$.sanctioning_authority') AS authority FROM finding""")
def p13(t: Tables) -> DataFrame:
    rows = t.finding.select("id", records.facts().alias("f"), records.authority().alias("a"))
    get = lambda k: F.try_element_at("f", F.lit(k)).alias(k)
    return rows.select("id", get("hours_dark"), get("vessel"), c("a.name").alias("authority"))


@query("p14_suspicious_vessel", ("track",), """
    SELECT ping_id, (CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0001' ELSE '2' || entity_id END) IN ('', '0') OR user_id % 5 = 1
      OR (user_id % 2 = 0 AND velocity_ms > 3 AND user_id % 3 = 0) AS dark FROM track""")
def p14(t: Tables) -> DataFrame:
    u = c("user_id")
    mmsi = F.when(u % 5 == 0, "").when(u % 5 == 1, "0001").otherwise(F.concat(F.lit("2"), "entity_id"))
    flag = S.suspicious_vessel(mmsi, (u % 2).cast("int"), c("velocity_ms"), F.when(u % 3 == 0, " ").otherwise("X"))
    return t.track.select("ping_id", flag.alias("dark"))


def _as_map(**cols):
    return F.map_filter(F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


@query("p15_interchange_record", ("entity", "listed"), """
    SELECT canonical_id AS id, CASE WHEN entity_type = 'vessel' THEN 'Vessel' ELSE 'Airplane' END AS schema, display_name AS name,
      CASE WHEN entity_type = 'vessel' THEN imo END AS imo, CAST(NULL AS VARCHAR) AS topics, CAST(NULL AS VARCHAR) AS description FROM entity WHERE entity_type <> 'satellite'
    UNION ALL SELECT listed_id, CASE WHEN entity_type = 'sanctioned_vessel' THEN 'Vessel' ELSE 'Airplane' END, listed_name,
      CASE WHEN entity_type = 'sanctioned_vessel' THEN listed_imo END, 'sanction', 'Authority: ' || authority FROM listed""")
def p15(t: Tables) -> DataFrame:
    live = t.entity.select("entity_type", "canonical_id", _as_map(display_name=c("display_name"), imo=c("imo")).alias("properties"))
    listed = t.listed.select(
        "entity_type", c("listed_id").alias("canonical_id"),
        _as_map(display_name=c("listed_name"), imo=c("listed_imo"), sanctioning_authority=c("authority")).alias("properties"),
    )
    rows = records.interchange(live.unionByName(listed))
    get = lambda k, n: F.get(F.try_element_at("properties", F.lit(k)), F.lit(0)).alias(n)
    return rows.select("id", "schema", get("name", "name"), get("imoNumber", "imo"), get("topics", "topics"), get("description", "description"))


@query("p16_property_split", ("entity", "track"), """
    SELECT t.ping_id, CASE WHEN e.entity_type IN ('aircraft', 'satellite') THEN 1 ELSE 2 END AS stable, CASE e.entity_type WHEN 'satellite' THEN 1 ELSE 2 END AS per_position
    FROM track t JOIN entity e ON e.entity_id = t.entity_id""")
def p16(t: Tables) -> DataFrame:
    payload = F.create_map(*[x for k in ("callsign", "name", "squawk", "cog", "noise") for x in (F.lit(k), F.lit("x"))])
    rows = t.track.join(t.entity.select("entity_id", "entity_type"), "entity_id").withColumns({"payload": payload, "severity": F.lit(1)})
    return records.split_properties(rows).select("ping_id", F.size("entity_properties").alias("stable"), F.size("position_properties").alias("per_position"))


@query("p17_withdrawn_filter", ("finding",), "SELECT id FROM finding WHERE NOT withdrawn")
def p17(t: Tables) -> DataFrame:
    return t.finding.filter(~c("withdrawn")).select("id")


@query("p18_callsign_family", ("entity",), """
    SELECT entity_id, CASE WHEN display_name IS NOT NULL AND length(display_name) >= 4 THEN nullif(regexp_extract(upper(display_name), '^[A-Z]+'), '') ELSE 'unknown' END AS family FROM entity""")
def p18(t: Tables) -> DataFrame:
    return t.entity.select("entity_id", T.callsign_family(c("display_name")).alias("family"))


# ------------------------------------------------------------------ sources, over raw rows derived from the tables
@query("r1_bulk_news_rows", ("news",), """
    SELECT event_id, CASE WHEN seq % 11 = 0 THEN 'short_row' WHEN seq % 13 = 0 THEN 'no_coordinates' WHEN seq % 17 = 0 THEN 'no_source' WHEN seq % 19 = 0 THEN 'bad_date' END AS rejected,
      CASE WHEN seq % 11 <> 0 AND seq % 19 <> 0 THEN date_trunc('second', timestamp) END AS timestamp,
      CASE WHEN seq % 11 = 0 THEN '999' ELSE code END AS code, CASE WHEN seq % 11 = 0 THEN 'unknown' ELSE CASE seq % 6 WHEN 1 THEN 'country' WHEN 2 THEN 'region' WHEN 3 THEN 'city' WHEN 4 THEN 'city' WHEN 5 THEN 'region' ELSE 'unknown' END END AS quality
    FROM news""")
def r1(t: Tables) -> DataFrame:
    i = c("seq")
    cells = {
        0: c("event_id"), 6: F.coalesce("actor1_name", F.lit("")), 26: c("code"), 51: (i % 6).cast("string"), 52: c("title"), 53: F.coalesce("iso_country", F.lit("")),
        56: F.when(i % 13 == 0, "").otherwise(c("lat").cast("string")), 57: c("lng").cast("string"),
        59: F.when(i % 19 == 0, "2024").otherwise(F.date_format("timestamp", "yyyyMMddHHmmss")), 60: F.when(i % 17 == 0, "").otherwise(c("source_url")),
    }
    line = F.concat_ws("\t", *[cells.get(k, F.lit("")) for k in range(61)])
    lines = t.news.select(F.when(i % 11 == 0, F.concat_ws("\t", "event_id", "code")).otherwise(line).alias("value"))
    return feed_module.bulk_rows(lines).select("event_id", "rejected", "timestamp", "code", c("geocode_quality").alias("quality"))


@query("r5_buoy_lines", ("geo",), """
    SELECT station_id, event_time, wave_height_m, wind_dir, severity FROM (
        SELECT entity_id AS station_id, date_trunc('minute', event_time) AS event_time, CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(value / 40, 1) END AS wave_height_m,
          CAST(event_id % 360 AS INT) AS wind_dir, CASE WHEN event_id % 6 = 0 THEN 1 ELSE CASE WHEN round(value/40, 1) >= 10 THEN 10 WHEN round(value/40, 1) >= 6 THEN 8 WHEN round(value/40, 1) >= 4 THEN 6
            WHEN round(value/40, 1) >= 3 THEN 5 WHEN round(value/40, 1) >= 2 THEN 3 WHEN round(value/40, 1) >= 1 THEN 2 ELSE 1 END END AS severity
        FROM geo WHERE event_id % 10 <> 0)""")
def r5(t: Tables) -> DataFrame:
    i = c("event_id")
    wave = F.when(i % 6 == 0, "MM").otherwise(F.format_string("%.1f", F.round(c("value") / 40, 1)))
    line = F.concat_ws(" ", F.date_format("event_time", "yyyy MM dd HH mm"), (i % 360).cast("string"), F.lit("4.0"), F.lit("MM"), wave)
    lines = t.geo.select(c("entity_id").alias("station_id"), F.when(i % 10 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))
    return feed_module.buoy_observations(lines).select("station_id", "event_time", "wave_height_m", "wind_dir", "severity")


@query("r6_block_list", (), """
    SELECT CAST(event_id % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.0.0/' || CAST(event_id % 33 AS VARCHAR) AS cidr, 'SBL' || CAST(event_id AS VARCHAR) AS entry_id
    FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def r6q(t: Tables) -> DataFrame:
    i, u = c("event_id"), c("user_id")
    cidr = F.concat_ws(".", F.when(i % 7 == 0, (i + 256).cast("string")).otherwise((i % 256).cast("string")), (u % 256).cast("string"), F.lit("0"), F.concat(F.lit("0/"), (i % 33).cast("string")))
    line = F.concat(cidr, F.lit(" ; SBL"), i.cast("string"))
    rows = t.raw("events").select(F.when(i % 5 == 0, F.concat(F.lit("; "), line)).otherwise(line).alias("value"))
    return feed_module.block_list(rows)


@query("r7_quake_features", ("geo",), f"""
    SELECT CAST(event_id AS VARCHAR) AS external_id, date_trunc('millisecond', event_time) AS event_time, lat, lng, CAST(greatest(
      least(10, {_STEPS('value / 60', S.AT_LEAST['quake'][0], 1)} + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END),
      CASE event_id % 8 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 0 END) AS INT) AS severity
    FROM geo WHERE NOT (lat = 0 AND lng = 0)""")
def r7(t: Tables) -> DataFrame:
    i = c("event_id")
    alert = F.when(i % 8 == 0, "Yellow").when(i % 8 == 1, "orange").when(i % 8 == 2, "red")
    props = F.struct(
        (c("value") / 60).alias("mag"), F.lit("p").alias("place"), F.unix_millis("event_time").alias("time"), F.when(i % 9 == 0, 1).otherwise(0).alias("tsunami"),
        alert.alias("alert"), F.lit("t").alias("title"), F.lit("u").alias("url"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat", F.lit(10.0)).alias("coordinates"))
    raw = t.geo.select(F.array(F.struct(i.cast("string").alias("id"), props.alias("properties"), geometry.alias("geometry"))).alias("features"))
    return feed_module.conform(raw, feed_module.feeds()["quakes"], t.as_of).select("external_id", "event_time", "lat", "lng", "severity")


@query("r8_incident_reports", (), f"""
    SELECT CAST(doc_id AS VARCHAR) AS iid, substr(md5(source || ':' || CAST(doc_id AS VARCHAR)), 1, 16) AS external_id,
      CAST(CASE {' '.join(f"WHEN regexp_matches(lower(text), '{_RX(w)}') THEN {v}" for w, v in R.POLICE_TIERS)} ELSE {R.POLICE_DEFAULT} END AS INT) AS severity
    FROM documents WHERE NOT (doc_id % 170 = 85 AND doc_id % 360 = 180)""")
def r8(t: Tables) -> DataFrame:
    i = c("doc_id")
    raw = t.raw("documents").select(
        c("source").alias("city"), c("text").alias("itype"), F.lit("").alias("addr"), i.cast("string").alias("iid"),
        (i % 170 - 85).cast("double").alias("lat"), (i % 360 - 180).cast("double").alias("lng"), F.lit("2024-01-05T00:00:00Z").alias("ts"),
    )
    feed = feed_module.feeds()["incidents"]
    rows = feed_module.conform(raw, feed, t.as_of)
    ids_of = raw.select("iid", feed.external_id.alias("external_id"))
    return rows.join(ids_of, "external_id").select("iid", "external_id", "severity")


@query("r9_position_feeds", ("track",), f"""
    SELECT entity_id AS icao24, ping_id, flagged AS military, CASE WHEN user_id % 10 = 0 THEN 10 WHEN flagged AND user_id % 2 = 0 THEN 4 WHEN flagged THEN 7 ELSE 1 END AS severity FROM (
      SELECT *, user_id % 4 = 0 OR user_id % 3 = 0 AS flagged, row_number() OVER (PARTITION BY entity_id ORDER BY ping_id % 3, ping_id) AS rn FROM track) WHERE rn = 1""")
def r9(t: Tables) -> DataFrame:
    u = c("user_id")
    raw = t.track.select(
        c("entity_id").alias("icao24"), "ping_id", "lat", "lng", F.when(u % 4 == 0, "rch12").otherwise("BAW1").alias("callsign"),
        F.when(u % 3 == 0, 1).otherwise(0).alias("db_flags"), F.when(u % 10 == 0, "7700").otherwise("1200").alias("squawk"), (u % 2 == 0).alias("on_ground"),
        F.lit(None).cast("double").alias("baro_altitude"), F.lit(1000.0).alias("geo_altitude"), (c("ping_id") % 3).alias("feed_rank"), c("ping_id").alias("seq"),
    )
    return feed_module.aircraft_positions(raw).select("icao24", "ping_id", "military", "severity")


@query("r8_social_posts", (), """
    SELECT CAST(doc_id AS VARCHAR) AS rkey, CASE WHEN doc_id % 3 = 0 THEN 'explosion' ELSE 'war' END AS event_subtype FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 4 <> 3""")
def r8_posts(t: Tables) -> DataFrame:
    """Posts without a keyword, or without a place, are left out."""
    i = c("doc_id")
    text = F.when(i % 3 == 0, "An Explosion, heard downtown").when(i % 3 == 1, "talk of WAR again").otherwise("warm weather")
    raw = t.raw("documents").select(
        F.lit("d").alias("did"), i.cast("string").alias("rkey"), text.alias("text"), F.when(i % 4 != 3, (i % 90).cast("double")).alias("lat"), (i % 170).cast("double").alias("lng"), F.lit("2024-01-05T00:00:00Z").alias("ts"),
    )
    rows = feed_module.conform(raw, feed_module.feeds()["posts"], t.as_of)
    return rows.select(F.substring_index("external_id", ":", -1).alias("rkey"), "event_subtype")


@query("r9_satellite_positions", ("entity",), """
    SELECT canonical_id AS external_id, CASE WHEN user_id % 4 = 0 THEN 5 ELSE 1 END AS severity, CAST(400 + user_id % 7 AS DOUBLE) * 1000 AS altitude_m, 7500.0::DOUBLE AS velocity_ms FROM entity WHERE user_id % 6 <> 5""")
def r9_satellites(t: Tables) -> DataFrame:
    u = c("user_id")
    raw = t.entity.select(
        c("canonical_id").alias("norad"), F.when(u % 8 == 0, "ISS (ZARYA)").when(u % 8 == 4, "Hubble").otherwise("SAT").alias("name"), F.lit("g").alias("group"),
        F.when(u % 6 != 5, (u % 80).cast("double")).alias("lat"), (u % 170).cast("double").alias("lng"), (u % 7 + 400).cast("double").alias("alt_km"), F.lit(7.5).alias("vel_km_s"),
    )
    return feed_module.conform(raw, feed_module.feeds()["satellites"], t.as_of).select("external_id", "severity", "altitude_m", "velocity_ms")


@query("r10_reference_layer", (), """
    SELECT s_name AS name, CAST(s_suppkey % 160 - 80 AS DOUBLE) AS lat, CAST(s_suppkey * 7 % 340 - 170 AS DOUBLE) AS lng, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 9 <> 4""")
def r10(t: Tables) -> DataFrame:
    """Points of interest written as GeoJSON files, one document for every thousand keys, and read back."""
    import uuid

    from tidemark.operators.lineage import shared_folder

    i = c("s_suppkey")
    place = F.array((i * 7 % 340 - 170).cast("double"), (i % 160 - 80).cast("double"))
    geometry = F.when(i % 9 != 4, F.struct(F.lit("Point").alias("type"), place.alias("coordinates")))
    props = F.struct(c("s_name").alias("name"), c("s_nationkey").cast("string").alias("nation"))
    features = t.raw("supplier").groupBy(F.floor(i / 1000).alias("part")).agg(F.collect_list(F.struct(props.alias("properties"), geometry.alias("geometry"))).alias("features"))
    folder = f"{shared_folder(t.spark)}/layer-{uuid.uuid4().hex}"
    features.select("part", F.to_json(F.struct("features")).alias("value")).write.partitionBy("part").text(folder)
    layer = feed_module.reference_layer(t.spark, folder)
    return layer.select("name", "lat", "lng", c("properties")["nation"].alias("nation"))
