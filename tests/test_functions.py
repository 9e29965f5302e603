"""Scalar functions against plain Python."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import confidence as C
from tidemark.functions import geo as G
from tidemark.functions import ids, stats
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators.names import flag_consistent


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_uuid5_equals_python(spark):
    for name in ("usgs_quake:abc", "é:1", ""):
        assert one(spark, ids.uuid5(F.lit(name)))[0] == str(uuid.uuid5(uuid.UUID(ids.EVENT_NAMESPACE), name))


def test_distances(spark):
    km, m = one(spark, G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert km == pytest.approx(math.radians(1) * 6371.0)
    assert m == pytest.approx(111319.49, abs=0.1)  # one degree of the equator
    north, same = one(spark, G.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), G.geodesic_m(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)))
    assert north == pytest.approx(110574.39, abs=1.0) and same == 0.0


def test_trigrams_and_tokens(spark):
    got = one(
        spark, T.trigram_similarity(F.lit("word"), F.lit("two words")), T.trigram_similarity(F.lit("POLA SOFIA"), F.lit("POLA SOFI")),
        T.token_jaccard(F.lit(""), F.lit("")), T.token_jaccard(F.lit("a"), F.lit("")), T.token_jaccard(F.lit("a b"), F.lit("B, c")),
    )
    assert got == pytest.approx((4 / 11, 0.75, 1.0, 0.0, 1 / 3))


@pytest.mark.parametrize("text,want", [
    ("2026-05-08T01:00:00.0Z", "2026-05-08 01:00:00"), ("2026-05-08T01:00:00+02:00", "2026-05-07 23:00:00"), ("20260421150000", "2026-04-21 15:00:00"),
    ("Mon, 04 May 2026 10:11:12 GMT", "2026-05-04 10:11:12"), ("2026-May-13 19:49", "2026-05-13 19:49:00"), ("nonsense", None), ("", None),
])
def test_parse_time(spark, text, want):
    got = one(spark, T.parse_time(F.lit(text)).cast("string"))[0]
    assert got == want


def test_severity_rules(spark):
    magnitude = [(7.5, 10), (7.0, 9), (6.9, 8), (5.5, 7), (5.0, 6), (4.5, 5), (4.0, 4), (3.0, 2), (2.9, 1)]
    assert one(spark, *[S.at_least(F.lit(m), "quake") for m, _ in magnitude]) == tuple(s for _, s in magnitude)
    assert one(spark, S.quake(F.lit(3.0), F.lit(True), F.lit("red")), S.quake(F.lit(8.0), F.lit(True), F.lit(None).cast("string"))) == (10, 10)
    assert one(spark, S.fire(F.lit(365.0), F.lit("h")), S.fire(F.lit(None).cast("double"), F.lit("29")), S.fire(F.lit(310.0), F.lit("n"))) == (9, 3, 5)
    assert one(spark, S.weather_alert(F.lit("Extreme"), F.lit("Immediate")), S.weather_alert(F.lit("?"), F.lit("Past")), S.flare(F.lit("x1.2")), S.flare(F.lit(None).cast("string"))) == (10, 0, 9, 2)
    assert one(spark, S.near_object(F.lit(1200.0), F.lit(1.0), F.lit(True)), S.near_object(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False))) == (10, 2)
    assert one(spark, S.declaration(F.lit("Hurricane "), F.lit("dr")), S.volcano(F.lit("watch"), F.lit("RED")), S.space_alert(F.lit("G"), F.lit(4))) == (10, 10, 8)
    assert one(spark, S.police(F.lit("structure fire")), S.police(F.lit("vehicle fire")), S.police(F.lit("noise")), S.police(F.lit("x"))) == (10, 8, 2, 4)
    assert one(spark, S.post(F.lit("a tornado!")), S.post(F.lit("warning")), S.post(F.lit("war now"))) == (6, 1, 4)


def test_confidence(spark):
    e = C.evidence(platform=F.lit("ads_b"), has_coordinates=F.lit(True), precision_km=F.lit(1.0), source_tier=F.lit(1))
    assert one(spark, C.score(C.factors(e)))[0] == 0.98
    e = C.evidence(platform=F.lit("snapmap"), has_url=F.lit(False), age_hours=F.lit(100.0))
    score, label = one(spark, C.score(C.factors(e)), C.label(C.score(C.factors(e))))
    assert (score, label) == (0.05, "SPECULATIVE")


def test_binomial_tail(spark):
    for k, n, p in ((0, 10, 0.2), (3, 10, 0.2), (9, 10, 0.2), (40, 100, 0.3), (7, 5, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        got = one(spark, stats.binomial_upper_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), F.lit(p)))[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_rounding_is_half_even_on_the_binary_value(spark):
    values = [4.975, 0.125, 0.375, 0.135, -4.975, 2.5]
    assert one(spark, *[stats.round_even(F.lit(v), 2) for v in values]) == tuple(round(v, 2) for v in values)


def test_boxes_and_regions(spark):
    p = lambda lat, lng: (F.lit(float(lat)), F.lit(float(lng)))
    assert one(spark, G.in_bbox(*p(0, 179), 170, -10, -170, 10), G.in_bbox(*p(0, 0), 170, -10, -170, 10)) == (True, False)
    got = one(spark, *[G.region_for(*p(*x)) for x in ((40, -100), (36, 138), (0, 179), (-80, 0))])
    assert got == ("north_america", "japan_korea", "oceania", "other")


def test_flags(spark):
    flag = lambda f, r: flag_consistent(F.lit(f).cast("string"), F.lit(r).cast("string"))
    assert one(spark, flag("DE", "RUSSIA"), flag("PA", "RUSSIA"), flag("RU", "russia "), flag(None, "RUSSIA"), flag("DE", "TERRORISM"), flag("DE", None)) == (
        False, True, True, True, True, True)


def test_text_bits(spark):
    got = one(
        spark, T.hemisphere_degrees(F.lit("94.4W")), T.hemisphere_degrees(F.lit("-21.1")), T.coordinates_in(F.lit("at 48.3794, 31.1656 now"))["lat"],
        T.coordinates_in(F.lit("at 98.3794, 31.1656")), T.domain_of(F.lit("https://www.BBC.co.uk:443/x")), T.callsign_family(F.lit("GAF12")), T.callsign_family(F.lit("ab")),
        T.callsign_family(F.lit("1234")),
    )
    assert got == (-94.4, -21.1, 48.3794, None, "bbc.co.uk", "GAF", "unknown", None)
