"""Hand-computed cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import color, geo, rating, rounding
from rankloom.functions import text as tx
from rankloom.operators import documents


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_rounding(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (3.5,), (0.285,)], "x double").select(rounding.half_up(F.col("x")), rounding.half_even(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(-2, -2), (3, 2), (4, 4), (0, 0)]


def test_affordability(spark):
    rows = spark.createDataFrame([(80_000,), (190_000,), (300_000,), (0,), (None,)], "r int")
    assert [r[0] for r in rows.select(rating.affordability_batch(F.col("r"))).collect()] == [10, 6, 1, None, None]
    assert [r[0] for r in rows.select(rating.affordability_live(F.col("r"))).collect()] == [10, 6, 1, 10, None]


def test_caps(spark):
    rows = spark.createDataFrame([(10, n) for n in range(1, 6)] + [(4, 5)], "r int, n int")
    assert [r[0] for r in rows.select(rating.capped(F.col("r"), F.col("n"), rating.CAPS["transport"])).collect()] == [7, 8, 9, 9, 10, 4]
    rents = spark.createDataFrame([(10, q) for q in range(3)], "r int, n int")
    assert [r[0] for r in rents.select(rating.capped(F.col("r"), F.col("n"), rating.CAPS["rent"])).collect()] == [8, 9, 10]


def test_weighted_score(spark):
    ratings = {"a": F.lit(7), "b": F.lit(7)}
    assert one(spark, rating.weighted_score(ratings, {"a": 3, "b": 9})) == 7.0
    assert one(spark, rating.weighted_score(ratings, {"a": 0, "b": -1})) == 0.0


def test_tiers(spark):
    rows = spark.createDataFrame([(0.26, 4.9), (0.06, 5.0), (0.03, 10.0), (0.0, 30.0), (None, 100.0), (None, 300.0)], "p double, m double")
    got = [tuple(r) for r in rows.select(rating.seismic_tier(F.col("p")), rating.elevation_tier(F.col("m"))).collect()]
    assert got == [("very_high", "very_low"), ("high", "low"), ("moderate", "moderate"), ("low", "elevated"), ("unknown", "high"), ("unknown", "mountain")]


def test_travel(spark):
    assert one(spark, geo.default_travel_minutes(F.lit(10.0), F.lit(1))) == 32
    assert one(spark, geo.default_travel_minutes(F.lit(0.0), F.lit(0))) == 3


def test_distances_agree(spark):
    a = geo.haversine_km(F.lit(35.68), F.lit(139.76), F.lit(35.0), F.lit(135.7))
    b = geo.haversine_km_atan(F.lit(35.68), F.lit(139.76), F.lit(35.0), F.lit(135.7))
    assert abs(one(spark, a) - one(spark, b)) < 1e-9
    assert 300 < one(spark, a) < 450


def test_rings(spark):
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in ((0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0))))
    assert abs(one(spark, geo.ring_area(ring)) - 1110.0**2) < 1
    assert one(spark, geo.inside_ring(F.lit(0.005), F.lit(0.005), ring)) is True
    assert one(spark, geo.inside_ring(F.lit(0.02), F.lit(0.005), ring)) is False


def test_names(spark):
    assert one(spark, tx.hepburn(F.lit("Toukyou"))) == "Tokyo"
    assert one(spark, tx.hepburn(F.lit("Yuutenji"))) == "Yutenji"
    assert one(spark, tx.slugified(F.lit("Zushi・Hayama "))) == "zushi-hayama"
    assert one(spark, tx.hyphen_capitals(F.lit("shin-(old)-mACHI"))) == "Shin-(old)-MACHI"
    assert one(spark, tx.ten_thousands(F.lit("12.5万円"))) == 125000
    assert one(spark, tx.clock_of(tx.minutes_of(F.lit("07:05")))) == "07:05"
    assert one(spark, tx.minutes_of(F.lit("x:y"))) is None


def test_colors(spark):
    assert one(spark, color.sampled(F.lit(0.0))) == "rgb(140, 41, 38)"
    assert one(spark, color.sampled(F.lit(1.0))) == "rgb(44, 74, 95)"
    assert one(spark, color.composite_color(F.lit(6.0), F.lit(3.6), F.lit(6.0), F.lit(7.15))) == "rgb(217, 201, 168)"
    assert one(spark, color.darkened(F.lit("rgb(100, 50, 11)"), 0.5)) == "rgb(50, 25, 6)"


def test_tag_class(spark):
    rows = spark.createDataFrame([(["food", "street"],), (["food"],), (["food", "cat", "street"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(documents.tag_class(F.col("t"), ["street"], ["food", "cat"])).collect()] == ["good", "bad", "bad", "good"]


def test_document_issues(spark):
    block = "struct<atmosphere: string, landmarks: string, food: string, nightlife: string>"
    rows = spark.createDataFrame([((("a", "b", "c", "d")), None, ("a", " ", None, "d"))], f"en {block}, ja {block}, ru {block}")
    assert rows.select(documents.document_issues()).first()[0] == ["missing ja", "ru.landmarks empty", "ru.food missing"]


@pytest.mark.parametrize("n,expected", [(0, "estimate"), (1, "moderate"), (2, "strong")])
def test_confidence(spark, n, expected):
    tests = [F.when(F.lit(i < n), f"s{i}") for i in range(3)]
    assert one(spark, rating.confidence(*tests)) == expected
