"""Parsers and choices on odd input: what the queries on the given tables don't have."""

from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators import documents, variants
from rankloom.sources import readers


def one(spark, value, build):
    """What a column expression makes of a single value."""
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("out")).first()[0]


def test_json_in_text(spark):
    schema = "array<struct<name: string, n: int>>"
    cases = {
        'Here: [{"name": "a", "n": 1}] done.': [("a", 1)],
        '[{"name": "a, [b]", "n": 2}]': [("a, [b]", 2)],
        'first\n```json\n[\n {"name": "x"},\n {"n": 3, "other": true}\n]\n```': [("x", None), (None, 3)],
        "[]": [],
        "no list here": None,
        '[{"name": "cut off"': None,
        "": None,
    }
    for text, want in cases.items():
        got = one(spark, text, lambda c: tx.json_array(c, schema))
        assert (None if got is None else [tuple(r) for r in got]) == want, text
    assert one(spark, None, lambda c: tx.json_array(c, schema)) is None


def test_day_types(spark):
    cases = {"Line.A.1.SaturdayHoliday": "holiday", "Line.SaturdayHoliday.1.Weekday": "holiday", "Line.A.1.Weekday": "weekday", "saturdayholiday": "weekday", "": "weekday", None: "weekday"}
    for trip, want in cases.items():
        assert one(spark, trip, tx.day_type) == want


def test_municipalities(spark):
    rows = [("横浜市", "西区", "横浜市西区"), ("横浜市", "", "横浜市"), ("", "千代田区", "千代田区"), ("大磯町", "x区", "大磯町"), (None, "港区", "港区"), ("市川市", None, "市川市"), (None, None, None), ("", "", None), ("区市", "市区", "区市市区")]
    got = spark.createDataFrame(rows, "city string, ward string, want string").select("want", tx.municipality_key(F.col("city"), F.col("ward")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_cameras(spark):
    video = "abcDEF-_123"
    rows = [
        ("1", ["139.5", "35.5"], ("Cam", "カメラ"), f'<iframe src="https://x/embed/{video}?a">', "ch"),
        ("2", ["139.5"], ("Cam", None), f"embed/{video}", None),
        ("3", ["139.5", "35.5", "1"], ("Cam", None), f"embed/{video}", None),
        ("4", ["x", "35.5"], ("Cam", None), f"embed/{video}", None),
        ("5", ["1", "2"], None, f"embed/{video}", None),
        ("", ["1", "2"], ("", ""), f"embed/{video}xyz", ""),
        ("7", ["1", "2"], ("Cam", None), "embed/tooshort", None),
        ("8", ["1", "2"], ("Cam", None), None, None),
        ("9", None, ("Cam", None), f"embed/{video}", None),
    ]
    df = spark.createDataFrame(rows, "id string, center array<string>, name struct<en: string, ja: string>, html string, channel string")
    got = {r["id"]: (r["name_en"], r["name_ja"], r["video_id"], r["channel_id"], r["lat"], r["lng"]) for r in documents.camera_records(df).collect()}
    assert got == {"1": ("Cam", "カメラ", video, "ch", 35.5, 139.5), "5": ("5", "5", video, "", 2.0, 1.0), "": ("Live Camera", "Live Camera", video, "", 2.0, 1.0)}


def test_renames(spark):
    rows = [("ooshima", "Ooshima"), ("oo-u", "oo-u"), ("abe", "Abe"), ("tou-(kyou)", "tou-(kyou)"), ("kept", "Kept"), ("OUuu", "OUuu"), ("", "")]
    overrides = spark.createDataFrame([("abe", "ABE", "abe-2"), ("unknown", "x", "y")], "slug string, new_name string, new_slug string")
    got = {r["old_slug"]: (r["new_slug"], r["new_name"], r["is_override"]) for r in documents.renamed(spark.createDataFrame(rows, "slug string, name string"), overrides).collect()}
    assert got == {"ooshima": ("oshima", "Oshima", False), "oo-u": ("o-u", "O-U", False), "abe": ("abe-2", "ABE", True), "tou-(kyou)": ("to-(kyo)", "To-(kyo)", False), "OUuu": ("Ou", "Ou", False)}


def test_positional_cells(spark):
    lines = ["x,13101,\"a\",50000,9999,\"1234567\",70000", "13101", ",,", "", "131011,x,50000", "a,13102,b,5e4,-50000,60000.5"]
    got = {r["code"]: (r["name"], r["prices"]) for r in readers.positional_cells(spark.createDataFrame([(x,) for x in lines], "l string"), "l").where(F.size("prices") > 0).collect()}
    assert got == {"13101": ("a", [50_000.0, 70_000.0]), "13102": ("b", [50_000.0, 60_000.5])}


def test_variants(spark):
    counts = {kind: F.lit(1) for kind in variants.CRIME_WEIGHTS}
    row = spark.range(1).select(
        variants.weighted_crimes(counts).alias("all"), variants.weighted_crimes({}).alias("none"), variants.weighted_crimes({"felony": F.lit(None).cast("int"), "gambling": F.lit(9)}).alias("nothing"),
        variants.log_safety(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)).alias("empty"), variants.log_safety(F.lit(1e9), F.lit(1.0), F.lit(0), F.lit(3)).alias("worst"), variants.log_safety(F.lit(50.0), F.lit(10_000.0), F.lit(1), F.lit(9)).alias("middle"),
        variants.present(F.lit(100), F.lit(500.0), F.lit(100.0)).alias("busy"), variants.present(F.lit(100), F.lit(160.0), F.lit(100.0)).alias("some"), variants.present(F.lit(100), F.lit(5.0), F.lit(0.0)).alias("unknown"),
    ).first()
    assert abs(row["all"] - 15.0) < 1e-9 and row["none"] == row["nothing"] == 0
    assert row["empty"] == 9.9 and row["worst"] == 1.0 and row["middle"] == 6.0  # 10 - (ln 51 - 1.5) 9 / 5 + 0.35, to a tenth
    assert (row["busy"], row["some"], row["unknown"]) == (500.0, 130.0, 100.0)
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate([0, 0, *range(1, 101)])] + [(200, None)], "k int, s double")
    got = {r["k"]: r["out"] for r in variants.bucketed(df, "s", "out").collect()}
    assert got[0] == got[1] == got[200] == 1
    assert [sum(v == b for v in got.values()) for b in range(2, 11)] == [20, 20, 15, 15, 10, 8, 6, 4, 2]
