"""Steps whose tasks must not grow with the rows of a value, a file or a round."""

import bisect
import glob
import math

import duckdb
from pyspark.sql import functions as F

from rankloom.operators import joins, normalize, unique, variants
from rankloom.plans import catalogue
from rankloom.sources import versions


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def half_even(x):
    return max(1, min(10, round(x)))


def test_ratings_send_levels_and_not_rows(spark):
    """Neither the rows in long form, nor the distinct values, are joined with the rows: they were broadcast where files are small."""
    values = [0.0, -0.0] * 400 + [i / 7 for i in range(1, 300)] + [math.inf, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, a double").withColumn("b", F.col("a") * -1)
    there = sorted(v for v in values if v is not None)
    both = normalize.percentile_ratings(df, "k", {"ra": ("a", False), "rb": ("b", True)})
    one = normalize.percentile_rating(df, "a", "r")
    few = variants.bucketed(df, "a", "bucket")
    for got in (both, one, few):
        assert "Generate" not in plan(got) and plan(got).count("Join") <= 2  # with one row, and of the ranges with their sums
    want = {}
    for k, v in enumerate(values):
        if v is not None:
            below, n = bisect.bisect_left(there, v), bisect.bisect_right(there, v) - bisect.bisect_left(there, v)
            want[k] = half_even((below + (n - 1) / 2.0) / (len(there) - 1) * 9 + 1)
    assert {r["k"]: r["r"] for r in one.collect()} == {k: want.get(k) for k in range(len(values))}
    ratings = {r["k"]: (r["ra"], r["rb"]) for r in both.collect()}
    assert {k: r for k, (r, _) in ratings.items()} == {k: want.get(k) for k in range(len(values))}
    assert all(a == b for a, b in ratings.values())  # low is good in b, which is a the other way round
    above = [v for v in there if v > 0]
    rate = lambda v: 1 if v is None or v <= 0 else max(r for limit, r in variants.NIGHTLIFE_BUCKETS if bisect.bisect_left(above, v) / len(above) >= limit)
    assert {r["k"]: r["bucket"] for r in few.collect()} == {k: rate(v) for k, v in enumerate(values)}


def test_ratings_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "k int, a double")
    assert [tuple(r) for r in normalize.percentile_ratings(df, "k", {"r": ("a", False)}).collect()] == [(1, None, None)]
    assert normalize.percentile_rating(df.limit(0), "a", "r").count() == 0


def test_datamart_joins_few_sides_in_a_stage(spark):
    base = spark.range(6).select(F.col("id").alias("k"))
    sides = {f"s{i}": (spark.createDataFrame([(k, k * 10 + i, at) for k in range(i % 3, 5) for at in (0, i)], "k long, v long, at int").where(F.col("at") == i), ["at"] if i % 2 else []) for i in range(1, 8)}
    got = joins.datamart(base, "k", sides)
    assert plan(got).count("Join") <= 2
    for r in got.collect():
        has = [i for i in range(1, 8) if i % 3 <= r["k"] < 5]
        assert r["found"] == [f"s{i}" for i in has]
        assert {i: r[f"s{i}_v"] for i in range(1, 8) if r[f"s{i}_v"] is not None} == {i: r["k"] * 10 + i for i in has}
        assert "s2_at" in got.columns and "s1_at" not in got.columns


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    path, size = f"{tmp_path}/t", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "50k")
    try:
        rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        versions.refresh(rows, path, "k", 1)
        versions.replace(rows.where("k = 1").withColumn("v", F.lit("new")), spark.range(1, 3), path)
    finally:
        spark.conf.set(size, before)
    first = versions.manifest(spark, path, 0)["parts"]["0"]
    assert len(glob.glob(f"{path}/{first}/*.parquet")) > 1
    got = versions.current(spark, path)
    assert {(r["k"], r["new"]): r["count"] for r in got.groupBy("k", (F.col("v") == "new").alias("new")).count().collect()} == {(0, False): 13_334, (1, True): 13_333}
    assert versions.current(spark, path, 0).exceptAll(rows).count() == 0 == rows.exceptAll(versions.current(spark, path, 0)).count()


def test_first_choices_are_found_without_sorting_all_rows(spark, tmp_path, monkeypatch):
    big = 2**62
    orders = [(big + i, i % 7) for i in range(40)]
    lines = [(big + i, n, (i * 5 + n * 3) % 23, n % 4, float(n * 8)) for i in range(40) for n in range(1, 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck, seen, greedy = duckdb.connect(), [], unique.greedy_unique
    for t in ("orders", "lineitem"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    monkeypatch.setattr(unique, "greedy_unique", lambda places, *a: seen.append(places) or greedy(places, *a))
    got = catalogue.QUERIES["q_greedy_unique"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.select("k", "photo", "slot").collect()))
    assert rows and rows == sorted(duck.execute(f"select k, photo, slot from ({catalogue.ORACLE_SQL['q_greedy_unique']})").fetchall())
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
