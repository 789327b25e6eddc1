"""Operators where few places, names or keys hold most rows, and where little goes in and much comes out."""

import duckdb
from pyspark.sql import functions as F

from rankloom.operators import graph, joins, skew, spatial
from rankloom.plans import catalogue
from rankloom.sources import readers


def tasks(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_tasks_are_as_many_as_pairs_need(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 1_000, raising=False)
    left = spark.range(400).select(F.col("id").alias("k"), F.lit(35.0).alias("lat"), (139 + F.col("id") % 20 * 0.001).alias("lng"))
    right = spark.range(50).select(F.col("id").alias("p"), F.lit(35.0).alias("r_lat"), F.lit(139.0).alias("r_lng"))
    got = spatial.radius_join(left, right, 5.0)
    assert got.columns == ["k", "lat", "lng", "p", "r_lat", "r_lng", "km"]
    assert got.count() == got.select("k", "p").distinct().count() == 20_000 and tasks(got) > 4


def test_count_near_has_no_pairs_of_rows(spark, monkeypatch):
    seen, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a: seen.append(join(*a)) or seen[-1])
    left = spark.range(1_000).select(F.when(F.col("id") > 0, F.lit(35.0)).alias("lat"), (139 + F.col("id") % 2).cast("double").alias("lng"), "id")
    right = spark.range(500).select(F.col("id").alias("p"), F.lit(35.0).alias("r_lat"), F.lit(139.0).alias("r_lng"))
    got = spatial.count_near(left, right, 1.0, odd=F.col("p") % 2 == 1)
    assert {(r["id"], r["odd"]) for r in got.collect()} == {(i, 250 if i % 2 == 0 and i else 0) for i in range(1_000)}
    assert [s.count() for s in seen] == [1]


def polygon(y, x, size=0.1):
    return [{"lat": a, "lon": b} for a, b in ((y, x), (y, x + size), (y + size, x + size))]


def test_cells_of_polygons_have_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_EDGES", 1_000, raising=False)
    seen, kept = {}, spatial.kept
    monkeypatch.setattr(spatial, "kept", lambda df, what: seen.__setitem__(what, df) or kept(df, what))
    areas = spark.createDataFrame([(i, polygon(35 + i * 0.001, 139 + i * 0.003)) for i in range(60)], "a int, ring array<struct<lat: double, lon: double>>")
    points = spark.createDataFrame([(i, 35.00037 + i * 0.0021, 139.00053 + i * 0.0047) for i in range(60)], "k int, lat double, lng double")
    got = {tuple(r) for r in spatial.within_polygons(points, areas, "k", "a").collect()}
    inside = lambda y, x: 0 < y < x < 0.1
    assert got == {(k, a) for k in range(60) for a in range(60) if inside(0.00037 + k * 0.0021 - a * 0.001, 0.00053 + k * 0.0047 - a * 0.003)} and got
    assert tasks(seen["polygon-cells"]) > 4


def test_lists_at_a_place_are_bounded(spark, monkeypatch):
    """However many rows a table has, as all pairs of two lists are in memory at once; and rows without a key, or with one of several parts, are as before."""
    monkeypatch.setattr(spatial, "LISTED", 10)
    monkeypatch.setattr(spatial, "SHARE", 2)
    seen, kept = [], spatial.kept
    monkeypatch.setattr(spatial, "kept", lambda df, what: (seen.append(kept(df, what)) or seen[-1]) if what == "listed" else kept(df, what))
    points = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(35.03).alias("lat"), F.lit(139.06).alias("lng"))
    areas = spark.createDataFrame([((i, str(i)), polygon(35.0, 139.0)) for i in range(25)], "a struct<i: int, s: string>, ring array<struct<lat: double, lon: double>>")
    got = {(r["k"], *r["a"]) for r in spatial.within_polygons(points, areas, "k", "a").collect()}
    assert got == {(k or None, i, str(i)) for k in range(300) for i in range(25)}
    sizes = [[r[0] for r in lists.select(F.size(f"{side}_rows")).collect()] for lists, side in zip(seen, ("_r", "_l"))]
    assert [sum(s) for s in sizes] == [25, 300] and max(map(max, sizes)) <= 10


def test_copies_of_right_rows_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 100)
    monkeypatch.setattr(skew, "TASK_COPIES", 100, raising=False)
    left, right = spark.range(50).select("id", F.lit(1).alias("c")), spark.range(40).select(F.col("id").alias("r"), F.lit(1).alias("c")).coalesce(1)
    got = skew.spread_join(left, right, ["c"], sizes=(F.lit(1), F.lit(1)))
    assert got.select("id", "r").distinct().count() == got.count() == 2_000
    assert "RoundRobinPartitioning(4)" in got._jdf.queryExecution().executedPlan().toString()


def test_areas_query_where_places_repeat(spark, tmp_path, monkeypatch):
    """Places and areas come back every 97 * 89 keys."""
    monkeypatch.setattr(spatial, "LISTED", 3)
    keys = [k + 8_633 * i for k in range(0, 8_633, 211) for i in range(7)]
    spark.createDataFrame([(k, f"c{k}", k % 3, "s") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k + 5, k % 3) for k in keys], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, f"n{i}", 0) for i in range(2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(keys[i], "view", 1.0) for i in (1, 1, 4)], "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    for name in ("customer", "supplier", "nation", "events"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rel = duck.execute(catalogue.ORACLE_SQL["q_points_in_areas"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    df = catalogue.QUERIES["q_points_in_areas"](spark, str(tmp_path))
    assert len(want) > 1_000 and sorted(map(tuple, df.select(*names).collect())) == want


def test_codes_of_cells_may_repeat(spark):
    lines = spark.createDataFrame([(1, "x,10001,a,60000"), (90_001, "x,10001,b,140001,700000")], "k long, line string")
    got = readers.positional_cells(lines, "line", high=F.greatest(F.lit(500_000), F.col("k") * 10), keep=("k",))
    assert sorted(map(tuple, got.collect())) == [(1, "10001", "a", [60_000.0]), (90_001, "10001", "b", [140_001.0, 700_000.0])]


def test_positional_query_where_codes_repeat(spark, tmp_path):
    rows = [(k, f"name {k}", k % 50 + 1) for k in (1, 7, 90_001, 180_001, 600_001)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.QUERIES["q_positional_cells"](spark, str(tmp_path))
    rel = duck.execute(catalogue.ORACLE_SQL["q_positional_cells"])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_chains_that_end_are_left_alone(spark, monkeypatch):
    """A pair of keys that go round doesn't make all others go on."""
    rounds, join = [], joins.spread_join
    monkeypatch.setattr(joins, "spread_join", lambda left, *a, **k: rounds.append(left.count()) or join(left, *a, **k))
    edges = [(i, i + 1) for i in range(200) if i % 10 < 3] + [(1_000, 1_001), (1_001, 1_000), (1_002, 1_001)]
    got = {r["old"]: (r["new"], r["hops"], r["cycle"]) for r in joins.chains(spark.createDataFrame(edges, "old long, new long")).collect()}
    want = {i: (i - i % 10 + 3, 3 - i % 10, False) for i in range(200) if i % 10 < 3} | {i: (None, None, True) for i in (1_000, 1_001, 1_002)}
    assert got == want and len(rounds) <= 4 and rounds[-1] < rounds[0]


def test_cascade_matches_each_name_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"{'abcdefg'[k % 7]}ab {'xyz'[k % 3]}yz tail", k % 50 + 1) for k in range(1, 400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen, cascade = [], joins.cascade
    monkeypatch.setattr(joins, "cascade", lambda left, *a: seen.append(left.count()) or cascade(left, *a))
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    df = catalogue.QUERIES["q_cascade_match"](spark, str(tmp_path))
    rel = duck.execute(catalogue.ORACLE_SQL["q_cascade_match"])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
    assert seen == [21]


def test_adjacency_has_tasks_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 100, raising=False)
    seen, join = [], graph.spread_join
    monkeypatch.setattr(graph, "spread_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    members = spark.createDataFrame([(p, (p * 7 + i * 3) % 40) for p in range(60) for i in range(8)], "place long, line long")
    got = {tuple(r) for r in graph.adjacency(members, "place", "line").collect()}
    on = {}
    for p in range(60):
        on[p] = {(p * 7 + i * 3) % 40 for i in range(8)}
    assert got == {(a, b) for s in on.values() for a in s for b in s if a != b}
    assert tasks(seen[0]) > 4
