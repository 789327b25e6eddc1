"""Spatial joins where most points are in one place, ways through graphs, chains of renames, wide joins and names by dictionary, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph, joins, skew, spatial

# --- space ----------------------------------------------------------------------------------------------------------


@pytest.fixture
def plain_shuffles(spark):
    """Joins by shuffle alone, so that tasks show how rows were dealt."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "8")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def crowded(rng, n):
    """Nine of ten points in one small square."""
    return [(k, 35 + rng.random() * 0.001, 139 + rng.random() * 0.001) if k % 10 else (k, 34 + 2 * rng.random(), 138 + 2 * rng.random()) for k in range(n)]


def balanced(df):
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_radius_join_in_one_cell(spark, plain_shuffles, monkeypatch):
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", None, 100, 2_000))
    rng = random.Random(1)
    points, others = crowded(rng, 5_000), [(p, 35.0005 if p < 3 else 34 + 2 * rng.random(), 139.0005 if p < 3 else 138 + 2 * rng.random()) for p in range(60)]
    got = spatial.radius_join(spark.createDataFrame(points, "k long, lat double, lng double"), spark.createDataFrame(others, "p long, r_lat double, r_lng double"), 2.0)
    assert balanced(got)

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    want = {(k, p) for k, a, b in points for p, c, d in others if km(a, b, c, d) <= 2.0}
    assert {(r["k"], r["p"]) for r in got.collect()} == want and got.count() == len(want)


def test_nearest_in_crowds(spark):
    rng = random.Random(2)
    points, areas = crowded(rng, 400), [(k, a, b) for k, a, b in crowded(rng, 300)] + [(1_000 + i, 35.0, 139.0) for i in range(50)]
    p = spark.createDataFrame([(*x, x[0] % 2) for x in points], "k long, lat double, lng double, g long")
    a = spark.createDataFrame([(*x, x[0] % 2) for x in areas], "area long, a_lat double, a_lng double, g long")
    got = {r["k"]: r["area"] for r in spatial.nearest_in(p, a, "g", "k", "area").collect()}
    apart = lambda x, y: math.sqrt((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2)
    assert got == {x[0]: min((apart(x, y), y[0]) for y in areas if y[0] % 2 == x[0] % 2)[1] for x in points}


def star(rng, lat, lon, size, n):
    return [(lat + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n), lon + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n)) for i in range(n)]


def inside(lat, lng, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (c > lat) and lng < (d - b) * (lat - a) / (c - a) + b:
            hit = not hit
    return hit


def test_polygons_of_all_sizes_and_crowds(spark, plain_shuffles, monkeypatch):
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", None, 100, 2_000))
    rng = random.Random(3)
    rings = [(i, star(rng, 35 + rng.random() * 0.01, 139 + rng.random() * 0.01, 10 ** rng.uniform(-4, 0), rng.choice([3, 5, 40]))) for i in range(40)]
    rings += [(100, [(34.9, 138.9), (34.9, 139.1), (35.1, 139.1), (35.1, 138.9)]), (101, [(35.0, 139.0), (36.0, 140.0)]), (102, [(35.0, 139.0), (35.0, 139.5), (35.0, 139.2)]), (103, None)]
    points = crowded(rng, 3_000) + [(9_000, 35.0, 139.0), (9_001, None, 139.0), (9_002, 34.9, 138.9)]
    p = spark.createDataFrame(points, "k long, lat double, lng double")
    areas = spark.createDataFrame(rings, "a long, ring array<struct<lat: double, lon: double>>")
    got = spatial.within_polygons(p, areas, "k", "a")
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, a, b in points for i, ring in rings if a is not None and ring and len(ring) > 2 and inside(a, b, ring))
    assert balanced(got)
    assert spatial.within_polygons(p, areas.limit(0), "k", "a").count() == spatial.within_polygons(p.limit(0), areas, "k", "a").count() == 0


# --- ways -----------------------------------------------------------------------------------------------------------


def test_changes_against_breadth_first_search(spark, monkeypatch):
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", None, 20, 2_000))
    rng = random.Random(4)
    rows = [(p, rng.choice([p // 4, p // 4 + 1, 900 + p % 7])) for p in range(120) for _ in range(1 + (p % 10 == 0))] + [(300, 77_000), (301, 77_000), (0, 0), (0, 0), (None, 5), (5, None)]
    rows += [(p, 1_000) for p in range(0, 120, 3)] + [(60, line) for line in range(2_000, 2_060)]
    members = spark.createDataFrame(rows, "place long, line long").where("place is not null and line is not null")
    of_line, of_place = {}, {}
    for p, line in rows:
        if p is not None and line is not None:
            of_line.setdefault(line, set()).add(p)
            of_place.setdefault(p, set()).add(line)

    def search(hub):
        depth, seen, lines, out = 0, set(), set(of_place[hub]), {}
        reached = set(lines)
        while lines:
            for p in {p for x in lines for p in of_line[x]} - seen:
                out[p] = depth
                seen.add(p)
            lines = {x for p in seen for x in of_place[p]} - reached
            reached |= lines
            depth += 1
        return out

    hubs = spark.createDataFrame([(0,), (61,), (300,)], "place long")
    want = {(p, h, d) for h in (0, 61, 300) for p, d in search(h).items()}
    assert {tuple(r) for r in graph.changes(members, hubs, "place", "line").collect()} == want
    assert {tuple(r) for r in graph.changes(members, hubs, "place", "line", 1).collect()} == {w for w in want if w[2] <= 1}
    pairs = {(a, b) for lines in of_place.values() for a in lines for b in lines if a != b}
    assert {tuple(r) for r in graph.adjacency(members, "place", "line").collect()} == pairs
    assert graph.changes(members.limit(0), hubs, "place", "line").count() == 0


def test_chains_of_renames(spark):
    rng = random.Random(5)
    renames = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 0) for i in range(30)] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (400, None), (None, 5), (500, 7), (500, 6)]
    rng.shuffle(renames)
    got = {r["old"]: (r["new"], r["hops"], r["cycle"]) for r in joins.chains(spark.createDataFrame(renames, "old long, new long")).collect()}
    one = {}
    for a, b in renames:
        if a is not None and b is not None:
            one[a] = max(b, one.get(a, b))
    one.pop(300)
    for old in one:
        now, hops = old, 0
        while now in one and hops <= len(one):
            now, hops = one[now], hops + 1
        assert got.pop(old) == ((None, None, True) if hops > len(one) else (now, hops, False))
    assert not got
    assert joins.chains(spark.createDataFrame([], "old long, new long")).count() == 0


def test_datamart_takes_the_last_of_each_side(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 9), (7, "w", 1)], "k long, v string, at int")
    b = spark.createDataFrame([(3, 5, 6)], "k long, p int, q int")
    got = joins.datamart(base, "k", {"a": (a, ["at"]), "b": (b, []), "c": (b.limit(0), [])})
    assert got.columns == ["k", "a_v", "b_p", "b_q", "c_p", "c_q", "found"]
    assert sorted(map(tuple, got.collect())) == [(1, "y", None, None, None, None, ["a"]), (2, None, None, None, None, None, []), (3, None, 5, 6, None, None, ["b"])]


def test_transliteration_against_a_loop(spark):
    rng = random.Random(6)
    entries = {"".join(rng.choice("東京新宿駅") for _ in range(rng.randrange(1, 5))): rng.choice(["tō", "KYŌ", "shin", "juku", "eki"]) for _ in range(25)}
    names = ["".join(rng.choice("東京新宿駅12-a ") for _ in range(rng.randrange(0, 9))) for _ in range(120)] + [None, "", "---", "known"]

    def read(name):
        if name == "known":
            return "As It Was"
        parts, at = [], 0
        while at < len(name):
            n = next((n for n in range(4, 0, -1) if name[at : at + n] in entries), 0)
            if n:
                parts.append((True, entries[name[at : at + n]].capitalize()))
            elif parts and not parts[-1][0]:
                parts[-1] = (False, parts[-1][1] + name[at])
            else:
                parts.append((False, name[at]))
            at += max(n, 1)
        text = "-".join(p for _, p in parts)
        while "--" in text:
            text = text.replace("--", "-")
        return text.strip("-")

    dictionary = spark.createDataFrame([*entries.items(), ("東", "zz") if "東" in entries else ("x", None), (None, "q"), ("", "q")], "written string, reading string")
    known = spark.createDataFrame([("known", "As It Was"), ("known", "Zed"), ("other", None)], "name string, romaji string")
    got = joins.transliterated(spark.createDataFrame([(n, "x") for n in names * 2], "station string, name string").drop("name"), "station", dictionary, known)
    assert {tuple(r) for r in got.collect()} == {(n, read(n)) for n in names if n is not None}
    assert got.count() == len({n for n in names if n is not None})
