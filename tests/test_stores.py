"""Unique choices against the loop, and tables in versions: refreshes under readers, updates by key, conflicts."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from rankloom.operators import skew, unique
from rankloom.sources import versions

# --- choices that are given once ------------------------------------------------------------------------------------


def by_loop(rows, most, used):
    used, out = set(used), []
    for _, k, choices, spare in sorted(rows, key=lambda r: (r[0], r[1])):
        for source in (choices, spare):
            took = [c for c in dict.fromkeys(source or []) if c is not None and c not in used][:most]
            if took:
                break
        used |= set(took)
        out += [(k, c, i) for i, c in enumerate(took)]
    return sorted(out)


@pytest.mark.parametrize("photos, seed", [(12, 1), (60, 2), (400, 3)])
def test_greedy_unique(spark, photos, seed):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice([None, *range(photos)]) for _ in range(rng.randrange(n))]
    rows = [(rng.randrange(4), k, rng.choice([None, pick(9), pick(9), pick(3)]), rng.choice([None, pick(4)])) for k in range(60)]
    places = spark.createDataFrame([(*r, 0, "x") for r in rows], "lines int, k long, choices array<int>, spare array<int>, got int, all string").drop("got")
    used = spark.createDataFrame([(0,), (1,), (None,), (0,)], "c int")
    for most in (1, 3):
        got = unique.greedy_unique(places, "k", ["lines"], "choices", most, "spare", used)
        assert sorted(map(tuple, got.collect())) == by_loop(rows, most, {0, 1})
    got = unique.greedy_unique(places, "k", ["lines"], "choices", 2)
    assert sorted(map(tuple, got.collect())) == by_loop([(a, b, c, None) for a, b, c, _ in rows], 2, set())


def test_greedy_unique_one_choice_on_all_lists_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 20)
    rows = [(0, k, [-1, k], None) for k in range(100)] + [(1, 1_000 + k, [500 + k, 501 + k], None) for k in range(6)]
    places = spark.createDataFrame(rows, "lines int, k long, choices array<int>, spare array<int>")
    assert sorted(map(tuple, unique.greedy_unique(places, "k", ["lines"], "choices", 1, "spare").collect())) == by_loop(rows, 1, set())
    assert unique.greedy_unique(places.limit(0), "k", ["lines"], "choices", 1).count() == 0


# --- tables in versions ---------------------------------------------------------------------------------------------


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    old, new = (spark.range(n).select("id", F.lit(n).alias("n")) for n in (50, 80))
    assert versions.refresh(old, path, "id", 4) == 0
    reader = versions.current(spark, path)
    assert reader.limit(1).count() == 1
    assert versions.refresh(new, path, "id", 8) == 1
    assert {tuple(r) for r in reader.groupBy("n").count().collect()} == {(50, 50)}
    assert {tuple(r) for r in versions.current(spark, path).groupBy("n").count().collect()} == {(80, 80)}
    assert versions.current(spark, path, 0).count() == 50
    assert versions.vacuum(spark, path, 1) == 1 and versions.current(spark, path).count() == 80
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path, 0)
    with pytest.raises(FileNotFoundError):
        versions.current(spark, str(tmp_path / "none"))


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.refresh(spark.range(10), path, "id", 2)
    with pytest.raises(Exception, match="no such value"):
        versions.refresh(spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no such value")).cast("long")).alias("id")), path, "id", 2)
    assert versions.versions(spark, path) == [0] and versions.current(spark, path).count() == 10


def test_update_rewrites_only_buckets_with_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1_000).select("id", F.lit("a").alias("x"), F.col("id").alias("y"))
    versions.refresh(rows, path, "id", 32)
    before = files(path)
    time.sleep(0.01)
    changes = spark.createDataFrame([(5, "b", None, 1), (5, "c", None, 2), (7, None, -7, 1), (5_000, "no", 0, 1), (None, "no", 0, 1)], "id long, x string, y long, at int")
    assert versions.update(changes, path, order="at") == 1
    got = {r["id"]: (r["x"], r["y"]) for r in versions.current(spark, path).collect()}
    assert got == {i: ("c" if i == 5 else "a", -7 if i == 7 else i) for i in range(1_000)}
    touched = {f for b, f in versions.manifest(spark, path, 0)["parts"].items() if f not in versions.manifest(spark, path, 1)["parts"].values()}
    assert 1 <= len(touched) <= 2
    after = files(path)
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 2
    versions.update(spark.createDataFrame([(5_000, "new", 0)], "id long, x string, y long"), path, insert=True)
    assert versions.current(spark, path).where("id = 5000").collect()[0]["x"] == "new" and versions.current(spark, path).count() == 1_001
    # a change of no row of the table makes a version with the same files
    n = len(files(path))
    versions.update(spark.createDataFrame([(-1, "x")], "id long, x string"), path)
    assert len(files(path)) == n


def test_replace_groups_of_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    versions.refresh(rows, path, "k", 4)
    versions.replace(spark.createDataFrame([("a", 9), ("d", 5)], "k string, v int"), spark.createDataFrame([("a",), ("c",), ("a",)], "k string"), path)
    assert sorted(map(tuple, versions.current(spark, path).collect())) == [("a", 9), ("b", 3), ("d", 5)]


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.refresh(spark.range(10), path, "id", 2)
    of = versions.manifest(spark, path)
    versions.refresh(spark.range(20), path, "id", 2)
    with pytest.raises(versions.Conflict):
        versions._rewritten(spark, path, of, spark.range(5), ["0", "1"])
    assert versions.current(spark, path).count() == 20


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.refresh(spark.range(0), path, "id", 2)
    assert versions.current(spark, path).count() == 0
    versions.update(spark.range(3), path, insert=True)
    assert versions.current(spark, path).count() == 3
