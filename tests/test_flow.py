"""Streams with state, timetables whose files change, and files in several encodings, against plain loops."""

import csv
import datetime
import io
import json
import os
import random
import time

from pyspark.sql import functions as F

from rankloom.plans import spec
from rankloom.sources import readers, timetables
from rankloom.streaming import state

# --- actions --------------------------------------------------------------------------------------------------------


def random_actions(rng, n):
    c, s = spec.CATEGORIES, [f"s{i}" for i in range(6)]
    made = [
        lambda: ("weight", rng.choice([*c, "none", None]), rng.choice(["3", "12.5", "x", None])),
        lambda: ("weights", None, ",".join(str(rng.randrange(30)) for _ in range(rng.choice([9, 10])))),
        lambda: ("reset_weights", None, None),
        lambda: ("filter", rng.choice(["min_rent", "max_rent", "min_commute", "max_commute", "other"]), rng.choice(["90000", "200000", "20", "x"])),
        lambda: ("minimum", rng.choice(c), rng.choice(["5", "7", None, None])),
        lambda: ("camera", None, rng.choice(["true", "false"])),
        lambda: ("reset_filters", None, None),
        lambda: ("preset", rng.choice([*spec.PRESETS, "other"]), None),
        lambda: ("select", None, rng.choice([*s, None, ""])),
        lambda: ("compare", None, rng.choice(s)),
        lambda: ("compare", None, rng.choice(s)),
        lambda: ("uncompare", None, rng.choice(s)),
        lambda: ("clear_compare", None, None),
        lambda: (rng.choice(["heatmap", "hide_flood", "hide_seismic"]), None, rng.choice(["true", "false"])),
        lambda: ("dimension", None, rng.choice(["food", "composite", "größe&x=1"])),
        lambda: ("hydrate", None, rng.choice(["w=1,2,3,4,5,6,7,8,9", "mr=150000&cm=food:7,vibe:6", "c=a,b&hm=1&hd=rent&s=q", "", None])),
        lambda: ("nothing", None, None),
    ]
    return [rng.choice(made)() for _ in range(n)]


def test_reduced():
    q = spec.QuerySpec()
    for action in (("weight", "food", "40"), ("filter", "max_rent", "150000"), ("minimum", "safety", "7"), ("minimum", "food", "5"), ("minimum", "safety", "8"), ("heatmap", None, "true"), ("dimension", None, "food")):
        q = spec.reduced(q, *action)
    assert spec.encode(q) == "w=18%2C18%2C14%2C10%2C40%2C8%2C4%2C4%2C8%2C4&mr=150000&cm=safety%3A8%2Cfood%3A5&hm=1&hd=food"
    assert spec.reduced(spec.QuerySpec(), "hydrate", None, "?" + spec.encode(q)) == q
    assert spec.encode(spec.reduced(q, "minimum", "safety", None)).count("cm=food%3A5") == 1
    for k in "abcad":
        q = spec.reduced(q, "compare", None, k)
    assert q.compare == ("a", "b", "c") and spec.reduced(q, "uncompare", None, "b").compare == ("a", "c")
    assert spec.reduced(q, "reset_filters").filters == spec.Filters() and spec.reduced(q, "reset_weights").weights == spec.DEFAULT_WEIGHTS
    rng = random.Random(1)
    for action in random_actions(rng, 500):
        q = spec.reduced(q, *action)
        assert spec.loaded(spec.dumped(q)) == q


START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(us):
    return START + datetime.timedelta(microseconds=us)


def bursts_by_loop(rows, gap, base=None):
    """key, n, last time and last value, or the URL of all actions so far."""
    out, by_key = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    for key, own in by_key.items():
        n, q = 0, spec.QuerySpec()
        for i, (_, t, _, *what) in enumerate(own):
            n, q = n + 1, spec.reduced(q, *what) if base else q
            if i + 1 == len(own) or own[i + 1][1] - t >= gap:
                out.append((key, n, t, spec.share_url(base, q) if base else what[0]))
                n = 0
    return sorted(out, key=repr)


def test_query_urls_from_a_stream(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(400) * 100_000, i, *a) for i, a in enumerate(random_actions(rng, 300))]
    df = spark.createDataFrame([(k, at(t), i, *a) for k, t, i, *a in rows], "user long, time timestamp, i long, action string, name string, value string")
    got = state.replayed(df, "time", lambda s: state.query_urls(s, "user", "time", "i", 300_000, "/x"), parts=3)
    start = int(START.timestamp()) * 1_000_000
    assert sorted(((k, n, t - start, v) for k, n, t, v in map(tuple, got.collect())), key=repr) == bursts_by_loop(rows, 300_000, "/x")


def test_bursts_from_a_stream(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c'd"]), rng.randrange(1_000) * 50_000, i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame([(k, at(t), i, v) for k, t, i, v in rows], "k string, time timestamp, i long, value string")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = state.replayed(df, "time", lambda s: state.bursts(s, "k", "time", "i", "value", 300_000))
    start = int(START.timestamp()) * 1_000_000
    assert sorted(((k, n, t - start, v) for k, n, t, v in map(tuple, got.collect())), key=repr) == bursts_by_loop(rows, 300_000)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


# --- timetables -----------------------------------------------------------------------------------------------------


def trip(name, *stops):
    return {"id": name, "tt": [dict(s=s, **{k: t for k, t in (("a", a), ("d", d)) if t is not None}) for s, a, d in stops]}


def test_only_changed_files_are_read_again(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    (folder / "deep").mkdir(parents=True)
    write = lambda name, trips: (folder / name).write_text(json.dumps(trips))
    write("a.json", [trip("A.Weekday", ("x", None, "22:10"), ("y", "23:50", "00:20"), ("z", "00:40", None)), trip("B.SaturdayHoliday", ("x", None, "00:10"))])
    write("deep/b.json", [trip("C.Weekday", ("x", None, "23:00"), ("x", None, "bad"), ("", None, "23:30")), {"id": "D.Weekday"}])
    write("c.json", [])
    (folder / "notes.txt").write_text("[]")
    rows, read, gone = timetables.scanned(spark, str(folder), cache)
    assert (read, gone) == (3, 0) and rows.count() == 4
    last = {r["station"]: (r["weekday"], r["holiday"]) for r in timetables.last_trains(timetables.departures(rows)).collect()}
    assert last == {"x": (23 * 60, None), "y": (20, None)}
    assert timetables.scanned(spark, str(folder), cache)[1:] == (0, 0)
    time.sleep(0.02)
    write("deep/b.json", [trip("C.Weekday", ("x", None, "23:40"))])
    again, read, gone = timetables.scanned(spark, str(folder), cache)
    assert (read, gone) == (1, 0) and again.count() == 3
    os.remove(folder / "a.json")
    write("d.json", [trip("E.SaturdayHoliday", ("q", "22:30", None), ("q", "x", "02:59"), ("q", None, "03:00"))])
    final, read, gone = timetables.scanned(spark, str(folder), cache)
    assert (read, gone) == (1, 1)
    last = {r["station"]: (r["weekday"], r["holiday"]) for r in timetables.last_trains(timetables.departures(final)).collect()}
    assert last == {"x": (23 * 60 + 40, None), "q": (None, 179)}
    assert rows.count() == 4  # a reader of the first version still has it


# --- encodings ------------------------------------------------------------------------------------------------------


def prices_by_loop(files, prefectures):
    out = {}
    for name in sorted(files):
        for encoding in ("utf-8-sig", "shift_jis", "cp932"):
            try:
                text = files[name].decode(encoding)
                break
            except UnicodeDecodeError:
                text = ""
        for row in csv.reader(io.StringIO(text, newline="")):
            if len(row) < 3:
                continue
            row = [c.strip() for c in row]
            i = next((i for i, c in enumerate(row) if len(c) == 5 and c.isdigit() and c[:2] in prefectures), None)
            if i is None:
                continue
            found = []
            for v in row[i + 2 :]:
                try:
                    n = int(float(v.replace(",", "")))
                except ValueError:
                    continue
                found += [n] if 10_000 <= n <= 500_000 else []
            if found:
                out[row[i]] = (row[i], row[i + 1] if i + 1 < len(row) else "", row[i][:2], *(found + [None, None])[:3])
    return sorted(out.values())


def test_folder_of_encodings(spark, tmp_path):
    rng = random.Random(4)

    def line():
        code = rng.choice(["13101", "13102", "14001", "11999", "99999", "1310", "12001x"])
        cell = lambda: rng.choice(['"65,000"', "70000", "-", "***", "…", "", "9999", "500001", "123456.7", '"1,0"', "x", " 88000 "])
        return ",".join([*rng.sample(["全国", '"a,b"', "", '"say ""hi"""'], rng.randrange(3)), code, rng.choice(["千代田区", '"新宿区, 東"', "港区"]), *(cell() for _ in range(rng.randrange(5)))])

    files = {}
    for i, how in enumerate(["utf-8", "utf-8-sig", "shift_jis", "cp932", "utf-8", "shift_jis", "cp932"]):
        lines = [line() for _ in range(rng.randrange(5, 40))] + ["メモ,㈱①,x" if how == "cp932" else "メモ,x,y", "", "short,13101"]
        files[f"{i}.csv"] = "\n".join(lines).encode(how)
    files["8.csv"] = b"\xff\xfe\x81,13101,x,70000\n13102,y,80000\n"
    files["9.csv"] = b""
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    lines = readers.decoded(readers.raw_lines(spark, str(tmp_path)))
    assert {(r["file"][-5:], r["encoding"]) for r in lines.select("file", "encoding").distinct().collect()} == {("0.csv", "utf-8"), ("1.csv", "utf-8"), ("2.csv", "shift_jis"), ("3.csv", "cp932"), ("4.csv", "utf-8"), ("5.csv", "shift_jis"), ("6.csv", "cp932"), ("8.csv", None)}
    got = readers.area_prices(lines, ("11", "12", "13", "14"))
    assert sorted(map(tuple, got.collect())) == prices_by_loop(files, ("11", "12", "13", "14"))


def test_cells(spark):
    lines = ["", "a", "a,b", '"a,b",c', ' "x" , y ', '"say ""hi""",', ",,", '"open,13101']
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", readers.csv_cells(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in got} == {"": [""], "a": ["a"], "a,b": ["a", "b"], '"a,b",c': ["a,b", "c"], ' "x" , y ': ["x", "y"], '"say ""hi""",': ['say "hi"', ""], ",,": ["", "", ""], '"open,13101': ['"open', "13101"]}
