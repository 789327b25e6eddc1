"""The corpus operators against brute force on small fixtures: nulls, empty texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import bloom, bpe, decontam, exact_dedup, jaccard, line_dedup, pii, quality, registry, sharding, toxicity, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, hash string, shard int, label string, line string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 9, "h", 1, "l", "x") for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- line dedup -----------------------------------------------------------------------------------------------------


def lines_brute(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"common line number {k} É" for k in range(12)] + ["short", "", "  ", "\tCOMMON LINE NUMBER 3 É \r", "x" * 5000]
    rows = [(i, "\n".join(rng.choice([*pool, f"own line of {i} and {rng.random()}"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (None, rows[1][1])]
    got = line_dedup.cleaned(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, got.collect()), key=repr) == lines_brute(rows)


def test_line_bitmaps(spark):
    df = spark.createDataFrame([([0, 1, 4], 6), ([2], 3), ([0, 1], 2), ([], 2)], "gone array<int>, n int")
    got = [[tuple(r) for r in x[0]] for x in df.select(line_dedup.packed(F.col("gone"), F.col("n"))).collect()]
    assert got == [[(2, 2), (5, 1)], [(0, 2)], [], [(0, 2)]]


def test_line_dedup_empty(spark):
    assert line_dedup.cleaned(frame(spark, []).limit(0)).count() == 0


# --- exact dedup ----------------------------------------------------------------------------------------------------


def exact_brute(rows):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((i, t))
    out = []
    for n, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0]
        out += [(i, keep, len(g), sha(n)) for i, _ in g]
    return sorted(out, key=repr)


def test_exact_dedup(spark, tmp_path):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (5, None), (6, ""), (7, " \n"), (8, "é" * 9000), (9, "é" * 9000), (10, "x"), (11, "x "), (12, "x"), (12, "x"), (None, "x")]
    for name in ("one", "two"):
        path = str(tmp_path / name)
        (frame(spark, rows) if name == "one" else frame(spark, rows).coalesce(1)).write.parquet(path)
        if name == "two":
            path = str(next((tmp_path / name).glob("*.parquet")))
        got = exact_dedup.exact_dedup(spark, path).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == exact_brute(rows)
        assert sum(r["kept"] for r in got) == len(exact_brute(rows) and {r["text_sha256"] for r in got})


def test_exact_dedup_goes_on(spark, tmp_path):
    """A second run reads the files that are new, with the state of the first; a longer copy takes over as the row that stays."""
    first = [(5, "a b"), (6, "ab"), (7, "c"), (9, None)]
    more = [(1, "a  b "), (2, "c"), (3, "d"), (4, " ")]
    table, at = str(tmp_path / "table"), str(tmp_path / "state")
    frame(spark, first).write.parquet(table)
    short = lambda df: sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)
    assert short(exact_dedup.exact_dedup(spark, table, at=at)) == exact_brute(first)
    frame(spark, more).write.mode("append").parquet(table)
    got = exact_dedup.exact_dedup(spark, table, at=at)
    assert short(got) == exact_brute(first + more)
    assert {r["doc_id"] for r in got.collect() if r["kept"]} == {r[1] for r in exact_brute(first + more)}
    batches = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/changes").groupBy("batch").sum("group_size").collect()
    assert len(batches) == 2


def test_exact_dedup_empty(spark, tmp_path):
    frame(spark, []).limit(0).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none")).count() == 0


def test_exact_dedup_by_text(spark):
    rows = spark.createDataFrame([(1, "a", "f", 0, b"d"), (2, "b", "f", 1, b"d"), (3, "a ", "f", 2, b"d")], "doc_id long, text string, file string, row long, digest binary")
    got = exact_dedup._by_text(rows).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


# --- PII ------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_brute(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def listed(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]


ODD = [
    None, "", "a@b.c%x@y.zz and é🙂 me.too+1@mail-0.example.com.", "1.2.3.4.5 999.1.2.3 0255.000.1.2 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "+49 (30) 123.456-78 +1 2 +123456789012345678 ++49301234567", "1" * 3000 + "." * 50 + "2.2.2.2", "a" * 5000 + "@", "x@y" + ".z" * 4000, "12-3 " * 2000, "\n4111\n1111",
]


def test_pii_base(spark):
    rng = random.Random(5)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice("aB1 2.3-@+%()\n9é") for _ in range(rng.randrange(300)))) for i in range(300)]
    got = {r["doc_id"]: listed(r["base"]) for r in pii.find(frame(spark, rows)).collect()}
    assert got == {i: base_brute(t) for i, t in rows}


def test_pii_terms_and_text(spark):
    rows = [(i, f"plain words number{i} everywhere and again\nwrite to Zorblax at secret@corp.example.com {'please ' * i}now") for i in range(6)]
    rows += [(50 + i, f"plain words everywhere please now write again {i}") for i in range(40)]
    found = pii.find(frame(spark, rows))
    joined = found.join(frame(spark, rows).select("doc_id", "text"), "doc_id")
    got = {r["doc_id"]: (r["text"], r["added"], r["clean"]) for r in joined.withColumn("clean", pii.sanitised(F.col("text"), F.concat("base", "added"))).collect()}
    for i in range(6):
        text, added, clean = got[i]
        assert {text[s["start"] : s["end"]] for s in added} == {"Zorblax"}
        assert "secret@" not in clean and "[EMAIL]" in clean and "Zorblax" not in clean
    assert all(not got[50 + i][1] and got[50 + i][2] == got[50 + i][0] for i in range(40))


def test_pii_rare_entities(spark):
    """One or two texts with an entity are enough for a name; chance words near it and far copies of nothing stay."""
    plain = [(100 + i, f"the people of this town buy bread and milk, number {i}, and walk home again") for i in range(300)]
    rows = [
        (1, "the people ask Brelmo at one@corp.example.com for bread and oddword again\nlater Brelmo walks home"),
        (2, "call flurb under two@corp.example.com and buy bread"),
        (3, "again flurb then two@corp.example.com for milk of this town"),
        (4, "people ask Xu at four@corp.example.com for milk"),
        *plain,
    ]
    texts = dict(rows)
    found = pii.find(frame(spark, rows)).collect()
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in found if r["added"]}
    assert got == {1: ["Brelmo", "Brelmo"], 2: ["flurb"], 3: ["flurb"], 4: ["Xu"]}


def test_pii_copies_are_no_evidence(spark):
    """A chance word in many copies of a single text isn't shown by them."""
    rows = [(i, "buy bread from oddword now at one@corp.example.com again") for i in range(9)] + [(100 + i, f"buy bread now and again from here {i}") for i in range(200)]
    assert not any(r["added"] for r in pii.find(frame(spark, rows)).collect())


def test_pii_planted_names(spark):
    """Of 150 names, each beside its own address in three to five texts, at least 97 in 100 are found in all of these, and at most 3 in 100 of what is found are other words."""
    rng = random.Random(13)
    common = ["bread", "milk", "people", "walk", "again", "town", "market", "river", "letter", "window", "morning", "street"]
    rare = [f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.choice('lmnrt')}{rng.choice('aeiou')}{rng.choice('ps')}{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(1_000)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.9 else rng.choice(rare) for _ in range(n)]
    rows, want = [], set()
    for k in range(150):
        name = f"qu{k:03d}zo".translate(str.maketrans("0123456789", "abcdefghij"))
        for _ in range(rng.randrange(3, 6)):  # of words without a capital, two texts aren't evidence enough among so many pairs
            near = text(rng.randrange(2, 8))
            near.insert(rng.randrange(len(near)), name)
            rows.append((len(rows), " ".join([*text(30), ".", *near, f"p{k}@corp.example.com", *text(4), ".\n", *text(30)])))
            want.add((rows[-1][0], name))
    rows += [(10_000 + i, " ".join(text(60))) for i in range(600)]
    texts = dict(rows)
    got = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in pii.find(frame(spark, rows)).collect() for s in r["added"]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got), (len(want), len(got), len(got & want), sorted(got - want)[:5])


def test_pii_empty(spark):
    assert pii.find(frame(spark, []).limit(0)).count() == 0


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rng = random.Random(6)
    bodies = ["<p>é</p>" * k for k in (0, 3, 40, 41)] + ["y" * 300_000]
    rows = [(i, rng.choice(["http://a.example.com/x?q=1", "https://www.b.example.org:8443/\n", None, "http://a.example.com/y"]), rng.choice([*bodies, None, f"own {i} " * 30])) for i in range(400)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, file string, offset int").repartition(3)
    got = sorted(map(tuple, warc.archive_and_replay(pages).collect()))
    first, expected = {}, []
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(expected)


def test_warc_lookup(spark):
    from rankloom.llm.common import scratch

    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i}", f"body {i}") for i in range(900)], "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    index = warc.Index(warc.write_archives(pages, folder), least_block=50, max_blocks=9)
    assert len(index.directory.value[0]) <= 9 + 8
    wanted = spark.createDataFrame([("http://h3.example.com/3", 3), ("http://nowhere.example.com/", 3), ("http://h1.example.com/899", 899)], "url string, page_id long")
    got = warc.read_ranges(index.locate(wanted), folder, with_payload=True)
    assert {(r["page_id"], bytes(r["payload"])) for r in got.collect()} == {(3, b"body 3"), (899 if 899 % 7 == 1 else 3, b"body 899" if 899 % 7 == 1 else b"body 3")}


def test_warc_negative_ids(spark):
    ids = [-(2**63), -12, -5, -1, 0, 5, 12, 2**63 - 1]
    pages = spark.createDataFrame([(i, "http://a.example.com/", f"body {i}") for i in ids], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.archive_and_replay(pages).collect()) == ids
    keyed = spark.createDataFrame([(i,) for i in [*ids, None]], "i long").select("i", warc.padded(F.col("i")).alias("k")).orderBy("k").collect()
    assert [r["i"] for r in keyed] == [*ids, None]


def test_url_keys():
    assert warc.url_key("HTTP://user@WWW.Example.COM:80/a?b=C#d") == "com,example)/a?b=C"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key(None) == ")/"


# --- decontamination ------------------------------------------------------------------------------------------------


def contamination_brute(docs, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            for window in [x[k : k + width] for k in range(max(1, len(x) - width + 1))] if x else []:
                for s in range(len(w) - len(window) + 1):
                    if w[s : s + len(window)] == window:
                        hit |= set(range(s, s + len(window)))
                        found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [28, 7])
def test_decontamination(spark, most, monkeypatch):
    """With a filter that lets nearly everything through, results are the same."""
    monkeypatch.setattr(bloom, "MOST", most)
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, rng.randrange(1, 25), 30))) for k in range(12)] + [(50, None), (51, "!!"), (52, "W1É w2é"), (3, "w1é w2é")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 60), 30)
        if i % 3 == 0:
            x = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, ", ".join(w).replace("w1é", "W1é")))
    docs += [(100, None), (101, ""), (102, "w1é-w2é W1éw2é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame(spark, docs), bench).collect()
    assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in got} == contamination_brute(docs, items)
    kept = {r["doc_id"] for r in decontam.clean(frame(spark, docs), bench).collect()}
    assert kept == {i for i, (_, hit, _) in contamination_brute(docs, items).items() if not hit}


def test_decontamination_word_that_all_have(spark):
    """An item of one word that every document has is found in all of them."""
    rows = [(i, f"common w{i} " + "x " * (i % 7)) for i in range(3_000)]
    bench = spark.createDataFrame([(1, "common"), (2, "never there")], "item_id long, text string")
    got = decontam.contamination(frame(spark, rows), bench).collect()
    assert len(got) == 3_000 and all(r["items"] == [1] and [tuple(s) for s in r["spans"]] == [(0, 1)] for r in got)


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in decontam.contamination(frame(spark, [(1, "a b")]), bench).collect()] == [[]]


# --- n-gram Jaccard join --------------------------------------------------------------------------------------------


def families_brute(rows, n, num):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, groups=14):
    rows = []
    for g in range(groups):
        base = words(rng, rng.choice([1, 3, 4, 5, 8, 20, 60, 150]), 400)
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 14) + 1)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(w).replace("w1", "W1")))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, rows[3][1]), (904, rows[3][1].replace(" ", "\t "))]


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_jaccard(spark, n, num):
    rows = near_copies(random.Random(n))
    got = sorted(map(tuple, jaccard.families(frame(spark, rows), n, num, block=7).collect()))
    assert got == families_brute(rows, n, num)


def test_jaccard_repeated_and_null_ids(spark):
    """Rows that share an id, or have none, are documents of their own; they cost no more than others."""
    rng = random.Random(12)
    took = {}
    for name in ("first", "own", "one", "none"):
        rows = []
        for k in range(500):
            w = words(rng, 60, 5_000)
            rows += [" ".join(w), " ".join([*w, "more"])] * 2
        ids = {"own": range(2_000), "first": range(2_000), "one": [7] * 2_000, "none": [None] * 2_000}[name]
        began = time.perf_counter()
        got = jaccard.families(frame(spark, list(zip(ids, rows))), 4, 85).collect()
        took[name] = time.perf_counter() - began
        assert len(got) == 2_000
        if name == "own":
            assert all(r["component_id"] == r["doc_id"] // 4 * 4 for r in got)
        else:
            assert name == "first" or {r["component_id"] for r in got} == {ids[0]}
    assert max(took["one"], took["none"]) < 2 * took["own"] + 3, took


def test_jaccard_empty(spark):
    assert jaccard.families(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_jaccard_large_groups(spark, block, monkeypatch):
    """Groups of many near copies, groups that come close to each other, a passage in many texts, and every link from a tree."""
    rng = random.Random(12)
    rows = []
    base = words(rng, 120, 4000)
    for g in range(3):
        at = g * 13
        own = [*base[:at], *words(rng, 25, 4000), *base[at + 25 :]]
        for k in range(90):
            w = list(own)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    passage = words(rng, 60, 4000)
    rows += [(1000 + k, " ".join([*words(rng, 12, 10**6), *passage])) for k in range(80)]
    rng.shuffle(rows)
    got = sorted(map(tuple, jaccard.families(frame(spark, rows), 4, 85, block=block).collect()))
    assert got == families_brute(rows, 4, 85)


def test_jaccard_links_come_from_trees(spark, monkeypatch):
    """Without links from the trees every node is alone: nothing else joins different texts."""
    rows = near_copies(random.Random(4))
    monkeypatch.setattr(jaccard, "tree_links", lambda *_: [])
    texts = {}
    for i, _, c in jaccard.families(frame(spark, rows), 4, 85).collect():
        texts.setdefault(c, set()).add(" ".join((dict(rows)[i] or "").lower().split()))
    assert all(len(t) == 1 for t in texts.values())
    assert len(texts) > len({c for _, _, c in families_brute(rows, 4, 85)})


def test_prefixes_share_enough():
    """Sets at the threshold share as many hashes of their prefixes as shared() says."""
    import numpy as np

    rng = np.random.default_rng(1)
    for num in (80, 85):
        for size in [*range(1, 60), 90, 130, 400, 1500]:
            for _ in range(4):
                a = b = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                while jaccard.linked(a, b, num) and len(b) < 4 * size + 10:
                    low, high = sorted((len(a), len(b)))
                    assert len(np.intersect1d(jaccard.prefix(a, num), jaccard.prefix(b, num))) >= jaccard.shared(low, num) >= jaccard.shared((num * high + 99) // 100, num)
                    c = np.delete(b, rng.integers(0, len(b), int(rng.integers(0, 2)))) if len(b) > 1 else b
                    b = np.unique(np.concatenate([c, rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))


def test_trees_find_all_links():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 63, int(rng.integers(3, 120)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            keep = base[rng.random(len(base)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, 2, dtype=np.uint64)])))
    tree = jaccard.Tree(sets)
    got = set()
    for i, j in jaccard.traverse(tree, tree, 80, True):
        got |= {tuple(sorted((int(tree.order[p]), int(tree.order[q])))) for p, q in zip(i, j) if jaccard.linked(tree.sets[p], tree.sets[q], 80)}
    assert got == {(p, q) for q in range(len(sets)) for p in range(q) if jaccard.linked(sets[p], sets[q], 80)}


# --- BPE ------------------------------------------------------------------------------------------------------------


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path(spark)
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [None, "", " ", "a<|endoftext|>b  <|endoftext|>", "\n\n  x\t\ty 　z", "é" * 300 + " 🙂🙂" + "ab" * 5000, "\0 ﻿ don't 123 ４５", "a b  c \r\n", "x" * 70_000]
    texts += ["".join(rng.choice("aé 🙂\n1'st.,-") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = list(enumerate(texts))
    encoded = bpe.encode(frame(spark, rows), path)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert ids == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}
    digests = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, rows), path).collect()}
    assert all(digests[i]["n_tokens"] == len(x) and digests[i]["ids_sha256"] == sha(",".join(map(str, x))) and digests[i]["decoded_sha256"] == sha(texts[i] or "") for i, x in ids.items())


def test_bpe_texts_that_begin_with_a_space():
    from tokenizers import Tokenizer

    path = bpe.default_path(None)
    library, own = Tokenizer.from_file(path), bpe.of(path)
    rng = random.Random(9)
    texts = [" a", " hello world", " hello", " ", "  ", " \n", "a ", " a ", " 1", " ...", "\n a b"]
    texts += ["".join(rng.choice([" ", "a", "the", "é", "1", ".", "\n", "🙂", "'s", "<|endoftext|>"]) for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    texts += [" " + " ".join(words(rng, rng.randrange(1, 6))) for _ in range(300)]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(text)


# --- sharding -------------------------------------------------------------------------------------------------------


def test_sharding_copies_of_a_row(spark):
    """Copies of one row, a third of all, have slots of their own without gaps."""
    rows = [(i, f"text {i}") for i in range(200)] + [(7, "copied")] * 100 + [(None, None)] * 5
    got = sharding.shard(frame(spark, rows), shards=5).collect()
    assert len(got) == 305
    for k in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1 and sum(r["doc_id"] == 7 for r in got) == 101


def test_sharding(spark):
    rows = [(i, f"text é {i % 50}" * (i % 7)) for i in range(3000)] + [(5, "again"), (5, "again"), (None, None), (None, "x")]
    got = sharding.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    slots, of = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(x) == 1 for x in of.values())
    assert 20 < sum(r["grown_shard"] == 40 for r in got) < 150
    by_id = {(i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == by_id


def test_jump_hash_reference():
    import numpy as np

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    assert sharding.jump_hash(keys, 40).tolist() == [jump(int(k), 40) for k in keys]


# --- classifiers ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label", [("op1_toxicity", "toxic"), ("op10_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[label] for r in held) / len(held) > 0.9


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(spark, module, label):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "a"), (4, "a"), (None, "b")]
    labels = spark.createDataFrame([(1, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.Model(frame(spark, rows), labels.limit(0)).score(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in module.Model(frame(spark, rows), labels).score(frame(spark, rows)).collect())
    assert module.Model(frame(spark, rows), labels).score(frame(spark, rows).limit(0)).count() == 0


def test_trees_and_isotonic():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.7)).astype(float)
    score = toxicity.Trees(x, y).sum(x)
    assert ((score > 0) == (y == 1)).mean() > 0.97
    knots, level = toxicity.isotonic(score, y)
    assert (np.diff(level) >= 0).all() and (np.diff(knots) >= 0).all() and 0 <= level.min() and level.max() <= 1


def features_brute(text, lexicon):
    """The features of a text, counted one by one in plain Python."""
    edges, you_words = toxicity.EDGES, toxicity.SECOND_PERSON
    weight = lambda w: max((lexicon.get(t, 0.0) for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]), default=0.0)
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(toxicity.FEATURES)
    tokens = text.split()
    found = []
    for token in tokens:
        word = token.strip(edges).lower()
        mixed = bool(toxicity.MIXED.fullmatch(word)) and "@" not in word[1:-1] and len(word) < 30
        plain = weight(word) if word else 0.0
        letters = "".join(c if c.isalpha() else " " for c in word).replace(" ", "")
        hidden = max(weight(word.translate(toxicity.PLAIN)), weight(letters)) if not plain and mixed else 0.0
        found.append((plain, hidden, word in you_words, mixed))
    n = max(1, len(tokens))
    hits = [i for i, f in enumerate(found) if max(f[0], f[1]) > 0]
    you = [i for i, f in enumerate(found) if f[2]]
    weights = [max(f[0], f[1]) for f in found if max(f[0], f[1]) > 0]
    gaps = [min(abs(i - j) for j in you) for i in hits] if you else []
    byte = lambda test: sum(map(test, raw)) / len(raw)
    capitals, small = byte(lambda b: 65 <= b <= 90), byte(lambda b: 97 <= b <= 122)
    blank, asked, digit = byte(lambda b: b in b" \t\n\r\x0b\x0c"), byte(lambda b: b in b"!?"), byte(lambda b: 48 <= b <= 57)
    beyond = byte(lambda b: b >= 128)
    return [
        math.log1p(len(tokens)), sum(weights) / n, math.log1p(len(hits)), max(weights, default=0), sum(weights) / max(1, len(hits)),
        sum(f[1] > 0 for f in found) / n, math.log1p(sum(f[1] > 0 for f in found)), len(you) / n, 1 / (min(gaps) + 1) if gaps else 0, sum(g <= toxicity.NEAR for g in gaps) / len(gaps) if gaps else 0,
        capitals, float(capitals / max(capitals + small, 1e-9) > 0.6), asked, 1 - capitals - small - blank - asked - digit - beyond, digit, blank, beyond, sum(f[3] for f in found) / n, len(raw) / n,
    ]


def test_toxicity_features_are_the_plain_count():
    rng = random.Random(14)
    lexicon = {"idiot": 3.0, "stup*": 2.5, "morons": 2.2, "garb*": 4.0}
    pool = ["you", "Your", "idiot", "IDIOT!", "1diot", "st.u.p.i.d", "stupid", "garbage?", "g@rbage", "mor0ns", "the", "Éclair", "42", "...", "du", "a@b.c", "x" * 90]
    texts = [None, "", " ", "IDIOT", "you idiot!"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    words = toxicity.Words(lexicon)
    for text in texts:
        assert toxicity.features(text, words) == pytest.approx(features_brute(text, lexicon), abs=1e-9), text
    assert not any(len(w) > toxicity.SHORT for w in words)


def test_word_vectors_are_the_plain_sums(spark):
    """Sums of index vectors of neighbours, and their mean and spread over a document, against loops over words."""
    import numpy as np

    rng = random.Random(15)
    texts = [None, "", "one"] + [" ".join(words(rng, rng.randrange(1, 30), 20)) for _ in range(40)] + ["word word other word"]
    at, sign = quality.index_vectors()
    index = np.zeros((quality.ROWS + 1, quality.DIM))
    for r in range(quality.ROWS):
        for j, s in zip(at[r], sign[r]):
            index[r, j] += s
    rows = [quality.rows_of(t, quality.Codes()).tolist() for t in texts]
    expected = np.zeros((quality.ROWS, quality.DIM))
    for r in rows:
        for i, own in enumerate(r):
            for j in range(max(0, i - quality.REACH), min(len(r), i + quality.REACH + 1)):
                if j != i:
                    expected[own] += index[r[j]]
    got = quality.context_sums(frame(spark, list(enumerate(texts))))
    assert (got == expected).all() and got.any()
    vectors = rng_vectors = np.random.default_rng(2).random((quality.ROWS, quality.DIM)).astype(np.float32)
    for r, x in zip(rows, quality.pooled(texts, rng_vectors, quality.Codes())):
        v = np.array([vectors[i] for i in r], np.float64).reshape(len(r), quality.DIM)
        if len(r):
            assert x[: quality.DIM] == pytest.approx(v.mean(axis=0), abs=1e-4) and x[quality.DIM : 2 * quality.DIM] == pytest.approx(v.std(axis=0), abs=1e-3)
        else:
            assert not x.any()


def test_labelled_rows_have_a_bound(spark):
    """A labelled id on very many rows gives one row to learn from, and the text that is taken doesn't depend on the order."""
    docs = [(1, f"text {i}") for i in range(500)] + [(i, "t") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(1, 40)] + [(1, 1)], "doc_id long, quality int")
    got = quality.labelled(frame(spark, docs), labels, "quality", 1000).collect()
    assert len(got) == len({r["_id"] for r in got}) <= 39
    again = quality.labelled(frame(spark, docs[::-1]), labels, "quality", 1000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


# --- SQL ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_are_their_sql(spark, name):
    import duckdb

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, found = registry.QUERIES[name](spark, sf), c.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in columns) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


# --- long texts and leading spaces ----------------------------------------------------------------------------------


def test_pii_long_text(spark):
    """A text of 40,000 words takes no more than the times that its length is that of one of 5,000, with what a run takes anyway."""
    rng = random.Random(16)
    plain = [rng.choice(["bread", "milk", "people", "walk", "again", "town"]) for _ in range(40_000)]

    def run(n):
        long = " ".join([*plain[: n // 2], "ask Brelmo at one@corp.example.com for bread", *plain[n // 2 : n], "Brelmo"])
        rows = [(1, long), (2, "people ask Brelmo at one@corp.example.com again")] + [(10 + i, f"people ask and walk in town at bread for again {i}") for i in range(50)]
        began = time.perf_counter()
        got = {r["doc_id"]: [long[s["start"] : s["end"]] for s in r["added"]] for r in pii.find(frame(spark, rows)).collect()}
        assert got[1] == ["Brelmo", "Brelmo"]
        return time.perf_counter() - began

    run(100)
    few, many = run(5_000), run(40_000)
    assert many < 8 * few, (few, many)  # with the square of the length it's 64 times the part that isn't fixed


def test_running_sums(spark):
    rng = random.Random(17)
    rows = [(i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 255, 256, 257, 512, 3000))]
    got = spark.createDataFrame(rows, "i int, n array<int>").select("i", pii.running_sums(F.col("n")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: [sum(n[: k + 1]) for k in range(len(n))] for i, n in rows}
