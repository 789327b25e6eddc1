"""Resampling, collocations, URL filters and Bloom filters against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bloom, collocations, reputation, resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n long, f long, rank int, score double, host string, word string"


def frame(spark, rows):
    """Documents (id, text, language) with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, 1, 1, 0.5, "h", "w") for i, t, lang in rows], SCHEMA).repartition(3)


# --- resampling -----------------------------------------------------------------------------------------------------


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent=5, least=20, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(of(f) for _, x, _ in rows for f in features(x)[1]), Counter(of(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x, _ in rows:
        n, found = features(x)
        weight = sum(gain(of(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(rng, n, lang=lambda i: "en"):
    word = lambda: rng.choice(["The", "of", "Straße", "x" * rng.randrange(1, 90), "a1", "日本", f"w{rng.randrange(40)}"])
    sep = lambda: rng.choice([" ", "  ", "-", "\n", ", ", "\x00", "_"])
    return [(i, "".join(word() + sep() for _ in range(rng.choice([0, 1, 2, 3, 15, 20, 21, 60]))), lang(i)) for i in range(n)]


def test_resampling(spark):
    rng = random.Random(5)
    rows = texts(rng, 150) + [(500, None, "en"), (501, "", None), (502, " .,; \x7f", "en"), (None, "null id " * 30, "en")]
    rows += [(600, "twice the same row " * 9, "en")] * 3 + [(601, rows[3][1], "de"), (601, rows[4][1], "de")]
    target = [t for _, t, _ in texts(rng, 20)] + [None, "", "the of the of"]
    want = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resampling.resample(frame(spark, rows), want, percent=30)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == resampled(rows, target, percent=30)
    kept = resampling.drawn(frame(spark, rows), got)
    drawn = {r["doc_id"] for r in got.where("rank is not null").collect()}
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r[0]) for r in rows if r[0] in drawn)


def test_resampling_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    words[100:102] = [b"long" * 200, b"longer" * 300]
    text = b"  ".join(words)
    whole = Counter(features(text.decode())[1])
    for size in (1, 7, 64, 500):
        monkeypatch.setattr(resampling, "PIECE", size)
        count, n_words = Counter(), 0
        for of, known, line in resampling.pieces([b"", text, None, b"a b"]):
            got, bucket, words_of = resampling.features(line, known, 1 << 31)
            count.update(bucket[np.array(of)[got] == 1].tolist())
            n_words += sum(int(n) for i, n in zip(of, words_of) if i == 1)
        assert n_words == 400
        assert count == Counter(zlib.crc32(f.encode()) % (1 << 31) for f in whole.elements())


def test_resampling_crc():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 200, 5000]))) for _ in range(2))
        assert int(resampling.moved_on(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none, percent=100).collect()] == [1]


# --- collocations ---------------------------------------------------------------------------------------------------


def phrases_brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {}
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in candidates.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for (m, q), b in candidates.items()):
            continue
        cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:top]))


def phrase_rows(rng):
    word = lambda: rng.choice(["New", "york", "city", "of", "the", "état", "x\x00y", "日本", f"r{rng.randrange(500)}"])
    piece = lambda: rng.choice([" ", "\t", "  "]).join(word() for _ in range(rng.randrange(0, 9)))
    return [(i, rng.choice([". ", ",", "\n", "\x0b", "; "]).join(piece() for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de", None, "und"])) for i in range(200)]


@pytest.mark.parametrize("shard", [1, 3_000, 8 << 20])
def test_collocations(spark, shard, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", shard)
    rows = phrase_rows(random.Random(8))
    rows += [(900, None, "fr"), (901, "", None), (902, "the of " * 4000, "en"), (903, "the of. the of", "de"), (903, "the of. the of", "de"), (None, "New york city", "en")]
    got = collocations.collocations(frame(spark, rows), least=6)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_brute(rows, 6)


def test_collocations_top_and_empty(spark):
    rows = phrase_rows(random.Random(9))
    got = collocations.collocations(frame(spark, rows), least=3, top=5)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases_brute(rows, 3, 5)
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0


def test_phrase_index():
    rng = random.Random(10)
    for _ in range(150):
        sigma, n = rng.choice([2, 3, 7]), rng.randrange(0, 60)
        ids = [rng.randrange(sigma) for _ in range(n)] + [0]
        names = pa.array([b"w%d" % i for i in range(1, sigma)], pa.binary())
        for longest, lengths in ((2, (2,)), (4, (3, 4))):
            want = Counter(" ".join(f"w{v}" for v in ids[i : i + m]) for m in lengths for i in range(len(ids) - m + 1) if 0 not in ids[i : i + m])
            got = [x for b in collocations._phrases("en", names, np.array(ids, np.int64), longest) for x in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist())]
            assert len(got) == len(want) and dict(got) == want


# --- URL filters ----------------------------------------------------------------------------------------------------


def judged_brute(rows, bad, limit=0.5, z=1.645):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return m[1].translate(FOLD), m[2]

    def groups(host):
        plain = re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"^.*@", "", host))
        p = plain.split(".")
        if re.match(r"[0-9.]+$|\[", plain) or "." not in plain:
            return plain, plain, ""
        k = 2 if len(p) > 2 and ".".join(p[-2:]) in reputation.SUFFIXES else 1
        return plain, ".".join(p[-k - 1 :]), ".".join(p[-k:])

    counts = [Counter(), Counter(), Counter()]
    bads = [Counter(), Counter(), Counter()]
    for i, url in rows:
        host = parts(url)[0]
        for level, g in enumerate(groups(host)):
            g = (g, groups(host)[2]) if level == 1 else g
            counts[level][g] += i in bad
            bads[level][g] += bad.get(i, False)

    def shrunk(level, above):
        n, k = counts[level], bads[level]
        off = sum((k[g] - n[g] * above[g]) ** 2 for g in n)
        chance = sum(n[g] * above[g] * (1 - above[g]) for g in n)
        more = sum(n[g] * above[g] * (1 - above[g]) * (n[g] - 1) for g in n)
        m = 1000 if more <= 0 else min(max(1 / max((off - chance) / more, 1e-9) - 1, 0.5), 1000)
        return {g: (k[g] + m * above[g]) / (n[g] + m) for g in n}, m

    base = (sum(bads[2].values()) + 1) / (sum(counts[2].values()) + 2)
    top, _ = shrunk(2, dict.fromkeys(counts[2], base))
    middle, _ = shrunk(1, {g: top[g[1]] for g in counts[1]})
    mean, m = shrunk(0, {g: middle[groups(g)[1], groups(g)[2]] for g in counts[0]})
    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = [(h + p, v) for v, h, p in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        g = groups(host)[0]
        bound = mean[g] - z * math.sqrt(mean[g] * (1 - mean[g]) / (counts[0][g] + m + 1))
        out.append((i, host, path, rule, verdict or ("block" if bound > limit else "allow")))
    return sorted(out, key=repr)


def test_url_filter(spark):
    rng = random.Random(11)
    hosts = ["good.example.org", "spam.biz", "a.spam.biz", "b.spam.biz", "www.Shop.co.uk", "co.uk", "x.example.net", "example.net", "notexample.com", "m.example.com", "10.0.0.1:80", "user:pw@spam.biz:8080", "localhost", "spam.biz.", "org", "fr.org"]
    paths = ["", "/", "/en/", "/en", "/de/x?y=/fr/", "/fr/1#top", "?q=/en/", "#/de/", "//", "/é\n/x"]
    rows = [(i, rng.choice(["http://", "HTTPS://", "x://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(600)]
    rows += [(700, None), (701, ""), (702, "no scheme/en/"), (703, "://"), (704, "http://a/b://c/d"), (705, "http://spam.biz/" + "x" * 20_000), (None, "http://spam.biz/"), (7, "http://spam.biz/"), (7, "http://spam.biz/")]
    bad = {i: ("spam" in (u or "")) ^ (rng.random() < 0.1) for i, u in rows if i is not None and rng.random() < 0.6 or i == 7}
    labels = [(i, b) for i, b in bad.items()] + [(i, False) for i, b in bad.items() if b and i % 3 == 0] + [(None, True), (99_999, True), (3, None)]
    pages = spark.createDataFrame([(i, u, "h", 0.5, "r") for i, u in rows], "page_id long, url string, host string, bound double, rule string")
    got = reputation.judged(pages, spark.createDataFrame(labels, "page_id long, bad boolean"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == judged_brute(rows, bad)
    verdicts = {(r["host"], r["rule"]): r["verdict"] for r in got.collect()}
    assert verdicts["spam.biz", None] == "block" and verdicts["good.example.org", None] == "allow" and verdicts["x.example.net", "net/"] == "block"
    gone = {r["page_id"] for r in got.where("verdict = 'block'").collect()}
    assert sorted(repr(r["page_id"]) for r in reputation.allowed(pages, got).collect()) == sorted(repr(i) for i, _ in rows if i not in gone)


def test_url_filter_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/"), (2, "http://x.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert sorted(r["verdict"] for r in reputation.judged(pages, none).collect()) == ["allow", "block"]
    assert reputation.judged(pages.limit(0), none).count() == 0


# --- Bloom filters --------------------------------------------------------------------------------------------------


def test_bloom(spark):
    inside = spark.range(0, 5_000).select(F.xxhash64("id").alias("h"))
    bits = bloom.made(inside, 5_000).value
    h = np.array([r["h"] for r in inside.collect()], np.int64).view(np.uint64)
    assert bloom.has(bits, h).all()
    other = np.array([r["h"] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert bloom.has(bits, other).mean() < 0.01
    assert not bloom.has(bloom.made(inside.limit(0), 0).value, h).any()
