"""Empty tables, null ids and texts, repeated rows and clashing columns, through operators and all stages of the pipeline."""

import hashlib

import pytest

import corpus_pipeline
from rankloom.llm import bpe, decontam, exact_dedup, jaccard, line_dedup, sharding, warc
from tests.llm.test_operators import frame

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"word{i}" for i in range(40))
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, _mark long, node long, mark long, key string, line string, label double, items int, at int, of int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 9, "k", 1, 2, 3, "x", "l", 0.5, 1, 2, 3) for i, t in rows], CLASHING)


def test_empty_tables(spark, tmp_path):
    none = frame(spark, []).limit(0)
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontam.contamination(none, bench).count() == decontam.clean(none, bench).count() == 0
    assert bpe.round_trip(none, bpe.default_path(spark)).count() == 0
    assert sharding.shard(none).count() == 0
    assert warc.archive_and_replay(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_repeated_and_null_pages(spark):
    body = "<p>the same long page</p>" * 9
    rows = [(1, "http://a/", body), (1, "http://a/", body), (2, None, body), (None, "http://b/", body), (None, None, None), (3, "http://c/", None), (3, "http://c/", "short")]
    pages = spark.createDataFrame([(*r, 0, "f") for r in rows], "page_id long, url string, html string, offset int, file string")
    got = sorted(map(tuple, warc.archive_and_replay(pages).collect()), key=repr)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i != 1  # rows of the least page are all responses
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)


def test_exact_dedup_of_a_very_long_text(spark, tmp_path):
    long = "long text of many words " * 40_000
    docs = frame(spark, [(1, long), (2, long.replace(" ", "\n")), (3, long + "x"), (4, None), (5, "")])
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, path).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False)}


def test_pipeline_without_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls, repeats and clashing columns: no stage fails, loses a clean document with an id of its own, or makes rows up."""
    known = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] if name == "quality" else []
    rows = [(9_001, None), (9_002, ""), (None, None), (None, WORDS), (9_003, WORDS), (9_004, WORDS + " and more of its own"), (9_005, "one"), (9_005, "one"), (9_006, "two\n\n"), *known]
    got = dict(corpus_pipeline.STAGES)[name](spark, odd(spark, rows), SF).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) <= len(rows) and set(ids) <= {i for i, _ in rows}
    if name == "quality":
        assert len(ids) > 0.7 * len(rows)
    else:
        assert {9_001, 9_002, 9_003, 9_005, 9_006} <= set(ids) and (9_004 in ids) == (name != "near_copies")
    if name in ("line_dedup", "decontamination", "bpe"):
        assert len(ids) == len(rows)


def test_operators_ignore_other_columns(spark):
    rows = [(1, WORDS), (2, WORDS), (3, None), (None, "short")]
    assert jaccard.families(odd(spark, rows)).count() == 4
    assert {r["n_dropped"] for r in line_dedup.cleaned(odd(spark, rows)).select("n_dropped").collect()} == {0, 1}
    assert sharding.shard(odd(spark, rows)).count() == 4
