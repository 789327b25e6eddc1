"""The pipeline's stages against brute-force versions, each on what its predecessor kept."""

from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import bpe
from tests.llm.test_operators import contamination_brute, families_brute, lines_brute, sha

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in kept[:-1]]
    start, good, lines, firsts, clean = texts
    assert good.items() <= start.items() and len(good) > 0.7 * len(start)
    assert sorted((i, sha(t)) for i, t in lines.items()) == sorted((i, h) for i, _, _, h in lines_brute(sorted(good.items())))
    component = {i: c for i, _, c in families_brute(sorted(lines.items()), 5, 80)}
    assert firsts == {i: t for i, t in lines.items() if component[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = contamination_brute(sorted(firsts.items()), items)
    assert clean == {i: t for i, t in firsts.items() if not hits[i][1]}
    library = Tokenizer.from_file(bpe.default_path(spark))
    assert {r["doc_id"]: list(r["ids"]) for r in kept[-1].collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    assert {r["doc_id"]: r["text"] for r in kept[-1].collect()} == clean


def test_first_line_dropped(spark, tmp_path):
    """A text that begins with a space once its first line is gone goes through the last stages."""
    rows = [(i, f"a line that many documents share\n only{i} here" if i else "a line that many documents share", "en", "s", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["line_dedup"](spark, docs, SF)
    got = {r["doc_id"]: r["text"] for r in stages["bpe"](spark, cut, SF).collect()}
    assert got == {0: "a line that many documents share", **{i: f" only{i} here" for i in range(1, 6)}}
