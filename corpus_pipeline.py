"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of `documents`. A document that the quality classifier rejects goes; lines
that an earlier document holds go, and n_chars with them; of each group of near copies (five-word shingles, Jaccard
index of 0.8 or more) the first document stays; a document with ten words in a row of a benchmark item goes; what is
left is encoded, and decoded again from its ids.

Defined results: a null text counts as empty and is scored like any other; a document may lose all its lines and is an
empty text from there on; documents without words are near copies of nothing; an empty table goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, decontam, jaccard, line_dedup, quality
from rankloom.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.Model(docs, table(spark, sf_dir, "labels")).accepted(docs).select(*COLUMNS)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.cleaned(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS), jaccard.families(docs, n=5, num=80))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and the text that they decode to: what a model is trained on."""
    return bpe.encode(docs, bpe.default_path(spark), decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("line_dedup", own_lines),
    ("near_copies", first_of_copies),
    ("decontamination", unleaked),
    ("bpe", tokens),
]

#: SQL can't express a trained classifier or byte-pair merges; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
