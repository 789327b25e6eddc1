"""Benchmark decontamination as a prefix-filtered set join on windows of an item's words.

An item's windows are its runs of `width` words, or all of it where it has fewer. A window is the set of its shingles, of
three words each (or of all its words, where it has fewer); a document holds a window only if it holds each of them, so of
a window's shingles, put in order of rarity over all documents, the first is a sufficient prefix. Windows and documents
are joined on that shingle alone. Its place in both bounds where the window may begin and end; what fits inside the
document is then compared word for word. Both passes over the documents, which count shingles and find prefixes, are the
same whatever the size of the benchmark: a Bloom filter of bounded size tells which shingles may be the benchmark's, and
the join tells which are. A shingle that very many documents have is spread over tasks.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; repeated items
count once; repeated documents are each returned; an empty benchmark or an empty table of documents gives zero hits or
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from . import bloom
from .common import in_batches, unused, written

#: Bytes to bytes: A-Z in lower case; digits, letters and all of UTF-8's longer characters stay; anything else is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words in a shingle.
SHINGLE = 3
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` words, in their order."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = (total ^ h[k : len(h) - size + 1 + k]) * M1
        total = (total ^ (total >> np.uint64(32))) * M2
    return total.view(np.int64)


def windows_of(words: list[bytes], width: int) -> Iterator[list[bytes]]:
    for i in range(max(1, len(words) - width + 1) if words else 0):
        yield words[i : i + width]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def windows(texts: DataFrame, width: int) -> DataFrame:
    """A row for each distinct window of a text and each of its shingles: text_key, words, n, size (of the shingle), shingle, offset."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["text_key"], b["text"]):
                out = []
                for w in {tuple(x): x for x in windows_of(words_of(text), width)}.values():
                    size = min(SHINGLE, len(w))
                    out += [(key, b" ".join(w).decode("utf-8", "replace"), len(w), size, s, i) for i, s in enumerate(shingles(w, size).tolist())]
                yield pd.DataFrame(out, columns=["text_key", "words", "n", "size", "shingle", "offset"])

    return in_batches(texts, cut, "text_key string, words string, n int, size int, shingle long, offset int")


def wanted_shingles(found: DataFrame) -> tuple[list[int], Broadcast]:
    """The sizes of shingles that occur, and a Bloom filter of the shingles."""
    distinct = found.select(F.col("shingle").alias("h")).distinct()
    sizes = sorted(r["size"] for r in found.select("size").distinct().toLocalIterator())  # SHINGLE rows at most
    return sizes, bloom.made(distinct, distinct.count())


def among(found: np.ndarray, wanted: Broadcast) -> np.ndarray:
    """Places in found of what may be wanted."""
    return np.flatnonzero(bloom.has(wanted.value, found.view(np.uint64)))


def counts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """shingle and in how many documents it is, over all documents, for all of the benchmark's shingles and others that the filter lets through."""
    sizes, wanted = wanted_shingles(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [np.zeros(0, np.int64)]
            for text in b["text"]:
                words = words_of(text)
                for size in sizes:
                    s = shingles(words, size)
                    got.append(np.unique(s[among(s, wanted)]))
            names, n = np.unique(np.concatenate(got), return_counts=True)
            yield pd.DataFrame({"shingle": names, "n_docs": n})

    return in_batches(rows.select("text"), run, "shingle long, n_docs long").groupBy("shingle").agg(F.sum("n_docs").alias("n_docs"))


def occurrences(rows: DataFrame, prefixes: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words, and where prefixes are: shingle, its place, and the words around it from place `begin` on."""
    sizes, wanted = wanted_shingles(prefixes)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_words, at = [], []
            for text in b["text"]:
                words, found = words_of(text), []
                for size in sizes:
                    s = shingles(words, size)
                    for i in among(s, wanted).tolist():
                        begin = max(0, i + size - width)
                        found.append({"shingle": int(s[i]), "size": size, "place": i, "begin": begin, "around": b" ".join(words[begin : i + width]).decode("utf-8", "replace")})
                n_words.append(len(words))
                at.append(found)
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "n_words": n_words, "at": at})

    return in_batches(rows.select("doc_id", F.xxhash64("text").alias("mark"), "text"), run, f"doc_id {kind}, mark long, n_words long, at array<struct<shingle: long, size: int, place: int, begin: int, around: string>>")


def search(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, mark, n_words) and the windows in them (doc_id, mark, start, end, text_key), and so the two tables that the rest is made of."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = benchmark.select(F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct().select(F.sha2("text", 256).alias("text_key"), "text")
    found = written(windows(texts, width), "decontam-windows")
    ranked = found.join(counts(rows, found), "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "shingle", "offset", "size")).alias("rarest")
    prefixes = written(ranked.groupBy("text_key", "words", "n").agg(rarest).select("text_key", "words", "n", "rarest.shingle", "rarest.offset", "rarest.size"), "decontam-prefixes")
    all_docs = written(occurrences(rows, prefixes, width), "decontam-documents")
    places = written(all_docs.where(F.size("at") > 0).select("doc_id", "mark", "n_words", F.explode("at").alias("o")).select("doc_id", "mark", "n_words", "o.*"), "decontam-places")
    met = spread_join(places, prefixes, ["shingle", "size"]).withColumn("start", F.col("place") - F.col("offset"))
    inside = met.where((F.col("start") >= F.col("begin")) & (F.col("start") + F.col("n") <= F.col("n_words")))
    same = inside.where(F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("begin") + 1, F.col("n")), " ") == F.col("words"))
    return all_docs.select("doc_id", "mark", "n_words"), written(same.select("doc_id", "mark", "start", (F.col("start") + F.col("n")).alias("end"), "text_key").distinct(), "decontam-hits")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, spans (array of start and end in words), items (array of item ids)."""
    all_docs, hits = search(docs, benchmark, width, id_col, text_col, item_col, item_text_col)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    named = benchmark.select(F.col(item_col).alias("item_id"), F.sha2(item_text_col, 256).alias("text_key")).distinct()
    items = hits.select("doc_id", "mark", "text_key").distinct().join(named, "text_key").groupBy("doc_id", "mark").agg(F.collect_set("item_id").alias("items"))
    spans = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(spans=[[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in spans])] for spans in b["spans"]])

    spans = in_batches(spans, join, f"doc_id {kind}, mark long, spans array<struct<start: int, end: int>>")
    found = spans.join(items, F.struct(spans["doc_id"], spans["mark"]).eqNullSafe(F.struct(items["doc_id"], items["mark"]))).select(spans["doc_id"].alias("_id"), spans["mark"].alias("_mark"), "spans", "items")
    both = all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark")), "left")
    return both.select("doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("spans"), F.coalesce("items", F.expr(f"cast(array() as array<{item_kind}>)")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, less those that hold a window of an item."""
    key, mark = unused(docs, "_key", "_mark")
    _, hits = search(docs, benchmark, width, id_col, text_col, item_col, item_text_col)
    bad = hits.select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left_anti")
