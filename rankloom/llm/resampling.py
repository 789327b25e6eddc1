"""Importance resampling towards a target: hashed n-gram features, found by Aho-Corasick automata.

Words are runs of digits, letters and all beyond ASCII, A-Z in lower case; features are all runs of one to three words,
joined by a space; a feature's bucket is its CRC-32 modulo the number of buckets. A piece of text of a few MB is scanned by
an automaton over its distinct words, each with a space on both sides, whose payload is the word's CRC and length. Features
are never put together as text: the CRC of two texts in a row follows from the CRC of the first, that of the second and its
length (a CRC is linear, so the first is moved on by as many zero bytes), and so payloads that are next to each other give
the CRCs of all features. Bucket counts of documents and target give each bucket's gain; a second scan sums up gains per
document, and the greatest sums with Gumbel noise are drawn, which is drawing without replacement by weight.

What is sent to all tasks are the gains, one number a bucket. A dictionary holds the words of one piece only, so that it is
complete and bounded whatever the corpus. Longer texts are cut between words, with two words of the piece before in front.

Defined results: a null or empty text has no features, weight 0, and isn't drawn; repeated rows are each counted, scored and
ranked, in any order among themselves; a null id counts as the empty text in the noise and comes first among ties; an empty
target or an empty table of documents gives gains by its zero counts, or no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import running
from .common import in_arrow, written
from .decontam import FOLD

#: Bytes of text that an automaton is made for.
PIECE = 4 << 20
#: Bits of a payload that are the word's length.
LENGTH_BITS = 31
WORDS = 3


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What zero bytes make of each byte of a CRC: for 0 to 63 of them, and for 64 times each power of two."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # CRC is linear, up to a constant
    one = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    few = [one]
    for _ in range(64):
        few.append((few[-1] >> np.uint32(8)) ^ step[few[-1] & np.uint32(255)])
    many = [few.pop()]
    for _ in range(LENGTH_BITS - 6):
        many.append(_moved(many[-1], many[-1]))
    return np.stack(few), np.stack(many)


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


FEW, MANY = _tables()


def moved_on(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes: crc32(a + b) is moved_on(crc32(a), len(b)) ^ crc32(b)."""
    few = zeros & 63
    out = FEW[few, 0, crc & 255] ^ FEW[few, 1, (crc >> 8) & 255] ^ FEW[few, 2, (crc >> 16) & 255] ^ FEW[few, 3, crc >> 24]
    far = np.flatnonzero(zeros > 63)
    for k in range(LENGTH_BITS - 6 if len(far) else 0):
        at = far[(zeros[far] >> (6 + k)) & 1 == 1]
        out[at] = _moved(MANY[k], out[at])
    return out


def pieces(texts: Iterator[bytes | None]) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Pieces of about PIECE bytes: of which texts they have words, how many words at the front of each are known from the piece before, and the folded words, a line for each text."""
    of: list[int] = []
    known: list[int] = []
    lines: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        rest, again = (text or b"").translate(FOLD), b""
        while True:
            cut = rest.find(b" ", max(PIECE, len(again) + 1)) if len(rest) > PIECE else -1
            of.append(i)
            known.append(len(again.split()))
            lines.append(rest if cut < 0 else rest[:cut])
            held += len(lines[-1])
            if cut >= 0 or held >= PIECE:
                yield of, known, b" " + b" \n ".join(lines) + b" "
                of, known, lines, held = [], [], [], 0
            if cut < 0:
                break
            again = b" ".join(rest[:cut].rsplit(None, WORDS - 1)[-(WORDS - 1) :])
            rest = again + rest[cut:]
    if of:
        yield of, known, b" " + b" \n ".join(lines) + b" "


def scanned(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC, length and line of each word, as an automaton over the distinct words emits them."""
    found = ahocorasick.Automaton()
    found.add_word("\n", 0)
    for w in set(words.split()):
        found.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) << LENGTH_BITS | len(w))
    found.make_automaton()
    payload = np.fromiter(map(itemgetter(1), found.iter(words.decode("latin-1"))), np.int64)
    word = payload > 0  # no word has length 0
    line = np.cumsum(~word)[word]
    payload = payload[word]
    return (payload >> LENGTH_BITS).astype(np.uint32), payload & ((1 << LENGTH_BITS) - 1), line


def features(words: bytes, known: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line and bucket of each feature, and how many words each line has; features inside the known words at the front of a line are left out."""
    crc, length, line = scanned(words)
    count = np.bincount(line, minlength=len(known))
    place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    front = np.array(known, np.int64)
    new = place >= front[line]
    spaced = moved_on(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    lines, found, run = [line[new]], [crc[new]], crc
    for n in range(1, WORDS):
        longer = np.empty_like(run)
        longer[:n] = 0
        longer[n:] = moved_on(run[n - 1 : -1], length[n:] + 1) ^ spaced[n:]
        ok = new & (place >= n)
        lines.append(line[ok])
        found.append(longer[ok])
        run = longer
    return np.concatenate(lines), np.concatenate(found) % np.uint32(buckets), count - np.minimum(front, count)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket and n: how many features of all texts (a column text) are in it; empty buckets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, known, words in pieces(x.as_py() for x in b.column("text").view(pa.binary())):
                total += np.bincount(features(words, known, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return in_arrow(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln(share of the target's features / share of the documents')), counts plus one; docs and target have a column text."""
    both = bucket_counts(docs, buckets).withColumn("side", F.lit("s")).unionByName(bucket_counts(target, buckets).withColumn("side", F.lit("t")))
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    found = written(both.groupBy("bucket").agg(n("s").alias("s"), n("t").alias("t")), "resampling-buckets")
    total = found.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(found, "bucket", "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    d = lambda c, more: (F.col(c) + more).cast("double")
    gain = F.floor(1000 * F.ln(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    rows = every.select("bucket", gain.alias("gain")).toArrow()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for of, known, words in pieces(x.as_py() for x in b.column("text").view(pa.binary())):
                line, bucket, count = features(words, known, len(sent.value))
                np.add.at(n_words, of, count)
                np.add.at(n_features, of, np.bincount(line, minlength=len(of)))
                sums = np.zeros(len(of), np.int64)
                np.add.at(sums, line, sent.value[bucket])
                np.add.at(weight, of, sums)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256(`seed:doc_id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_features, weight, score, rank (from 1 for the floor(percent N / 100) highest scores of the N documents with `least_words` words or more, ties to the smaller id; else null)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(rows, target.select(F.col(target_text_col).alias("text")), buckets)
    scored = written(weighed(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resampling-scores")
    # copies of a row are counted, ordered by ranges as one, and take so many ranks
    copies = scored.where(F.col("n_words") >= least_words).groupBy(*scored.columns).agg(F.count("*").alias("copies"))
    placed = running(copies, [], [F.desc("score"), F.asc_nulls_first("doc_id")], F.col("copies"), "before")
    each = placed.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))))
    drawn = each.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("total") * percent / 100), F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*scored.columns, "rank").unionByName(others)


def drawn(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, less those that found didn't draw; of an id that several rows have, all stay if one is drawn."""
    ids = found.where(F.col("rank").isNotNull()).select(F.struct("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.struct(F.col(id_col)).eqNullSafe(F.col("_drawn")), "left_semi")
