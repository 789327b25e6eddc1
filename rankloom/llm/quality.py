"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing (Kanerva et al. 2000; Sahlgren 2005): every word has a fixed sparse ternary index vector, drawn from
its hash; a word's own vector is the sum of the index vectors of the words around it, over all documents. Words are
hashed to a fixed number of rows, so that the vectors have the same size whatever the corpus. Beside each word stands
its shape (runs of capitals, small letters and digits, other characters as they are), and a mark where a word repeats
one of the last few; shapes and marks have vectors as words have.

A document is pooled to the mean and the spread of its words' vectors. A network with one hidden layer is fitted in
numpy on at most `max_rows` labelled rows, chosen by hash; its logits are divided by a temperature that is fitted on
rows that the network hasn't seen. Labels are only learned from where held_out is false.

Defined results: a null text counts as empty; empty texts have the zero vector and a score like any other; unlabelled
rows and null labels are not learned from; a document with two different labels counts once with each, and of rows that share an
id one counts; with no labels, or only one
kind, every score is the share of ones (0.5 without any); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches, ship

ROWS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: A worker keeps the codes of so many words of at most so many characters.
CACHED, SHORT = 400_000, 64
#: Bytes to the letters of a shape.
SHAPE = bytes(0x41 if 65 <= b <= 90 else 0x30 if 48 <= b <= 57 else 0x61 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)
#: Rows of the table that are kept for what isn't a word.
BREAK, REPEAT = ROWS, ROWS - 1


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places and signs of its index vector's entries that aren't 0; the break's signs are 0."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((ROWS + 1, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice(np.array([-1, 1]), (ROWS + 1, NONZERO))
    sign[BREAK] = 0
    return at, sign


class Codes(dict):
    """Word to row of the word times 2**20, plus row of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        shape = RUNS.sub(rb"\1", raw.translate(SHAPE))
        code = (zlib.crc32(raw.lower()) % REPEAT) << 20 | zlib.crc32(b"\0" + shape) % REPEAT
        if len(word) <= SHORT:
            self[word] = code
        return code


def rows_of(text: str | None, codes: Codes) -> np.ndarray:
    """A text as rows of the table: each word, its shape, and a mark after a word that is one of the four before it."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    word = code >> 20
    out = np.full((len(words), 3), BREAK, np.int64)
    out[:, 0], out[:, 1] = word, code & 0xFFFFF
    again = np.zeros(len(words), bool)
    for k in range(1, 5):
        again[k:] |= word[k:] == word[:-k]
    out[again, 2] = REPEAT
    out = out.ravel()
    return out[out != BREAK]


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors as sums over all documents: ROWS x DIM integers, added up by Spark."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sign = index_vectors()
        codes, total = Codes(), np.zeros((ROWS + 1) * DIM)
        gap = np.full(REACH, BREAK, np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for i in range(0, len(texts), 200):
                stream = np.concatenate([x for t in texts[i : i + 200] for x in (rows_of(t, codes), gap)])
                for k in range(1, REACH + 1):
                    for own, other in ((stream[:-k], stream[k:]), (stream[k:], stream[:-k])):
                        for j in range(NONZERO):
                            total += np.bincount(own * DIM + at[other, j], sign[other, j], len(total))
        sums = total.reshape(-1, DIM)[:ROWS].astype(np.int64)
        some = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame(sums[some], columns=names).assign(at=some)

    parts = in_batches(docs.select(F.col(text_col).alias("text")), run, ", ".join(f"{n} long" for n in names) + ", at int")
    vectors = np.zeros((ROWS, DIM))
    for r in parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toLocalIterator():  # ROWS rows at most
        vectors[r["at"]] = r[1:]
    return vectors


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors less their mean direction, of length 1."""
    v = context_sums(docs, text_col)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    used = v.any(axis=1)
    if used.any():
        v[used] -= v[used].mean(axis=0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, codes: Codes) -> np.ndarray:
    """Mean and spread of the vectors of each text's words, its length, and how much of it is repeats."""
    out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
    for i, text in enumerate(texts):
        rows = rows_of(text, codes)
        if len(rows):
            sums, squares = np.zeros(DIM), np.zeros(DIM)
            for k in range(0, len(rows), 1 << 16):
                v = vectors[rows[k : k + (1 << 16)]]
                sums += v.sum(axis=0)
                squares += np.einsum("ij,ij->j", v, v)
            mean = sums / len(rows)
            out[i, :DIM] = mean
            out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(squares / len(rows) - mean**2, 0))
            out[i, 2 * DIM :] = np.log1p(len(rows)), np.mean(rows == REPEAT)
    return out


class Network:
    """Two layers: tanh, then a logit; Adam on the log loss with weight decay. Scores are sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> None:
        self.share = float(np.mean(y)) if len(y) else 0.5
        self.temperature, self.w1 = 1.0, None
        if len(np.unique(y)) < 2 or len(y) < 20:
            return
        rng = np.random.default_rng(seed)
        own = rng.random(len(y)) < 0.8
        if len(np.unique(y[own])) < 2 or own.all():
            own[:] = True
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(self.share / (1 - self.share)))]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        mine = np.flatnonzero(own)
        for epoch in range(epochs):
            for i in np.array_split(rng.permutation(mine), max(1, len(mine) // batch)):
                h = np.tanh(z[i] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[i]) / len(i)
                dh = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[i].T @ dh + decay * w[0], dh.sum(axis=0), h.T @ d + decay * w[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = w
        rest = z[~own] if not own.all() else z
        logits, truth = self._logit(rest), y[~own] if not own.all() else y
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most max_rows rows to learn from, the first ones by a hash of the id: id, text, label. Of rows that share an id, one text is taken, by its hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).distinct().orderBy(F.xxhash64("_id"), "_id", "label").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_own"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, F.col("_own") == F.col("_id"))
    return rows.groupBy("_id", "label").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("_id", "text", "label")


class Model:
    """Word vectors over all of docs, and a network on the labelled rows among them."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.id_col, self.text_col = id_col, text_col
        sc = docs.sparkSession.sparkContext
        self.vectors = sc.broadcast(word_vectors(docs, text_col))

        def run(batches: Iterator[pd.DataFrame], vectors=self.vectors) -> Iterator[pd.DataFrame]:
            codes = Codes()
            for b in batches:
                yield pd.DataFrame({"id": b["_id"], "label": b["label"], "x": list(pooled(b["text"].tolist(), vectors.value, codes))})

        kind = labels.schema[id_col].dataType.simpleString()
        rows = sorted((r["id"], r["label"], r["x"]) for r in in_batches(labelled(docs, labels, label_col, max_rows, id_col, text_col), run, f"id {kind}, label double, x array<float>").collect())  # max_rows at most
        self.network = sc.broadcast(Network(np.array([x for *_, x in rows], np.float64).reshape(len(rows), 2 * DIM + 2), np.array([y for _, y, _ in rows])))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        vectors, network = self.vectors, self.network

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes = Codes()
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": network.value.score(pooled(b["text"].tolist(), vectors.value, codes))})

        kind = docs.schema[self.id_col].dataType.simpleString()
        return in_batches(docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text")), run, f"doc_id {kind}, score double")

    def accepted(self, docs: DataFrame, least: float = 0.3) -> DataFrame:
        """The rows of docs, all columns, that score at least `least`."""
        vectors, network, text_col = self.vectors, self.network, self.text_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = Codes()
            for b in batches:
                yield b.filter(pa.array(network.value.score(pooled(b.column(text_col).to_pylist(), vectors.value, codes)) >= least))

        ship(docs.sparkSession)
        return docs.mapInArrow(run, docs.schema)
