"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon's terms, how near they stand to words of the second person, and rates of
capitals, punctuation and obfuscation (letters replaced by digits and signs). The lexicon is learned: words and the
beginnings of words that toxic rows of one part of the labelled rows have far more often than the others. A second
part grows the trees, a third fits the isotonic map from their sum to a probability, so no step is fitted on what
the one before has already seen. All three parts together hold at most `max_rows` rows, chosen by hash.

Defined results: a null text counts as empty; an empty text has the features zero and a score like any other;
unlabelled rows and null labels are not learned from; a document with two different labels counts once with each, and of rows
that share an id one counts; with no
labels, or only one kind, every score is the share of ones (0.5 without any); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .quality import labelled

#: Words of the second person in the four languages of the table.
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo vuestro".split())
#: Letters that digits and signs stand for.
PLAIN = str.maketrans("013457@$!|+", "oieastasilt")
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_/|~`…«»“”„’"
MIXED = re.compile(r"(?=.*[^\W\d_])[^\W\d_]*[\d@$!*.+|_-]+[^\W\d_]+")
LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS, NEAR = (4, 5, 6), 6
#: A worker keeps the details of so many words of at most so many characters.
CACHED, SHORT = 400_000, 64
#: Classes of bytes for the rates: capitals, small letters and other characters of words, digits, ! and ?, other signs, blanks.
KINDS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if b >= 128 else 3 if 48 <= b <= 57 else 4 if b in b"!?" else 6 if b in b" \t\n\r\x0b\x0c" else 5 for b in range(256)], np.uint8)
FEATURES = ("words", "lexicon_density", "lexicon_hits", "lexicon_max", "lexicon_mean", "hidden_density", "hidden_hits", "you_density", "you_near", "near_share", "capitals", "shouted", "exclaimed", "signs", "digits", "blanks", "beyond_ascii", "obfuscated", "word_length")


def terms_of(word: str) -> list[str]:
    """A word in small letters and, marked by *, its beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


class Words(dict):
    """Word to a row of details: weight in the lexicon, weight only after signs are read as letters, second person, obfuscated."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.details, self.rows = lexicon, [(0.0, 0.0, False, False)], {}

    def weight(self, word: str) -> float:
        return max((self.lexicon[t] for t in terms_of(word) if t in self.lexicon), default=0.0)

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        word = raw.strip(EDGES).lower()
        mixed = bool(MIXED.fullmatch(word)) and "@" not in word[1:-1] and len(word) < 30
        weight = self.weight(word) if word else 0.0
        hidden = 0.0
        if not weight and mixed:
            hidden = max(self.weight(word.translate(PLAIN)), self.weight("".join(LETTERS.findall(word))))
        found = (weight, hidden, word in SECOND_PERSON, mixed)
        at = self.rows.setdefault(found, len(self.rows) + 1) if any(found) else 0
        if at == len(self.details):
            self.details.append(found)
        if len(raw) <= SHORT:
            self[raw] = at
        return at


def features(text: str | None, words: Words) -> list[float]:
    """The row of FEATURES of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    rate = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    tokens = text.split()
    n = max(1, len(tokens))
    codes = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    marked = np.flatnonzero(codes)
    rows = [words.details[c] for c in codes[marked]]
    weight = np.array([max(r[0], r[1]) for r in rows])
    hits, you = marked[weight > 0] if len(rows) else marked, marked[[r[2] for r in rows]] if len(rows) else marked
    near = gap = 0.0
    if len(hits) and len(you):
        after = np.searchsorted(you, hits)
        gaps = np.minimum(np.abs(hits - you[np.minimum(after, len(you) - 1)]), np.abs(hits - you[np.maximum(after - 1, 0)]))
        near, gap = float(np.mean(gaps <= NEAR)), 1.0 / float(gaps.min() + 1)
    hidden = sum(r[1] > 0 for r in rows)
    total = float(weight.sum())
    return [
        float(np.log1p(len(tokens))), total / n, float(np.log1p(len(hits))), float(weight.max(initial=0)), total / max(1, len(hits)),
        hidden / n, float(np.log1p(hidden)), len(you) / n, gap, near, float(rate[0]), float(rate[0] / max(rate[0] + rate[1], 1e-9) > 0.6),
        float(rate[4]), float(rate[5]), float(rate[3]), float(rate[6]), float(rate[2]), sum(r[3] for r in rows) / n, len(raw) / n,
    ]


class Trees:
    """Boosted regression trees on binned features, log loss, Newton leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0) -> None:
        self.depth, self.trees = depth, []
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        # where values of 0 prevail, the others have quantiles of their own
        cuts = [np.unique(np.concatenate([c, np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) - 1e-9])) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
        width = max(len(c) for c in cuts) + 1
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, split_at, split_cut = np.zeros(len(y), np.int64), [], []
            for level in range(depth):
                n = 1 << level
                best = np.full(n, -1.0)
                at, cut = np.zeros(n, np.int64), np.full(n, width)
                for j in range(x.shape[1]):
                    place = node * width + binned[:, j]
                    gs = np.bincount(place, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(place, h, n * width).reshape(n, width).cumsum(axis=1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[(hs < least * 0.1) | (hr < least * 0.1)] = -1
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(n), k] > best + 1e-9
                    best[better], at[better], cut[better] = gain[np.arange(n), k][better], j, k[better]
                split_at.append(at)
                split_cut.append(np.array([cuts[a][c] if c < len(cuts[a]) else np.inf for a, c in zip(at, cut)]))
                node = node * 2 + (binned[np.arange(len(y)), at[node]] > cut[node])
            leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            self.trees.append((split_at, split_cut, leaf))
            f += leaf[node]

    def sum(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for split_at, split_cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for at, cut in zip(split_at, split_cut):
                node = node * 2 + (x[rows, at[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the rising map from x to the mean of y; two rows of pseudo-counts keep it off 0 and 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, least x, greatest x
    for v, t in zip(x[order], y[order]):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], hi]
    level = [(s + 0.02) / (w + 0.04) for s, w, *_ in blocks]
    knots = [(v, p) for (_, _, lo, hi), p in zip(blocks, np.maximum.accumulate(level)) for v in ([lo, hi] if hi > lo else [lo])]
    return np.array([k for k, _ in knots]), np.array([p for _, p in knots])


class Model:
    """A lexicon, trees and a calibration from the labelled rows of docs."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 24_000, max_terms: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.id_col, self.text_col = id_col, text_col
        spark = docs.sparkSession
        part = F.pmod(F.xxhash64(F.lit(3), F.col("_id")), F.lit(10))  # 0-4 lexicon, 5-7 trees, 8-9 calibration
        rows = labelled(docs, labels, label_col, max_rows, id_col, text_col).select("text", "label", F.when(part < 5, 0).when(part < 8, 1).otherwise(2).alias("part"))
        rows = written(rows, "toxicity-rows")  # max_rows at most; read for the counts, the terms and the features
        self.lexicon = spark.sparkContext.broadcast(self.learn_lexicon(rows.where("part = 0"), max_terms))

        def run(batches: Iterator[pd.DataFrame], lexicon=self.lexicon) -> Iterator[pd.DataFrame]:
            words = Words(lexicon.value)
            for b in batches:
                yield pd.DataFrame({"part": b["part"], "label": b["label"], "x": [features(t, words) for t in b["text"]]})

        got = sorted((r["part"], r["label"], r["x"]) for r in in_batches(rows.where("part > 0"), run, "part int, label double, x array<double>").collect())  # max_rows at most
        part, y, x = np.array([p for p, *_ in got]), np.array([v for _, v, _ in got]), np.array([v for *_, v in got], np.float64).reshape(len(got), len(FEATURES))
        self.share = float(y.mean()) if len(y) else 0.5
        grow, fit = part == 1, part == 2
        self.trees = self.map = None
        if len(np.unique(y[grow])) == 2 and len(np.unique(y[fit])) == 2:
            self.trees = Trees(x[grow], y[grow])
            self.map = isotonic(self.trees.sum(x[fit]), y[fit])

    @staticmethod
    def learn_lexicon(rows: DataFrame, max_terms: int, least: int = 3) -> dict[str, float]:
        """Terms by the log of their odds in toxic rows against the others, 2 at least; the max_terms strongest."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                n: tuple[Counter, Counter] = (Counter(), Counter())
                for text, label in zip(b["text"], b["label"]):
                    n[int(label > 0)].update({t for w in set((text or "").split()) if (word := w.strip(EDGES).lower()) and len(word) < 40 for t in terms_of(word)})
                terms = list(n[0].keys() | n[1].keys())
                yield pd.DataFrame({"term": terms, "no": [n[0][t] for t in terms], "yes": [n[1][t] for t in terms]})

        both = {int(r["label"] > 0): r["count"] for r in rows.groupBy("label").count().collect()}
        if len(both) < 2:
            return {}
        odds = F.log((F.col("yes") + 0.1) / (both[1] + 0.2)) - F.log((F.col("no") + 0.1) / (both[0] + 0.2))
        terms = in_batches(rows.select("text", "label"), run, "term string, no long, yes long").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).where(F.col("yes") >= least)
        found = terms.withColumn("odds", odds).where("odds >= 2").orderBy(F.desc(F.col("odds") * F.log1p("yes")), "term").limit(max_terms)
        return {r["term"]: float(r["odds"]) for r in found.collect()}

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        lexicon, trees, knots, share = self.lexicon, self.trees, self.map, self.share

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words(lexicon.value)
            for b in batches:
                x = np.array([features(t, words) for t in b["text"]], np.float64).reshape(len(b), len(FEATURES))
                score = np.interp(trees.sum(x), *knots) if trees else np.full(len(b), share)
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": score})

        kind = docs.schema[self.id_col].dataType.simpleString()
        return in_batches(docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text")), run, f"doc_id {kind}, score double")
