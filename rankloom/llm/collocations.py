"""Phrases whose words come together more often than they come apart, counted by FM-indexes over word ids.

Texts are cut at marks into pieces and pieces into words, A-Z in lower case; phrases don't go over the end of a piece. A
shard is the words of a few MB of text of one language, as ids. Its index has the suffixes in order of their first few ids
(no phrase is longer, so the rest of a suffix doesn't matter), the id before each, and where each id's places are among
those; the reversed words have one as well. A phrase is an interval in both. It is extended to the left by what stands
before the suffixes of its interval, to the right by the same in the other index, and each extension tells the counts and
keeps both intervals in step. All intervals of a length are extended at once. Counts are summed over shards.

All that counts is on phrases with `least` occurrences or more, and these have only such parts. So there are three scans:
words are counted first; pairs of frequent words next; longer phrases last, inside runs of frequent pairs. What is frequent
goes from one scan to the next as a Bloom filter of bounded size. A filter lets through some rare ones besides, which are
dropped once they are counted; it never hides a frequent one, so counts are whole.

Defined results: a null text is empty; a null language is `und`, together with those that are called that; repeated rows
count each; a text without words counts for nothing; an empty table gives no rows; other columns are ignored. Tasks
get lines, so a text may be as long as it likes; a single line is one shard however long it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import running
from . import bloom
from .common import in_arrow, in_batches, matched, written
from .jaccard import mixed

#: Bytes to bytes: A-Z in lower case, marks that end a piece to line feeds, tabs to spaces.
MARKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in MARKS else 32 if b == 9 else b for b in range(256))
#: Bytes of lines in a shard, and how many are held at most while languages wait for theirs to be full.
SHARD, HELD = 1 << 20, 4 << 20
LONGEST = 4
#: Rows that are handed on at once.
AT_ONCE = 1 << 16


def ordered(x: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0; those of 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


class Index:
    """One direction of an index of ids up to phrases of `depth` ids: 0 ends a piece."""

    def __init__(self, ids: np.ndarray, depth: int, sigma: int) -> None:
        n = len(ids)
        self.sigma = np.int64(sigma)
        rank, known = ids.astype(np.int64), 1
        while known < depth:  # ranks by the next `known` ids, from two of half as many
            after = np.zeros(n, np.int64)
            after[: n - known] = rank[known:]
            _, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
            known *= 2
        order = ordered(rank)
        self.before = ids[order - 1].astype(np.int64)  # of the first place it is the last id, a 0
        by_id = ordered(self.before)
        self.places = self.before[by_id] * np.int64(n) + by_id
        self.n = np.int64(n)
        self.first = np.zeros(sigma + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(ids, minlength=sigma))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the rows above this one."""
        return np.searchsorted(self.places, symbol * self.n + row) - self.first[symbol]

    def extended(self, low: np.ndarray, size: np.ndarray, other: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals, with their beginnings in the other direction, extended by each id before them: which interval it was, the id, and the new low (not if these are the last), size and other."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        key, count = np.unique(owner * self.sigma + self.before[rows], return_counts=True)
        of, symbol = key // self.sigma, key % self.sigma
        upto = np.cumsum(count) - count  # the other direction has its rows in order of this id
        start = np.searchsorted(of, np.arange(len(low)))
        shift = upto - upto[np.minimum(start, len(upto) - 1)][of] if len(of) else upto
        real = symbol > 0
        of, symbol, count, shift = of[real], symbol[real], count[real], shift[real]
        return of, symbol, low[of] if last else self.first[symbol] + self.rank(symbol, low[of]), count, other[of] + shift


class Phrases:
    """The phrases of a shard, from words on, extended to either side in turn: words (a row of ids for each), size, and the interval in each direction."""

    def __init__(self, ids: np.ndarray, sigma: int, longest: int) -> None:
        self.longest = longest
        self.forth = Index(ids, longest - 1, sigma)
        self.back = Index(np.concatenate([ids[-2::-1], ids[-1:]]), longest - 1, sigma) if longest > 2 else None
        present = 1 + np.flatnonzero(np.diff(self.forth.first[1:]))
        self.words = present[:, None]
        self.low = self.other = self.forth.first[present]
        self.size = self.forth.first[present + 1] - self.low

    def extend(self, left: bool) -> None:
        last = self.words.shape[1] + 1 == self.longest
        if left:
            of, symbol, self.low, self.size, self.other = self.forth.extended(self.low, self.size, self.other, last)
        else:
            of, symbol, self.other, self.size, self.low = self.back.extended(self.other, self.size, self.low, last)
        before = self.words[of]
        self.words = np.column_stack([symbol, before] if left else [before, symbol])


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) ^ b)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """A language, its distinct words, and ids (from 1, 0 at the end of each piece) for about SHARD bytes of its lines."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        coded, lines = b.column("lang").dictionary_encode(), b.column("line").view(pa.binary())
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = lines.filter(pc.equal(coded.indices, k))
            folded = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), b"\n")[0].as_py().translate(FOLD)
            held.setdefault(lang, []).append(folded)
            size[lang] = size.get(lang, 0) + len(folded)
            while size and (max(size.values()) >= SHARD or sum(size.values()) >= HELD):
                full = max(size, key=size.get)
                size.pop(full)
                yield (full, *_ids(held.pop(full)))
                pa.default_memory_pool().release_unused()
    for lang in list(held):
        yield (lang, *_ids(held.pop(lang)))


def _ids(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    joined = b"\n".join(texts).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([joined], pa.binary()), b" ").values
    coded = tokens.filter(pc.not_equal(tokens, pa.scalar(b"", pa.binary()))).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    end = pc.index(words, pa.scalar(b"\n", pa.binary())).as_py()
    if end >= 0:
        ids[ids == end + 1] = 0
    return words, np.concatenate([ids, [0]])


def counted_rows(lang: str, phrases: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    # bytes that Spark gave as text are given back as text, whatever they are
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.view(pa.string()), pa.array(count)], names=["lang", "phrase", "f"])


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, phrase and f for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids in shards(batches):
            count = np.bincount(ids, minlength=len(words) + 1)[1:]
            yield counted_rows(lang, words.filter(pa.array(count > 0)), count[count > 0])

    return _summed(in_arrow(rows, run, "lang string, phrase string, f long"))


def pair_counts(rows: DataFrame, words: Broadcast) -> DataFrame:
    """lang, phrase and f for each pair of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in shards(batches):
            frequent = np.concatenate([[False], bloom.has(words.value, word_hashes(names.to_pylist(), lang))])
            yield from _phrases(lang, names, np.where(frequent[ids], ids, 0), 2)

    return _summed(in_arrow(rows, run, "lang string, phrase string, f long"))


def longer_counts(rows: DataFrame, pairs: Broadcast) -> DataFrame:
    """lang, phrase and f for phrases of three to LONGEST words in which all pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in shards(batches):
            h = np.concatenate([np.zeros(1, np.uint64), word_hashes(names.to_pylist(), lang)])[ids]
            joined = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(joined)
            joined[at] = bloom.has(pairs.value, pair_hashes(h[at], h[at + 1]))
            yield from _phrases(lang, names, _runs(ids, joined), LONGEST)

    return _summed(in_arrow(rows, run, "lang string, phrase string, f long"))


def _runs(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The ids of words that have a joined neighbour, with a 0 wherever two in a row aren't joined."""
    after = np.concatenate([joined, [False]])
    inside = after | np.concatenate([[False], joined])
    at = np.flatnonzero(inside)
    last = ~after[at]
    out = np.zeros(len(at) + last.sum(), np.int64)
    out[np.arange(len(at)) + np.cumsum(last) - last] = ids[at]
    return np.concatenate([out, [0]])


def _phrases(lang: str, names: pa.Array, ids: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """Two words, where that is the longest; else three and four."""
    used, ids = np.unique(ids, return_inverse=True)  # 0 is always there
    names = names.take(pa.array(used[1:] - 1))
    found = Phrases(ids, len(used), longest)
    for n in range(2, longest + 1):
        found.extend(left=n % 2 == 0)
        if n > 2 or longest == 2:
            for i in range(0, len(found.size), AT_ONCE):
                parts = [names.take(pa.array(found.words[i : i + AT_ONCE, k] - 1)) for k in range(n)]
                yield counted_rows(lang, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), found.size[i : i + AT_ONCE])


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def filter_of(frequent: DataFrame, words: int) -> Broadcast:
    """A Bloom filter of the phrases (lang, phrase), all of one or of two words."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in b.groupby("lang"):
                split = [p.encode("utf-8", "surrogatepass").split(b" ") for p in rows["phrase"]]
                parts = [word_hashes([s[k] for s in split], lang) for k in range(words)]
                yield pd.DataFrame({"h": (parts[0] if words == 1 else pair_hashes(*parts)).view(np.int64)})

    return bloom.made(in_batches(frequent.select("lang", "phrase"), hashes, "h long"), frequent.count())


def frequent_phrases(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all phrases of one to LONGEST words with `least` occurrences or more, and lang, n: all word occurrences."""
    # a line feed ends a piece, so lines are as good as texts, and a batch of them is small however long texts are
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line"))
    often = F.col("f") >= least
    totals = written(word_counts(rows).withColumn("frequent", often).groupBy("lang", "frequent", F.when(often, F.col("phrase")).alias("phrase")).agg(F.sum("f").alias("f")), "collocation-words")
    words = totals.where("frequent").select("lang", "phrase", "f")
    pairs = written(pair_counts(rows, filter_of(words, 1)).where(often), "collocation-pairs")
    longer = written(longer_counts(rows, filter_of(pairs, 2)).where(often), "collocation-longer")
    return words.unionByName(pairs).unionByName(longer), totals.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, covered: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a (occurrences), l and r (of its two parts), n (all words of the language), score (floor of 2,000,000 a / (l + r) at the cut where that is lowest).

    Phrases that a longer one with `covered` percent of their occurrences contains are left out. A longer one that is two or more
    words longer contains one that is one word longer, which has no fewer occurrences; so phrases one word longer decide.
    """
    counts, totals = frequent_phrases(docs, least, text_col, lang_col)
    n_words = F.size(F.split("phrase", " "))
    candidates = written(counts.where(n_words > 1), "collocation-candidates")
    # each cut's two parts, with their counts
    upto = lambda k: F.substring_index("phrase", " ", k)
    part = lambda k, side, text: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), text.alias("part"))
    rest = lambda k: F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)")
    cuts = F.array(*(x for k in range(1, LONGEST) for x in (part(k, "l", upto(k)), part(k, "r", rest(k)))))
    parts = candidates.select("lang", "phrase", F.col("f").alias("a"), n_words.alias("words"), F.explode(cuts).alias("c")).where("c.k < words")
    parts = parts.select("lang", "phrase", "a", "c.k", "c.side", F.struct("lang", "c.part").alias("key"))
    # a part may be in very many phrases
    uses = parts.groupBy("key").agg(F.count("*").alias("uses"))
    known = counts.select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), "f").join(uses, "key")
    found = matched(parts, known, "key", "uses", parts.count()).select("lang", "phrase", "a", "k", "side", F.col("of.f").alias("f"))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = found.groupBy("lang", "phrase", "a").agg(*(of(k, side) for k in range(1, LONGEST) for side in "lr"))
    score = lambda k: F.expr(f"cast(a as decimal(20)) * 2000000 div (cast(l{k} as decimal(20)) + r{k})")
    scored = F.array_min(F.filter(F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, LONGEST))), lambda s: s["score"].isNotNull()))
    best = wide.select("lang", "phrase", "a", scored.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    kept = best.join(_covered(candidates, covered), ["lang", "phrase"], "left_anti")
    place = running(kept, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], F.lit(1), "before").where(F.col("before") < top)
    return place.join(totals, "lang").select("lang", (F.col("before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _covered(candidates: DataFrame, percent: int) -> DataFrame:
    """lang and phrase of candidates with a candidate one word longer around them that has percent of their occurrences."""
    first = F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
    last = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    longer = candidates.where(F.size(F.split("phrase", " ")) > 2).select("lang", F.explode(F.array(first, last)).alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return candidates.join(most, ["lang", "phrase"]).where(F.col("most") * F.lit(100).cast("decimal(5)") >= F.col("f") * F.lit(percent).cast("decimal(5)")).select("lang", "phrase")
