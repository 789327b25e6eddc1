"""Byte-level BPE by segment trees over adjacent pair ranks, for many pieces in step.

Each piece of a text (what the pre-tokeniser's pattern splits off) is a row of a batch. Its leaves hold, for each
position, the rank of the pair that begins there; the tree over them keeps the minimum, and since a leaf's value is
rank and position in one number, the root is the leftmost pair of lowest rank. A merge changes three leaves, and so
as many nodes on each level as it has to: a number of updates logarithmic in the piece's length. This goes on until
no pair in the piece can be merged. Pieces of like length share a batch, so numpy does one step for all of them.

Strings of added tokens in a text become their ids before the pattern is applied, as the tokeniser file says.

Defined results: a null text counts as empty and has no ids; long texts and long pieces need no special case, their
tree is only deeper; ids that aren't in the vocabulary decode to nothing; bytes that aren't UTF-8 decode to U+FFFD;
an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches

#: The pre-tokeniser's pattern of this file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space before white space or at the end; only then may white space of more than one character have a space in it.
LOOSE_SPACE = re.compile(r" (?!\S)")
#: No pair, or none that can be merged.
NO_PAIR = 1 << 62
NONE = np.int64(NO_PAIR)
#: Fewer pieces of a length than this are merged one by one.
FEW = 32
#: A worker keeps the ids of about so many stretches of text, twice, each of at most so many characters.
CACHED, SHORT = 400_000, 64
#: Pieces that are new to a worker are merged in batches of at most so many leaves.
LEAVES = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges, made from the JSON text of a tokeniser file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in byte_letters().items()}
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.size, order = size, np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.id_text = [str(i) for i in range(size)]
        self.split = regex.compile(PATTERN)
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # a stretch of text is one piece or a few that no other text around it changes
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.added.items()}
        self.old: dict[str, tuple[int, ...]] = {}
        self.long: dict[str, tuple[int, ...]] = {}  # of the texts at hand only
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.letters, self.merged_list = self.byte_ids.tolist(), self.merged.tolist()
        self.own = list(range(size))  # one object an id, however often it's kept

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pieces of like length, one segment tree each."""
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        wide = 1 << int(max(int(lengths.max()) - 1, 1)).bit_length()
        ids = np.zeros((n, wide + 1), np.int64)
        inside = np.arange(wide + 1) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, wide + 2), (n, 1))  # position of the next token; `length` and beyond: none
        before = after - 2
        alive = inside.copy()
        tree = np.full((n, 2 * wide), NONE, np.int64)
        pair = inside[:, 1:]
        first = np.full((n, wide), NONE, np.int64)
        first[pair] = self.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        tree[:, wide:] = np.where(first < NONE, first * wide + np.arange(wide), NONE)
        level = wide
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        going = np.flatnonzero(tree[:, 1] < NONE)
        while len(going):
            root = tree[going, 1]
            at, new = root % wide, self.merged[root // wide]
            gone = after[going, at]
            nxt = after[going, gone]
            ids[going, at] = new
            after[going, at] = nxt
            before[going, np.minimum(nxt, wide)] = at
            alive[going, gone] = False
            prev = before[going, at]
            end, some = nxt >= lengths[going], prev >= 0
            rank = np.where(end, NONE, self.ranks(new, ids[going, np.minimum(nxt, wide)]))
            self._set(tree, wide, going, at, rank)
            self._set(tree, wide, going, gone, np.full(len(going), NONE))
            with_prev, p = going[some], prev[some]
            self._set(tree, wide, with_prev, p, self.ranks(ids[with_prev, p], new[some]))
            going = going[tree[going, 1] < NONE]
        counts = alive.sum(axis=1)
        flat, ends = list(map(self.own.__getitem__, ids[alive].tolist())), np.cumsum(counts).tolist()
        return [tuple(flat[e - c : e]) for e, c in zip(ends, counts.tolist())]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same for one piece, without numpy: for long pieces, and where there are few of a length."""
        ids, n = [self.letters[b] for b in piece], len(piece)
        wide = 1 << (n - 2).bit_length() if n > 2 else 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree, ranks, size = [NO_PAIR] * (2 * wide), self.rank_of, self.size
        for i in range(n - 1):
            if (rank := ranks.get(ids[i] * size + ids[i + 1])) is not None:
                tree[wide + i] = rank * wide + i
        for node in range(wide - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            at += wide
            tree[at] = value
            while at > 1:
                at >>= 1
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    break
                tree[at] = least

        while n > 1 and tree[1] != NO_PAIR:
            rank, at = divmod(tree[1], wide)
            gone = after[at]
            ids[at], ids[gone] = self.merged_list[rank], -1
            nxt = after[at] = after[gone]
            if nxt < n:
                before[nxt] = at
            if gone < wide:
                put(gone, NO_PAIR)
            rank = ranks.get(ids[at] * size + ids[nxt]) if nxt < n else None
            put(at, NO_PAIR if rank is None else rank * wide + at)
            if (prev := before[at]) >= 0:
                rank = ranks.get(ids[prev] * size + ids[at])
                put(prev, NO_PAIR if rank is None else rank * wide + prev)
        return tuple(self.own[i] for i in ids if i >= 0)

    @staticmethod
    def _set(tree: np.ndarray, wide: int, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """Point update: a leaf, then its ancestors."""
        tree_at = at + wide
        inside = at < wide
        rows, at, tree_at, rank = rows[inside], at[inside], tree_at[inside], rank[inside]
        tree[rows, tree_at] = np.where(rank < NONE, rank * wide + at, NONE)
        node = tree_at >> 1
        while len(node) and node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def learn(self, new: set[str]) -> None:
        """Adds the ids of new stretches of text to those known. What is known has two generations: a full one becomes the old one, and what is met again moves to the young one. Long stretches are known for as long as their text is at hand."""
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {t: (i,) for t, i in self.added.items()}
        if self.old:
            again = new & self.old.keys()
            self.known.update((p, self.old[p]) for p in again)
            new = new - again
        cut = {u: self.split.findall(u) for u in new}
        known = self.known
        fresh = {p for pieces in cut.values() for p in pieces if p not in known}
        by_width: dict[int, list[str]] = {}
        for p in fresh:
            by_width.setdefault((len(p.encode()) - 1).bit_length(), []).append(p)
        met: dict[str, tuple[int, ...]] = {}
        for bits, group in by_width.items():
            if len(group) < FEW or bits > 9:
                met.update((p, self.merge_one(p.encode())) for p in group)
                continue
            step = max(1, LEAVES >> (bits + 1))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                met.update(zip(some, self.merge([p.encode() for p in some])))
        of = lambda p: met[p] if p in met else known[p]
        met.update([(u, tuple(chain.from_iterable(map(of, pieces)))) for u, pieces in cut.items() if len(pieces) != 1])
        self.long = {p: ids for p, ids in met.items() if len(p) > SHORT}
        known.update((p, ids) for p, ids in met.items() if len(p) <= SHORT)

    def stretches(self, text: str) -> list[str]:
        """The text cut up where no piece can cross: before each space if what follows is never white space, else at every piece; added tokens are cut out first."""
        if self.find_added is not None and self.find_added.search(text):
            out, at = [], 0
            for m in self.find_added.finditer(text):
                out += [*self.split.findall(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.split.findall(text[at:])
        if "\0" in text or LOOSE_SPACE.search(text):
            return self.split.findall(text)
        cut = text.replace(" ", "\0 ").split("\0")
        return cut if cut[0] else cut[1:]  # nothing is before a space that the text begins with

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """ids of each text; texts are taken a few at a time, so that long ones don't add up."""
        group: list[tuple[list[str], list]] = []
        new: set[str] = set()
        held = 0
        for text in texts:
            pieces = self.stretches(text)
            got = list(map(self.known.get, pieces))
            if None in got:
                new.update(p for p, g in zip(pieces, got) if g is None)
            group.append((pieces, got))
            held += len(pieces)
            if held > 200_000:
                yield from self.finish(group, new)
                group, new, held = [], set(), 0
        yield from self.finish(group, new)

    def finish(self, group: list[tuple[list[str], list]], new: set[str]) -> Iterator[list[int]]:
        self.learn(new)
        for pieces, got in group:
            if None in got:
                got = [(self.known[p] if len(p) <= SHORT or p in self.known else self.long[p]) if g is None else g for p, g in zip(pieces, got)]
            yield list(chain.from_iterable(got))
        self.long = {}

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        try:
            return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(table[i] for i in ids if 0 <= i < self.size).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def of(path: str) -> Bpe:
    """The vocabulary at a path or URI, loaded once a worker."""
    if path not in _loaded:
        fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with fs.open_input_stream(at) as f:
            _loaded[path] = Bpe(f.read().decode())
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int); if asked for, also the text that the ids decode to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = of(path)
        for b in batches:
            for i in range(0, len(b), 64):
                some = b.iloc[i : i + 64]
                ids = list(bpe.encode_batch(some["text"].tolist()))
                made = pd.DataFrame({"doc_id": some["doc_id"], "ids": [np.array(x, np.int32) for x in ids]})
                yield made.assign(text=[bpe.decode(x) for x in ids]) if decoded else made

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), run, f"doc_id {kind}, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = of(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [bpe.decode([] if x is None else list(x)) for x in b["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = of(path)
        name = bpe.id_text.__getitem__
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_batch(b["text"].tolist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has the public vocabularies; executors need them at the same path or a URI instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
