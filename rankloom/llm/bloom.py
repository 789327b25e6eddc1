"""Bloom filters of bounded size: made by tasks in parts, put together by bits, sent to all tasks.

A filter never denies what is in it; what it lets through besides is for an exact step after it to find out. It has
BITS_EACH bits for each of the expected hashes, up to 2 ** MOST bits, 32 MB: with more hashes it lets more through, and
all in the end, but nothing changes in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

PROBES, BITS_EACH, LEAST, MOST = 4, 16, 12, 28
U = np.uint64


def places(h: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    """The PROBES bits of each 64-bit hash, by double hashing."""
    step = (h >> U(32)) | U(1)
    for k in range(PROBES):
        yield (h + U(k) * step) & U((1 << log2) - 1)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    log2 = len(bits).bit_length() + 5
    out = np.ones(len(h), bool)
    for at in places(h, log2):
        out &= (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
    return out


def made(hashes: DataFrame, expected: int) -> Broadcast:
    """The filter of the hashes, a column h of longs: an array of words of 64 bits."""
    log2 = min(MOST, max(LEAST, (expected * BITS_EACH).bit_length()))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate(list(places(b["h"].to_numpy(np.int64).view(np.uint64), log2)))
            word, inverse = np.unique(at >> U(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, U(1) << (at & U(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

    found = in_batches(hashes.select("h"), partial, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** (MOST - 6) rows at most
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)
