"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring table. With one more shard, a key either
stays where it is or goes to the new shard, and about one in n + 1 keys goes.

Defined results: a null key is a key of its own; a null text has size `overhead` and the checksum of no bytes;
rows with the same key go to the same shard, each with its own slot; an empty table gives an empty result; columns
other than the two that are named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Slots are counted in so many chunks of a shard, so that no shard is ever ordered by a single task.
CHUNKS = 512


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys in step; about ln(shards) rounds."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            shard[going] = ahead[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            share = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[going] = ((shard[going] + 1).astype(np.float64) * share).astype(np.int64)
            going = going[ahead[going] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards))

    return of(key)


def stable_key(c: Column) -> Column:
    """64 well-mixed bits of the key's text: the same on every run, cluster and release."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("")))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots run from 0 without gaps in each shard: an offset of the row's chunk, counted before, plus the row's number in its chunk.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        stable_key(F.col(id_col)).alias("key"),
    ).select("doc_id", "size", "text_crc32", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("key", "text_crc32"), F.lit(CHUNKS)).cast("int").alias("chunk"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # copies of a row are counted and take so many slots, as all are in one chunk
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    # offsets has shards * CHUNKS rows at most, whatever the input's size
    placed = each.withColumn("at", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "chunk"])
    first = F.col("offset") + F.col("at")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id") -> None:
    """Writes docs, all columns, as one folder per shard; a shard's rows may lie in several files."""
    ship(docs.sparkSession)
    docs.withColumn("shard", jump_shard(stable_key(F.col(id_col)), shards)).write.partitionBy("shard").parquet(path)
