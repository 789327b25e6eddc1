"""Streams with state by key: actions folded to a query and its URL, bursts of values of which the last counts.

Both keep a burst's last time and give it out once nothing has come for `gap_us`: as soon as a later row of the key shows
it, or when the watermark passes. Rows of a batch are taken in order of time and tie; a row that is earlier than the burst's
last one belongs to the burst. State is one row a key, so a key with very many rows costs no more memory than any other.
They need the RocksDB state store.
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import spec
from ..sources.stages import fresh, kept

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bursts(StatefulProcessor):
    """key, n (rows of the burst), at (its last time in microseconds) and value, the last of each burst."""

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, n long, timer long, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, n, timer, value = self.open.get() if self.open.exists() else (None, 0, None, None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        out, held = [], self.opened(value)
        for r in self.ordered(rows):
            if at is not None and r.t - at >= self.gap_us:
                out.append((key[0], n, at, held))
                n = 0
            at, n, held = r.t if at is None else max(at, r.t), n + 1, self.folded(held if n or self.lasting else None, r)
        timer = -(-(at + self.gap_us) // 1000)
        self.handle.registerTimer(timer)
        self.open.update((at, n, timer, self.closed(held)))
        if out:
            yield self.frame(out)

    def ordered(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """A key's rows by time and tie, as tuples: most keys have few, for which frames of their own would cost more than all else."""
        found = []
        for part in rows:
            row = namedtuple("Row", part.columns)
            found += map(row._make, zip(*(part[c].tolist() for c in part.columns)))
        return sorted(found, key=lambda r: (r.t, none := r.tie is None or r.tie != r.tie, 0 if none else r.tie))  # those without a tie last

    def opened(self, value: str | None):
        """What rows are folded into, of a state's text."""
        return value

    def closed(self, held) -> str | None:
        return held

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, n, timer, value = self.open.get()
        if self.lasting:
            self.open.update((None, 0, None, value))
        else:
            self.open.clear()
        yield self.frame([(key[0], n, at, self.opened(value))])

    #: Whether a burst begins with the value that the one before left.
    lasting = False

    def folded(self, value, row):
        return row.value

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "n", "at", "value"])

    def close(self) -> None:
        pass


class QueryStates(Bursts):
    """The same for actions: the value is the query that all of a key's actions so far lead to, given out as its URL."""

    lasting = True

    def __init__(self, gap_us: int, base: str) -> None:
        super().__init__(gap_us)
        self.base = base

    def folded(self, value: spec.QuerySpec | None, row) -> spec.QuerySpec:
        return spec.reduced(value or spec.QuerySpec(), row.action, row.name, row.value)

    def opened(self, value: str | None) -> spec.QuerySpec | None:
        return spec.loaded(value) if value else None

    def closed(self, held: spec.QuerySpec | None) -> str | None:
        return spec.dumped(held) if held else None

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return super().frame([(k, n, at, spec.share_url(self.base, v)) for k, n, at, v in out])


def _stream(rows: DataFrame, key: str, time: str, tie: str, more: list, processor: StatefulProcessor, delay: str) -> DataFrame:
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # as text, so that null is a key like others
    for module in (spec, sys.modules[__name__]):  # the executors, and the driver's worker that sets state up, get the code with the query
        cloudpickle.register_pickle_by_value(module)
    timed = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).select(time, named.alias("key"), F.unix_micros(time).alias("t"), F.col(tie).alias("tie"), *more)
    out = timed.groupBy("key").transformWithStateInPandas(processor, "key string, n long, at long, value string", "Append", "EventTime")
    return out.withColumn("key", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.schema[key].dataType))


def bursts(rows: DataFrame, key: str, time: str, tie: str, value: str, gap_us: int, delay: str = "0 seconds") -> DataFrame:
    """A stream's bursts, as Bursts gives them out."""
    return _stream(rows, key, time, tie, [F.col(value).cast("string").alias("value")], Bursts(gap_us), delay)


def query_urls(rows: DataFrame, key: str, time: str, tie: str, gap_us: int = 300_000, base: str = "/", delay: str = "0 seconds") -> DataFrame:
    """A stream of actions (columns action, name, value) to the URL of each key's query, whenever the key has been quiet for the gap."""
    more = [F.col(c).cast("string").alias(c) for c in ("action", "name", "value")]
    return _stream(rows, key, time, tie, more, QueryStates(gap_us, base), delay)


def replayed(rows: DataFrame, time: str, made, parts: int = 2) -> DataFrame:
    """What a stream makes of rows at rest: they come in order of time in so many runs, each of which goes on from the state that the last one left, and end with a row in the year 2261, without a key, so that nothing stays open."""
    spark = rows.sparkSession
    at, table = fresh(spark, "replay"), kept(rows, "replay-rows")
    low, high = table.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    own = spark.newSession()  # the caller's settings stay as they are
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    end = own.range(1).select(*(F.timestamp_micros(F.lit(9_183_110_400_000_000)).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))
    table.limit(0).write.parquet(f"{at}/in")
    stream = made(own.readStream.schema(table.schema).parquet(f"{at}/in"))
    for i in range(parts):
        cut = [low + (high - low) * k // parts for k in (i, i + 1)] if low is not None else [0, 0]
        inside = (F.unix_micros(time) >= cut[0]) & ((F.unix_micros(time) < cut[1]) | (F.lit(i) == parts - 1))
        table.where(inside).write.mode("append").parquet(f"{at}/in")
        if i == parts - 1:
            end.write.mode("append").parquet(f"{at}/in")
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
