"""Rate limiting by key: a row is accepted if the last accepted one is long enough ago; refused rows don't move the clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def rate_limited(rows: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """key, t, ok of rows at rest, each key's sorted rows folded as a stream that carries only the last accepted time."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = last = None  # the key, as a tuple once there is one, and its last accepted time
        for b in batches:
            ok = []
            for k, t in zip(b["k"].array, b["t"].array):
                k = None if pd.isna(k) else k
                t = None if pd.isna(t) else int(t)
                if at != (k,):
                    at, last = (k,), None
                free = last is None or t is None or t - last >= gap
                last = t if free and t is not None else last
                ok.append(free)
            yield b.assign(ok=ok)

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select(F.col(key).alias("k"), F.col(time).cast("long").alias("t")).repartition("k").sortWithinPartitions("k", "t")
    return dealt.mapInPandas(fold, f"k {kind}, t long, ok boolean").select(F.col("k").alias(key), "t", "ok")


class Limiter(StatefulProcessor):
    """The same for a stream: the last accepted time per key, forgotten after forget_ms if given."""

    def __init__(self, key: str, time_ms: str, gap_ms: int, forget_ms: int | None = None) -> None:
        self.key, self.time_ms, self.gap_ms, self.forget_ms = key, time_ms, gap_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times = sorted(int(t) for b in rows for t in b[self.time_ms])
        out = []
        for t in times:
            ok = last is None or t - last >= self.gap_ms
            last = t if ok else last
            out.append((key[0], t, ok))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=[self.key, "t", "ok"])

    def close(self) -> None:
        pass


def limited_stream(stream: DataFrame, key: str, time_ms: str, gap_ms: int, forget_ms: int | None = 60_000) -> DataFrame:
    """A stream's rows with their flags; needs the RocksDB state store. State that is to be forgotten needs batches without rows, so a run that is to end when it has caught up takes forget_ms=None."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, time_ms).groupBy(key).transformWithStateInPandas(Limiter(key, time_ms, gap_ms, forget_ms), f"{key} {kind}, t long, ok boolean", "Append", "ProcessingTime" if forget_ms else "None")
