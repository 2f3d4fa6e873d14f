"""Alarm state over ticks as they come: rate limit and automatic resolution by key, in state that expires.

Each gives the rows of its batch form (`operators.queues`) however the input is cut into micro-batches, as long as those come in order of time.
The state of a key is one number, and goes when it can matter no more or the key has been silent for long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """A number of each key, with a timer that ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value bigint, until bigint")

    def get(self) -> int | None:
        return self.held.get()[0] if self.held.exists() else None

    def put(self, value: int, until: int) -> None:
        self.held.update((value, until))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():  # no later row has put it off
            self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class RateLimit(_Keyed):
    """Keeps an alarm that comes at least `window` milliseconds after the last kept one of its key."""

    def __init__(self, window: int):
        self.window = window

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, kept = self.get(), []
        for t in sorted(t for part in rows for t in part["at"]):
            if last is None or t - last >= self.window:
                kept.append(t)
                last = t
        if kept:
            self.put(last, last + self.window)
            yield pd.DataFrame({"key": [key[0]] * len(kept), "at": kept})


class Resolve(_Keyed):
    """Gives the tick at which a key has been clean for `clean` ticks in a row since a violation. Only keys that wait for that hold state."""

    def __init__(self, clean: int, silence: int):
        self.clean, self.silence = clean, silence

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.get()
        count, ticks, last = before, [], 0
        for t, bad in sorted((t, bad) for part in rows for t, bad in zip(part["at"], part["bad"], strict=True)):
            last = t
            if bad:
                count = 0
            elif count is not None:
                count += 1
                if count == self.clean:
                    ticks.append(t)
                    count = None
        if count is not None:
            self.put(count, last + self.silence)
        elif before is not None:
            self.held.clear()
        if ticks:
            yield pd.DataFrame({"key": [key[0]] * len(ticks), "at": ticks})


def _run(stream: DataFrame, processor: StatefulProcessor, key: str, at: str, lateness: str, extra: tuple = ()) -> DataFrame:
    """stream with the columns key, at (milliseconds) and those of `extra`, through a processor; key and at come out. The session needs a state store with timers (PROVIDER)."""
    rows = stream.filter(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("bigint").alias("at"), *extra, F.timestamp_millis(F.col(at)).alias("_time"))
    rows = rows.withWatermark("_time", lateness)
    kind = stream.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(processor, outputStructType=f"key {kind}, at bigint", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.col("at").alias(at))


def rate_limited(alarms: DataFrame, key: str, at: str, window_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """The alarms that are kept: each at least window_ms after the last kept one of its key. Null times are dropped."""
    return _run(alarms, RateLimit(window_ms), key, at, lateness)


def auto_resolve(ticks: DataFrame, key: str, at: str, violated: str, clean: int = 2, silence_ms: int = 7 * 86_400_000, lateness: str = "0 seconds") -> DataFrame:
    """key and time at which its alarm resolves: the clean-th tick in a row without violation. A key that says nothing for silence_ms is forgotten."""
    return _run(ticks, Resolve(clean, silence_ms), key, at, lateness, (F.col(violated).alias("bad"),))
