"""Rolling anomaly counts and silent rooms with keyed state and event-time timers.

Both first reduce the stream to one row per room and minute with a built-in aggregate, which
is combined before the shuffle. The stateful step then sees at most 1440 rows a day of a
room, however many readings that room sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorloom.operators.state import HOUR, is_anomaly

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state with timers needs this store; the setting is put back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _instants(millis) -> pd.Series:
    return pd.to_datetime(pd.Series(millis, dtype="int64"), unit="ms")


def _millis(stamps: pd.Series) -> np.ndarray:
    return pd.to_datetime(stamps).astype("datetime64[ms]").astype("int64").to_numpy()


class RollingCount(StatefulProcessor):
    """The minutes of one room that still count, and one timer for the first to stop counting."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getValueState("minutes", "ends array<bigint>, n array<bigint>")

    def _advance(self, room_id: str, new: pd.DataFrame, now: int) -> pd.DataFrame:
        """Report each instant up to ``now`` at which minutes start or stop counting."""
        held = self.minutes.get() if self.minutes.exists() else ([], [])
        ends = np.concatenate([np.array(held[0], dtype="int64"), new["end"].to_numpy(dtype="int64")])
        n = np.concatenate([np.array(held[1], dtype="int64"), new["n"].to_numpy(dtype="int64")])
        in_time = np.argsort(ends)
        ends, n = ends[in_time], n[in_time]
        stops = ends + self.span_ms
        at = np.unique(np.concatenate([new["end"].to_numpy(dtype="int64"), stops[stops <= now]]))
        running = np.concatenate([[0], n.cumsum()])
        counts = (
            running[np.searchsorted(ends, at, side="right")] - running[np.searchsorted(stops, at, side="right")]
        )
        left = stops > now
        if left.any():
            self.minutes.update((ends[left].tolist(), n[left].tolist()))
            self.handle.registerTimer(int(stops[left][0]))
        else:
            self.minutes.clear()
        return pd.DataFrame({"room_id": room_id, "at": _instants(at), "anomalies_in_span": counts})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = pd.DataFrame({"end": _millis(new["end"]), "n": new["n"].to_numpy()})
        yield self._advance(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"end": [], "n": []})
        yield self._advance(key[0], none, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def rolling_counts(log: DataFrame, hours: int = 24) -> DataFrame:
    """Each change of the rolling anomaly count of a room, to the minute.

    A minute counts from its end until just before ``hours`` later. ``log`` carries a watermark
    and all readings: normal ones drive the clock, and minutes without anomalies are dropped
    only after they were counted, so that no filter gets under the watermark.
    """
    minutes = (
        log.groupBy("room_id", F.window("ts", "1 minute").alias("w"))
        .agg(F.count_if(is_anomaly()).alias("n"))
        .filter("n > 0")
        .select("room_id", F.col("w.end").alias("end"), "n")
    )
    return minutes.groupBy("room_id").transformWithStateInPandas(
        RollingCount(hours * HOUR * 1000),
        outputStructType="room_id string, at timestamp, anomalies_in_span bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


class Silence(StatefulProcessor):
    """The last minute heard of one room, and a timer for when it counts as silent."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, offline boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard = np.sort(_millis(pd.concat(list(rows))["end"]))
        last, offline = self.last.get() if self.last.exists() else (None, False)
        out = []
        if last is not None:
            if not offline:
                self.handle.deleteTimer(last + self.after_ms)
            heard = np.concatenate([[last], heard[heard > last]])
        # Several minutes may close at once; silences between them are reported here.
        for i, (a, b) in enumerate(zip(heard[:-1].tolist(), heard[1:].tolist())):
            silent = b - a > self.after_ms
            if silent and not (i == 0 and offline):
                out.append((key[0], "offline", a + self.after_ms))
            if silent:
                out.append((key[0], "active", b))
        end = int(heard[-1])
        self.last.update((end, False))
        self.handle.registerTimer(end + self.after_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        last, _ = self.last.get()
        self.last.update((last, True))
        yield self._frame([(key[0], "offline", at)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["room_id", "status", "at"])
        frame["at"] = _instants(frame["at"].to_numpy(dtype="int64"))
        return frame

    def close(self) -> None:
        pass


def silent_rooms(log: DataFrame, after_seconds: int = HOUR) -> DataFrame:
    """When each room went ``offline`` and came back ``active``, to the minute."""
    minutes = (
        log.groupBy("room_id", F.window("ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("room_id", F.col("w.end").alias("end"))
    )
    return minutes.groupBy("room_id").transformWithStateInPandas(
        Silence(after_seconds * 1000),
        outputStructType="room_id string, status string, at timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )
