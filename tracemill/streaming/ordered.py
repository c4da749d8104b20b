"""Keyed streams in order of event time: rows wait in state until the watermark has passed them, so it doesn't matter in which micro-batch they arrive.

Rows later than the watermark's delay are dropped by Spark, as with any watermark.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.operators.grouping import micros, nearest_value, number_rows, time_chunk
from tracemill.streaming import triggers as G

_ROWS = "micros long, event_id long, value long"


class InOrder(StatefulProcessor):
    """Holds rows (ts, event_id, value) of a key and hands them to `step` by time and id, once the watermark has passed. A timer stands for each
    millisecond with rows; `alarm` may set further ones."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", "millis long", "rows array<struct<micros: bigint, event_id: bigint, value: bigint>>")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # one Arrow batch after the other
            for at, event_id, value in zip(pdf["micros"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True):
                millis = -(-at // 1000)
                known = list(self._held.getValue((millis,))[0]) if self._held.containsKey((millis,)) else []
                if not known:
                    self._handle.registerTimer(millis)
                self._held.updateValue((millis,), ([*map(tuple, known), (at, event_id, int(value))],))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        millis = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if self._held.containsKey((millis,)):
            for at, event_id, value in sorted(map(tuple, self._held.getValue((millis,))[0])):
                out += self.step(at, event_id, value)
            self._held.removeKey((millis,))
        out += self.alarm(millis)
        if out:
            frame = pd.DataFrame(out, columns=self.columns[1:])
            frame.insert(0, self.columns[0], key[0])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            yield frame

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Makes the state of the rule."""

    @abstractmethod
    def step(self, micros: int, event_id: int, value: int) -> list[tuple]:
        """Rows to send for the next row of the key."""

    def alarm(self, millis: int) -> list[tuple]:
        """Rows to send when the watermark passes a time."""
        return []

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, value: Column, delay: str, processor: InOrder, output: str) -> DataFrame:
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select(key, "ts", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"), value.cast("long").alias("value"))
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


class _Triggers(InOrder):
    columns = ["session_id", "event_id", "ts", "turn", "trigger"]

    def __init__(self, every: int, pause: int):
        self._every, self._pause = every, pause

    def open(self, handle):
        self._state = handle.getValueState("session", "turns long, last long")

    def step(self, micros, event_id, value):
        turns, last = tuple(self._state.get()) if self._state.exists() else (0, None)
        turns, now, hit = turns + 1, micros // 1_000_000, None
        if turns % self._every == 0:
            hit = "snapshot_5turn"
        elif last is None or now - last >= self._pause:
            hit = "snapshot_30min"
        self._state.update((turns, last if hit is None else now))
        return [(event_id, micros, turns, hit)]


def ordered_triggers(stream: DataFrame, *, every: int = G.EVERY, pause: int = G.PAUSE, delay: str = "1 hour") -> DataFrame:
    """Snapshot triggers (as `snapshot_triggers_batch`) of a stream whose rows arrive out of order by at most `delay`."""
    return _in_order(stream, "session_id", F.lit(0), delay, _Triggers(every, pause), G.OUTPUT)


LEVELS = "session_id long, event_id long, ts timestamp, used long, level string"


class _Levels(InOrder):
    columns = ["session_id", "event_id", "ts", "used", "level"]

    def open(self, handle):
        self._level = handle.getValueState("level", "level string")

    def step(self, micros, event_id, value):
        level = "urgent" if value > G.URGENT else "warn" if value > G.WARN else "normal"
        before = self._level.get()[0] if self._level.exists() else "normal"
        if level == before:
            return []
        self._level.update((level,))
        return [(event_id, micros, value, level)]


def level_changes(stream: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """The rows of `level_changes_batch`, on a stream."""
    return _in_order(stream, "session_id", F.col("used"), delay, _Levels(), LEVELS)


SILENCES = "channel string, ts timestamp, state string"


class _Silences(InOrder):
    columns = ["channel", "ts", "state"]

    def __init__(self, limit: int):
        self._limit = limit * 1_000_000

    def open(self, handle):
        self._state = handle.getValueState("stamp", "last long, stale boolean")

    def step(self, micros, event_id, value):
        last, stale = tuple(self._state.get()) if self._state.exists() else (None, False)
        out = []
        if last is not None and micros - last > self._limit:
            out = [] if stale else [(last + self._limit, "stale")]
            out.append((micros, "recovered"))
        self._state.update((micros, False))
        self._handle.registerTimer(-(-(micros + self._limit) // 1000) + 1)
        return out

    def alarm(self, millis):
        last, stale = tuple(self._state.get()) if self._state.exists() else (None, True)
        if stale or last + self._limit >= millis * 1000:
            return []
        self._state.update((last, True))
        return [(last + self._limit, "stale")]


def silences(stream: DataFrame, *, limit: int, delay: str = "1 hour") -> DataFrame:
    """When each channel of stamps (`channel, event_id, ts`) falls silent for more than `limit` seconds, and when it is heard again. A silence is told as
    soon as the watermark has passed its limit, though no stamp comes."""
    return _in_order(stream, "channel", F.lit(0), delay, _Silences(limit), SILENCES)


def silences_batch(stamps: DataFrame, *, limit: int, until: Column) -> DataFrame:
    """The same over a finished table, with silences whose limit lies before `until`."""
    rows = stamps.select("channel", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    placed = number_rows(rows, ["channel"], time_chunk("ts"), [micros("ts"), F.col("event_id")], "_n")
    near = nearest_value(placed, ["channel"], F.col("_n"), F.floor(F.col("_n") / 4096).cast("long"), F.col("ts"), "_next", forward=True)
    ends = F.timestamp_micros(F.unix_micros("ts") + limit * 1_000_000)
    quiet = near.where(F.coalesce("_next", until.cast("timestamp")) > ends)
    stale = quiet.select("channel", ends.alias("ts"), F.lit("stale").alias("state"))
    return stale.unionByName(quiet.where("_next IS NOT NULL").select("channel", F.col("_next").alias("ts"), F.lit("recovered").alias("state")))
