"""Alert suppression: a delivered message stays silent, an undelivered one is retried after a pause."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COOLDOWN = 3600.0
OUTPUT = "channel string, event_id long, ts timestamp, message string, send boolean"
STATE = "delivered string, attempted string, attempted_at double"


def _step(state: tuple, message: str | None, at: float, delivered: bool, cooldown: float) -> tuple[bool, tuple]:
    """(send now?, next state). State: delivered message, last attempted message and its time. A null message is a recovery."""
    known, attempted, when = state
    if message is None:
        return False, (None, None, 0.0)
    if message == known or (message == attempted and at - when < cooldown):
        return False, state
    return True, (message if delivered else known, message, at)


def suppress_alerts_batch(alerts: DataFrame, *, cooldown: float = COOLDOWN) -> DataFrame:
    """Decision per alert (`channel, event_id, ts, message, delivered`) over a finished table.

    A recovery (null message) puts a channel back to its first state, so the alerts between two recoveries are a chain of their own. Each
    chain is read in time order, batch after batch, with three values carried along: memory does not grow with it, and a channel is as
    many tasks as it has chains.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, state = None, (None, None, 0.0)
        for pdf in batches:
            sends = []
            for c, p, message, at, ok in zip(pdf["channel"], pdf["piece"], pdf["message"], pdf["at"], pdf["delivered"]):
                if (c, p) != chain:
                    chain, state = (c, p), (None, None, 0.0)
                send, state = _step(state, None if pd.isna(message) else message, at, bool(ok), cooldown)
                sends.append(send)
            yield pdf.assign(send=sends)[["channel", "event_id", "ts", "message", "send"]]

    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = alerts.select("channel", "event_id", F.col("ts").cast("timestamp").alias("ts"), "message", F.coalesce("delivered", F.lit(False)).alias("delivered"), at.alias("at"))
    ordered = _numbered_chains(rows).repartition("channel", "piece").sortWithinPartitions("channel", "piece", "ts", "event_id")
    return ordered.mapInPandas(run, OUTPUT)


def _numbered_chains(rows: DataFrame) -> DataFrame:
    """Adds `piece`: how many recoveries of the channel come before the row. Counted inside days, then over the days' sums."""
    day = F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).alias("_day")
    marked = rows.withColumns({"_day": day, "_end": F.col("message").isNull().cast("long")})
    before = Window.partitionBy("channel").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = marked.groupBy("channel", "_day").agg(F.sum("_end").alias("_n")).select("channel", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("channel", "_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.withColumn("_ends", F.coalesce(F.sum("_end").over(inside), F.lit(0))).join(days, ["channel", "_day"])
    return numbered.withColumn("piece", F.col("_base") + F.col("_ends")).drop("_day", "_end", "_ends", "_base")


class _Suppressor(StatefulProcessor):
    def __init__(self, cooldown: float):
        self._cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state = tuple(self._state.get()) if self._state.exists() else (None, None, 0.0)
        sends = []
        for message, ts, ok in zip(pdf["message"], pdf["ts"], pdf["delivered"]):
            send, state = _step(state, None if pd.isna(message) else message, ts.timestamp(), bool(ok), self._cooldown)
            sends.append(send)
        self._state.update(state)
        yield pdf.assign(channel=key[0], send=sends)[["channel", "event_id", "ts", "message", "send"]]

    def close(self) -> None:
        pass


def suppress_alerts(stream: DataFrame, *, cooldown: float = COOLDOWN) -> DataFrame:
    """The same decisions on a stream, with the state of every channel kept between micro-batches."""
    return (
        stream.select("channel", "event_id", F.col("ts").cast("timestamp").alias("ts"), "message", F.coalesce("delivered", F.lit(False)).alias("delivered"))
        .groupBy("channel").transformWithStateInPandas(_Suppressor(cooldown), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    )
