"""When to snapshot a session, and how full the agent's memory is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.operators.grouping import micros, nearest_value, number_rows, time_chunk

EVERY = 5
PAUSE = 1800
WARN, URGENT, LIMIT = 1500, 1800, 2200
OUTPUT = "session_id long, event_id long, ts timestamp, turn long, trigger string"


def memory_level(used: str | Column) -> Column:
    """urgent before warn; null below both."""
    c = F.col(used) if isinstance(used, str) else used
    return F.when(c > URGENT, "urgent").when(c > WARN, "warn")


def memory_percent(used: str | Column) -> Column:
    c = F.col(used) if isinstance(used, str) else used
    return F.floor(c * 100 / F.lit(LIMIT)).cast("long")


def snapshot_triggers_batch(turns: DataFrame, *, every: int = EVERY, pause: int = PAUSE) -> DataFrame:
    """Trigger per turn (`session_id, event_id, ts`): every fifth turn, else 30 minutes after the last snapshot or none yet.

    Every fifth turn sets the time of the last snapshot whatever came before, so the turns between two of them depend on
    nothing else. A session of any length falls into pieces of five turns that are decided on their own.
    """
    seconds = F.floor(micros("ts") / F.lit(1_000_000)).cast("long")
    numbered = number_rows(turns.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), ["session_id"], time_chunk("ts"), [F.col("ts"), F.col("event_id")], "turn")
    t = numbered.withColumn("sec", seconds).withColumn("piece", F.floor((F.col("turn") - 1) / every))
    start = t.where(F.col("turn") % every == 0).select("session_id", (F.col("piece") + 1).alias("piece"), F.col("sec").alias("start"))
    piece = t.groupBy("session_id", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "sec", "event_id", "ts"))).alias("rows")).join(start, ["session_id", "piece"], "left")

    def step(acc, row):
        fifth = row["turn"] % every == 0
        timed = acc["last"].isNull() | (row["sec"] - acc["last"] >= pause)
        fired = F.when(fifth, "snapshot_5turn").when(timed, "snapshot_30min")
        out = F.struct(row["event_id"].alias("event_id"), row["ts"].alias("ts"), row["turn"].alias("turn"), fired.alias("trigger"))
        return F.struct(F.when(fired.isNotNull(), row["sec"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["out"], out).alias("out"))

    empty = F.array().cast("array<struct<event_id:bigint,ts:timestamp,turn:bigint,trigger:string>>")
    done = piece.select("session_id", F.explode(F.aggregate("rows", F.struct(F.col("start").alias("last"), empty.alias("out")), step)["out"]).alias("r"))
    return done.select("session_id", "r.event_id", "r.ts", "r.turn", "r.trigger")


class _Snapshots(StatefulProcessor):
    def __init__(self, every: int, pause: int):
        self._every, self._pause = every, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("session", "turns long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        turns, last = tuple(self._state.get()) if self._state.exists() else (0, None)
        numbers, fired = [], []
        for ts in pdf["ts"]:
            turns, now, hit = turns + 1, int(ts.timestamp()), None
            if turns % self._every == 0:
                hit = "snapshot_5turn"
            elif last is None or now - last >= self._pause:
                hit = "snapshot_30min"
            last = last if hit is None else now
            numbers.append(turns)
            fired.append(hit)
        self._state.update((turns, last))
        yield pdf.assign(session_id=key[0], turn=numbers, trigger=fired)[["session_id", "event_id", "ts", "turn", "trigger"]]

    def close(self) -> None:
        pass


def snapshot_triggers(stream: DataFrame, *, every: int = EVERY, pause: int = PAUSE) -> DataFrame:
    """The same triggers on a stream, with turn count and last snapshot kept per session."""
    return (
        stream.select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("session_id")
        .transformWithStateInPandas(_Snapshots(every, pause), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    )


def level_changes_batch(usage: DataFrame) -> DataFrame:
    """Rows (`session_id, event_id, ts, used`) where the memory level differs from the row before."""
    level = F.coalesce(memory_level("used"), F.lit("normal"))
    rows = usage.withColumn("level", level).withColumn("_at", micros("ts"))
    # events of one instant are told apart by their id, so the order key is the pair folded into one position per slice
    placed = number_rows(rows, ["session_id"], time_chunk("ts"), [F.col("_at"), F.col("event_id")], "_n")
    near = nearest_value(placed, ["session_id"], F.col("_n"), F.floor(F.col("_n") / 4096).cast("long"), F.col("level"), "_before")
    return near.where(F.col("level") != F.coalesce("_before", F.lit("normal"))).select("session_id", "event_id", "ts", "used", "level")
