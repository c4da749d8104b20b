"""Event-time deduplication, tumbling counts and the incremental rebuild of the session index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.grouping import top_rows
from tracemill.operators.sessions import index_health, merge_summaries


def dedupe_events(stream: DataFrame, keys: list[str], *, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The event of each key that arrives first; a repeat is recognised as long as it arrives within the delay.

    Arrival decides in the stream, since its rows can't be taken back; where events arrive in order of time and id, it keeps the same rows
    as the batch form, which decides by time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def dedupe_events_batch(events: DataFrame, keys: list[str], *, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    return top_rows(events, keys, [F.col(o) for o in order], 1)


def tumbling_counts(events: DataFrame, by: list[str], *, time: str = "ts", width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Rows per window and group. With `delay` the input is a stream and a window is final once the watermark passes it."""
    src = events.withWatermark(time, delay) if delay else events
    return src.groupBy(F.window(time, width, startTime="4 days" if width == "7 days" else None).alias("w"), *by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), *by, "n")


def ingest_batch(read_index: Callable[[], DataFrame], write_index: Callable[[DataFrame, str], bool], write_health: Callable[[DataFrame], None], summarize: Callable[[DataFrame], DataFrame], stream: str):
    """`foreachBatch` function: summarize the new records, merge them into the index, store a new snapshot and its health row.

    `stream` names the checkpoint. A batch is known by that name and its number, so a replayed batch changes nothing, and a stream with a
    new checkpoint, whose numbers start again, needs a new name. `write_index` says whether it wrote; only then is there a health row.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        merged = merge_summaries(read_index(), summarize(batch))
        if write_index(merged.drop("action"), f"{stream}:{batch_id}"):
            write_health(index_health(merged, F.current_timestamp()).withColumn("batch_id", F.lit(batch_id)))

    return run
