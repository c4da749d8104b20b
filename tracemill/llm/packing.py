"""Best-fit packing with certified bin counts.

Documents become token sequences; only what is longer than a sequence is cut. Whole pieces of the sequence's length are sequences by
themselves, the rest is packed: pieces are dealt into groups of a fixed number of rows, each group runs best-fit decreasing, and
dual-feasible functions give a lower bound of the sequences it needs. A group that meets its bound is certified and gives up only its
emptiest sequence; a group with a gap gives up its emptiest ones. What was given up meets in as many groups as it fills and is packed again, until one
group is left or a round frees about as many rows as it took. Every step keeps narrow rows (no text), and a group has about
`group_rows` rows in every round, whatever the table.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.piece_arrays import blank_cuts, encoded_rows, library_table
from tracemill.llm.tables import id_and_text
from tracemill.session import materialize

#: Pieces in a group, about: they are dealt by a hash.
GROUP_ROWS = 4096
#: A round that leaves more than this part of its rows to the next one is the last but one.
WORTH = 0.75
#: A group's sequences are numbered below this; it has no more of them than rows.
_SEQUENCES = 1 << 24


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", by: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document's ids with `end_id` at the end; and `by`, if that column is named.

    The first piece takes what is over the full ones, so all but the first have the full length. A null or empty text is one piece of
    one token. Repeated rows are documents of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = library_table(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for k, own in enumerate(encoded_rows(batch.column("text"), table, blank_cuts)):
                ids = bytes(own) + end
                n = len(ids) // 4
                at, step = 0, n - (math.ceil(n / length) - 1) * length
                while at < n:
                    row.append(k)
                    piece.append(0 if at == 0 else piece[-1] + 1)
                    start.append(at)
                    size.append(step)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + step)]))
                    at, step = at + step, length
            at = pa.array(row, pa.int64())
            own = {"by": batch.column("by").take(at)} if by else {}
            columns = {"doc_id": batch.column("doc_id").take(at), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())} | own
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[by].alias("by")) if by else id_and_text(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, f"{schema}, by {rows.schema['by'].dataType.simpleString()}" if by else schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    The first, for each k up to half the capacity, counts sizes over capacity - k as whole bins, leaves out those under k and keeps the
    others. The second, for small whole k, rounds (k + 1) * size / capacity down to parts of 1 / k, and keeps sizes it divides exactly.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below_n, below_sum = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(capacity // 2 + 1)
    whole = below_n[-1] - below_n[capacity - k]
    kept = below_sum[capacity - k] - np.where(k > 0, below_sum[np.maximum(k - 1, 0)], 0)
    best = int(np.max(whole + -(-kept // capacity)))
    for k in range(1, 21):
        scaled = (k + 1) * size
        parts = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * parts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the fill of each bin. The longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    rooms: list[int] = []  # sorted distinct free lengths
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            if room - size not in by_room:
                insort(rooms, room - size)
                by_room[room - size] = []
            by_room[room - size].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _pack_group(capacity: int, last: bool):
    """Packs the rows of one group; marks those of the emptiest bins as free for the next round, unless this is the last."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        sizes = rows["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(sizes, capacity)
        gap = len(fills) - lower_bound(sizes, capacity)
        free = np.zeros(len(fills), bool)
        if not last:
            free[np.argsort(fills, kind="stable")[: 1 + 4 * gap]] = True
            free &= fills < capacity
        return pd.DataFrame({"uid": rows["uid"].to_numpy(), "length": sizes, "grp": key[0], "kind": rows["kind"].to_numpy(), "bin": bins, "offset": offsets, "free": free[bins], "gap": gap})

    return run


def pack(rows: DataFrame, capacity: int, group_rows: int = GROUP_ROWS, by: str | None = None) -> DataFrame:
    """uid, sequence_id, offset and gap of each row of (uid, length), uid distinct and length 1 to `capacity`. gap is the certificate of the group that
    placed the row: its sequences beyond the lower bound, 0 if it is known to need as many.

    An empty table gives none. Rows of the full length are sequences by themselves. `by` is a column of few values that no sequence mixes.
    """
    full = rows.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    kind = F.lit(0)
    if by:
        for n, (value,) in enumerate(sorted(rows.select(by).distinct().collect(), key=str)):
            kind = F.when(F.col(by).eqNullSafe(F.lit(value)), n).otherwise(kind)
    left, level, done = rows.where(F.col("length") < capacity).select("uid", "length", kind.alias("kind")), 0, [full]
    counts = _counts(left)
    met = sum(counts.values())
    while True:
        groups = {k: max(1, math.ceil(n / group_rows)) for k, n in counts.items()}
        rows_left = sum(counts.values())
        # Freed rows meet anew, in groups of the same size, as long as fewer are freed each time.
        last = all(n == 1 for n in groups.values()) or bool(level) and rows_left > WORTH * met
        met = rows_left
        group, before = F.lit(0).cast("long"), 0
        for k, n in groups.items():
            group = F.when(F.col("kind") == k, F.lit(before) + F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n))).otherwise(group)
            before += n
        dealt = left.withColumn("grp", group)
        packed = dealt.groupBy("grp").applyInPandas(_pack_group(capacity, last), "uid long, length long, grp long, kind int, bin long, offset long, free boolean, gap long")
        packed = materialize(packed, f"packed-{level}")
        number = F.lit(level << 56) + F.col("grp") * _SEQUENCES + F.col("bin")
        done.append(packed.where(~F.col("free")).select("uid", number.alias("sequence_id"), "offset", "gap"))
        left, level = packed.where("free").select("uid", "length", "kind"), level + 1
        counts = {} if last else _counts(left)
        if not counts:
            return reduce(DataFrame.unionByName, done)


def _counts(rows: DataFrame) -> dict[int, int]:
    return dict(sorted((r["kind"], r["count"]) for r in rows.groupBy("kind").count().collect()))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text", by: str | None = None
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and gap (see pack). Cases as in token_pieces; an empty table gives none.
    `by` names a column of few values, a language say; a sequence holds documents of one of them."""
    cut = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, by).withColumn("uid", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    return cut.drop("by").join(pack(cut.drop("doc_id", "piece", "start", "ids_crc32"), capacity, group_rows, by and "by"), "uid").drop("uid")
