"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Documents become token ids. What is longer than a sequence is cut into whole sequences and a rest. The rests are dealt by a hash into groups
of about `group_rows` rows; each group places them, longest first, into the first sequence with room, which a tournament tree over the free
lengths finds in logarithmic time. Documents may be cut, so the emptiest sequences of a group are then taken apart: their documents fill the
gaps of the others exactly, with one cut a gap at most, and the last tokens become sequences whose lengths are powers of two, which need no
padding. Every sequence is full or a power of two. Only documents that are cut here meet their stored ids again, for the checksums of
their parts; all other steps keep narrow rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.piece_arrays import encoded_rows, library_table, word_cuts
from tracemill.llm.tables import id_and_text
from tracemill.session import materialize

#: Rests in a group, about: groups are dealt by a hash.
GROUP_ROWS = 4096
#: Bytes of text that a step encodes: this table's words rarely repeat, so it is faster by long steps.
STEP_BYTES = 8 << 20
#: A group's sequences are numbered below this; a group has no more sequences than rows and powers of two.
_SEQUENCES = 1 << 24


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to `capacity`), and the fill of each bin: longest first (ties in the given order), each into the first
    bin with room.

    The tree's leaves are the free lengths of all bins that could be needed, each inner node the larger of its two; the descent takes the
    left child wherever it has room.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets, np.zeros(0, np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    fills = capacity - np.array(room[leaves:], np.int64)
    return bins, offsets, fills[fills > 0]


def packed_parts(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, start in it, length, sequence, offset) of every part of rows of these sizes; each sequence is full or a power of two.

    All sequences that can be full are: the fullest of the first-fit packing stay as they are, and the documents of the others, longest first, fill
    their gaps; what is left over is cut into powers of two, the largest first.
    """
    bins, offsets, fills = first_fit_decreasing(sizes, capacity)
    full, over = divmod(int(sizes.sum()), capacity)
    stay = np.argsort(-fills, kind="stable")[:full]
    number = np.full(len(fills), -1)
    number[stay] = np.arange(full)
    parts = [(i, 0, int(sizes[i]), int(number[bins[i]]), int(offsets[i])) for i in range(len(sizes)) if number[bins[i]] >= 0]
    # What is to be filled: the gaps, then a sequence for each power of two in what is over.
    targets = [(k, int(fills[b]), capacity) for k, b in enumerate(stay.tolist()) if fills[b] < capacity]
    targets += [(full + k, 0, 1 << p) for k, p in enumerate(p for p in range(over.bit_length() - 1, -1, -1) if over >> p & 1)]
    loose = [(i, 0) for i in np.argsort(sizes, kind="stable").tolist() if number[bins[i]] < 0]
    for sequence, at, end in targets:
        while at < end:
            i, start = loose.pop()
            length = min(int(sizes[i]) - start, end - at)
            parts.append((i, start, length, sequence, at))
            at += length
            if start + length < sizes[i]:
                loose.append((i, start + length))
    return parts


def token_rests(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and ids (null for whole sequences) of the whole sequences and the rest of each document's
    ids, with `end_id` at their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = library_table(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            row, start, size, crc, total, rest = [], [], [], [], [], []
            for k, ids in enumerate(encoded_rows(batch.column("text"), table, word_cuts, words_only=True, limit=STEP_BYTES)):
                n = len(ids) // 4 + 1
                for at in range(0, n, capacity):
                    part = bytes(ids[4 * at : 4 * (at + capacity)])
                    part = part if at + capacity < n else part + end
                    row.append(k)
                    start.append(at)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    rest.append(part if len(part) < 4 * capacity else None)
            longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *longs, pa.array(rest, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", kind="stable")
        sizes, uid = rows["length"].to_numpy(), rows["uid"].to_numpy()
        i, start, length, sequence, offset = np.array(packed_parts(sizes, capacity), np.int64).reshape(-1, 5).T
        return pd.DataFrame({"uid": uid[i], "skip": start, "part": length, "cut": length < sizes[i], "sequence_id": key[0] * _SEQUENCES + sequence, "offset": offset})

    return run


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each part, from the ids of its document's rest."""
    for batch in batches:
        cut = zip(batch.column("ids"), batch.column("skip").to_pylist(), batch.column("length").to_pylist(), strict=True)
        crc = pa.array([zlib.crc32(ids.as_buffer()[4 * skip : 4 * (skip + part)]) for ids, skip, part in cut], pa.int64())
        names = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(c) for c in names], names)


def pack_first_fit(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_rows: int = GROUP_ROWS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is one piece of `end_id` alone. Repeated rows and null ids are documents of their own; ties go by the order in
    which rows are stored; an empty table gives none; other columns are not read. Sequences are full, or powers of two long: at most
    the binary logarithm of `capacity` of these in each group.
    """
    rests = token_rests(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    rests = materialize(rests, "rests")
    whole = rests.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = rests.where(F.col("length") < capacity)
    groups = max(1, math.ceil(loose.count() / group_rows))
    dealt = loose.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)).alias("grp"))
    packed = materialize(dealt.groupBy("grp").applyInPandas(_pack_group(capacity), "uid long, skip long, part long, cut boolean, sequence_id long, offset long"), "packed")
    place = [(F.col("start") + F.col("skip")).alias("start"), F.col("part").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    uncut = packed.where("NOT cut").join(loose.drop("ids", "length"), "uid").select("doc_id", *place)
    # Stored apart, so that Spark knows how few they are and need not move all ids.
    cut = materialize(packed.where("cut").drop("cut"), "cut").join(loose.drop("length"), "uid").select("doc_id", *place, "ids", "skip")
    cut = cut.mapInArrow(_checksums, cut.drop("ids").schema).drop("skip")
    return whole.unionByName(uncut).unionByName(cut)
