"""Tokens of two tokenizers over the same bytes: groups between common ends, and overlapping pairs with their counts in the corpus.

Tokens of both end at every place where texts are cut into pieces, so a piece's groups and links are found once a worker. Counts need the whole
corpus: each block of documents (about `BLOCK_BYTES` of text) lists its distinct pairs once with the documents that hold them; these
rows, not those of single documents, are summed up by pair and go back to their block, where the documents read them.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.bpe import bpe
from tracemill.llm.piece_arrays import blank_cuts, gathered, library_pieces, numbered_pieces, text_steps, worker_table
from tracemill.llm.tables import id_and_text
from tracemill.session import materialize

#: Text of a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Pieces whose alignment a worker keeps at most: one takes about half a kilobyte.
ALIGNED_PIECES = 500_000
_SHIFT = 32


def common_ends(short: list[int], long: list[int]) -> list[tuple[int, int]]:
    """Indices in both sorted lists of the values they share. Each value of the shorter list gallops into the longer one: steps double until
    they pass it, then a binary search ends it."""
    out, low, n = [], 0, len(long)
    for i, value in enumerate(short):
        step = 1
        while low + step < n and long[low + step] < value:
            step *= 2
        low = bisect_left(long, value, low + step // 2, min(low + step + 1, n))
        if low == n:
            break
        if long[low] == value:
            out.append((i, low))
    return out


def groups_of(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Index ranges (a from, a to, b from, b to) of the groups between common ends; both lists end at the same value."""
    if len(ends_a) <= len(ends_b):
        found = common_ends(ends_a, ends_b)
    else:
        found = [(a, b) for b, a in common_ends(ends_b, ends_a)]
    out, a, b = [], 0, 0
    for i, j in found:
        out.append((a, i + 1, b, j + 1))
        a, b = i + 1, j + 1
    return out


def overlaps(ends_a: list[int], ends_b: list[int], group: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int]]:
    """For each a of a group the range of the b whose bytes it shares: the rank of its begin and of its end among the group's ends of b."""
    a, a_end, b, b_end = group
    for i in range(a, a_end):
        begin = ends_a[i - 1] if i else 0
        yield i, bisect_right(ends_b, begin, b, b_end), bisect_left(ends_b, ends_a[i], b, b_end) + 1


class Aligner:
    """Aligns pieces of texts under a byte-level BPE file and a sentencepiece model. A worker keeps one."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.ids_a = library_pieces(path_a, special_as_text=True)
        self.bytes_a = bpe(path_a).bytes_of
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # Pieces are sound if no entry crosses a place where texts are cut.
        if crossing := [x for x in names if re.search("[^▁]▁|.\n|\n.|[A-Za-z][,.;:!?]", x)]:
            raise ValueError(f"entries of {path_b} cross the cuts of texts: {crossing[:5]}")

    def ids_b(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces inside a text. A line end before each takes the blank that the model adds in front; both are cut off again."""
        return [x[2:] for x in self.model.encode(["\n" + x.decode() for x in pieces], num_threads=1)]

    def align(self, pieces: list[bytes]) -> list[tuple[int, int, int, bytes, bytes] | tuple]:
        """For each piece: number of a, of b, of groups, the groups as text (each with `;` after it) and the linked pairs; () if the tokens of either are other bytes."""
        out = []
        for piece, a, b in zip(pieces, map(memoryview, self.ids_a(pieces)), self.ids_b(pieces), strict=True):
            a = a.cast("I").tolist()
            names_a, names_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(names_a) != piece or b"".join(names_b) != piece:
                out.append(())
                continue
            ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (names_a, names_b))
            text, links, groups = [], [], groups_of(ends_a, ends_b)
            for g in groups:
                text.append(f"{','.join(map(str, a[g[0] : g[1]]))}|{','.join(map(str, b[g[2] : g[3]]))};")
                if g[1] - g[0] == 1:
                    links += [a[g[0]] << _SHIFT | j for j in b[g[2] : g[3]]]
                else:
                    links += [a[i] << _SHIFT | j for i, low, high in overlaps(ends_a, ends_b, g) for j in b[low:high]]
            out.append((len(a), len(b), len(groups), "".join(text).encode(), np.array(links, np.int64).tobytes()))
        return out


def _aligned(path_a: str, path_b: str):
    """Documents as stored rows of blocks; a block's first row lists its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(("align", path_a, path_b), lambda: Aligner(path_a, path_b).align, ALIGNED_PIECES)
        number = itertools.count()
        for batch in batches:
            for low, texts in text_steps(batch.column("text"), BLOCK_BYTES):
                block = TaskContext.get().partitionId() << 32 | next(number)
                yield _block(batch.column("doc_id").slice(low, len(texts)), block, *numbered_pieces(texts, blank_cuts), table)

    return run


def _block(ids: pa.Array, block: int, numbers: pa.Array, pieces: list[bytes], before: np.ndarray, table) -> pa.RecordBatch:
    rows, code = len(before) - 1, numbers.to_numpy(zero_copy_only=False)
    found = table.values(pieces)
    wrong = np.array([not x for x in found], bool)
    if wrong.any():  # such a document has no tokens
        lost = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(wrong[code])])[before]))
        keep = np.ones(len(code), bool)
        for k in lost:
            keep[before[k] : before[k + 1]] = False
        before = np.concatenate([[0], np.cumsum(keep)])[before]
        left, code = np.unique(code[keep], return_inverse=True)
        numbers, found = pa.array(code, pa.int32()), [found[k] for k in left]
    n = np.array([x[:3] for x in found], np.int64).reshape(-1, 3)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(n[code], axis=0)])
    sums = sums[before[1:]] - sums[before[:-1]]
    text, places = gathered([x[3] for x in found], numbers)
    at = places[before]
    sha = [hashlib.sha256(text[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    # Links of the distinct pieces become places in the block's sorted distinct pairs, and are then dealt to the documents.
    links = np.frombuffer(b"".join(x[4] for x in found), np.int64)
    pairs, place = np.unique(links, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum([len(x[4]) // 8 for x in found])])
    packed = place.astype(np.int32).tobytes()
    where, places = gathered([packed[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], numbers)
    at = places[before] // 4
    n_links = np.diff(at)
    row = np.repeat(np.arange(rows, dtype=np.int64), n_links)
    keys, times = np.unique(row * max(1, len(pairs)) + np.frombuffer(where, np.int32), return_counts=True)
    row, pair = np.divmod(keys, max(1, len(pairs)))
    cut = np.searchsorted(row, np.arange(rows + 1))
    steps = np.diff(pair, prepend=0).astype(np.int32)  # small numbers, which the store packs well
    firsts = cut[:-1][cut[:-1] < cut[1:]]
    steps[firsts] = pair[firsts]
    docs = np.bincount(pair, minlength=len(pairs))

    def binaries(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32).tobytes())])

    head = lambda x: pa.array([x.tolist() if len(x) else None, *[None] * (rows - 1)], pa.list_(pa.int64()))
    columns = [ids, pa.array([block] * rows, pa.int64()), *(pa.array(sums[:, k]) for k in range(3)), pa.array(n_links), pa.array(sha, pa.string()), binaries(steps), binaries(times), head(pairs), head(docs)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pairs", "docs"])


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _counted(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with sums over their links; `pairs` has the block's pairs with their counts."""
    order = np.argsort(pairs.column("pair").to_numpy())
    count, best = pairs.column("n_docs").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    n_best, total = [], []
    for steps, times in zip(docs.column("steps"), docs.column("times"), strict=True):
        pair, times = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32)), np.frombuffer(times.as_buffer(), np.int32)
        n_best.append(int((best[pair] * times).sum()))
        total.append(int((count[pair] * times).sum()))
    out = docs.drop_columns(["block", "steps", "times"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of its text with a blank before it.

    A null or empty text, and one whose tokens of either tokenizer are not its bytes, has no tokens: zeros and an empty digest. Repeated rows and null
    ids are documents of their own and count as such; an empty table gives none; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).alias("text"))
    stored = rows.mapInArrow(_aligned(path_a, path_b), f"doc_id {kind}, block long, {_COUNTS}, steps binary, times binary, pairs array<long>, docs array<long>")
    stored = materialize(stored, "aligned", compression="zstd")
    held = stored.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = materialize(held.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pairs")
    first = F.shiftright("pair", _SHIFT)
    most = counts.groupBy(first.alias("a")).agg(F.max("n_docs").alias("most"))
    flagged = counts.withColumn("a", first).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    pairs = held.select(F.col("block").alias("home"), "pair").join(flagged, "pair")
    of_block = stored.drop("pairs", "docs").groupBy("block").cogroup(pairs.groupBy("home"))
    return of_block.applyInArrow(_counted, f"doc_id {kind}, {_COUNTS}, n_best long, count_sum long")
