"""Byte-level BPE: a queue of merge ranks over a doubly linked list of symbols, and decoding by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracemill.llm.pretokens import values_of_texts, worker_cache
from tracemill.llm.tables import id_and_text

#: Fixed value: the pattern that cuts text before the merges, as the tokenizer file's byte-level pre-tokenizer has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizer's own pattern language has it (without the four separators that Python adds).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHIFT, _MASK = 32, (1 << 32) - 1


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: itself where it is printable, else the next letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one byte-level BPE file. A worker keeps one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault(vocab[left] << _SHIFT | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (vocab | self.special).items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.split = regex.compile(PATTERN.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]"))
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word_ids: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. The queue holds rank and place of adjacent pairs; an entry whose pair has changed since is skipped."""
        symbols = [self.of_byte[b] for b in data]
        n = len(symbols)
        rank_of, made = self.rank_of, self.made
        queue = [r << _SHIFT | i for i in range(n - 1) if (r := rank_of.get(symbols[i] << _SHIFT | symbols[i + 1])) is not None]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> _SHIFT, entry & _MASK
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of.get(symbols[i] << _SHIFT | symbols[j]) != rank:
                continue
            symbols[i] = new = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := rank_of.get(new << _SHIFT | symbols[k])) is not None:
                heappush(queue, r << _SHIFT | i)
            h = before[i]
            if h >= 0 and (r := rank_of.get(symbols[h] << _SHIFT | new)) is not None:
                heappush(queue, r << _SHIFT | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of any text as unsigned 32-bit integers; the strings of special tokens become those tokens."""
        out = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for word in self.split.findall(part):
                ids = self.word_ids.get(word)
                if ids is None:
                    ids = array("I", self.merge(word.encode())).tobytes()
                    if len(word) <= 32:
                        if len(self.word_ids) >= 300_000:
                            self.word_ids.clear()
                        self.word_ids[word] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes: vocabulary strings put together."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of long) and decoded (the text read back from them; bytes that are no text become U+FFFD) of each row.

    A null text counts as empty, which has no ids and decodes to the empty text; repeated rows and null ids are kept; an empty table gives
    none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _encoded(batches, tokenizer_path):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int64())), pa.array([bpe(tokenizer_path).decode(x).decode("utf-8", "replace") for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<long>, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text) of
    each row; cases as in encode_decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = bpe(tokenizer_path).decode
        for batch, ids in _encoded(batches, tokenizer_path):
            read = [decode(x).decode("utf-8", "replace").encode() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in read], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of a few hundred rows with the ids of their texts."""
    encoder = bpe(path)
    cache = worker_cache(("bpe", path), lambda parts: list(map(encoder.encode, parts)))
    for whole in batches:
        for low in range(0, whole.num_rows, 256):
            batch = whole.slice(low, 256)
            yield batch, [b"".join(x) for _, x in values_of_texts(cache, (x.as_py() for x in batch.column("text")))]
