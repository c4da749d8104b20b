"""Tokenizing whole columns by their distinct pieces.

The texts of a batch are one flat array of bytes. It is cut where no token can cross, Arrow numbers the distinct pieces, each distinct piece
is encoded once a worker, and the results are put together by Arrow's `take`. Python touches distinct pieces and rows, never each piece.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa

from tracemill.llm.columns import ASCII_LOWER, flat, table_of

#: Bytes of text that one step handles; a longer text makes a step of its own. Pieces meet again in the worker's table, so longer steps take
#: more memory and no less time.
STEP_BYTES = 1 << 20
#: Pieces a worker keeps at most, and the longest piece it keeps, in bytes.
KEPT_PIECES, LONG_PIECE = 1_200_000, 64

WHITE = table_of(b"\t\n\v\f\r ")
_WHITE_OR_CONTROL = table_of(b"\t\n\v\f\r \x1c\x1d\x1e\x1f")
#: Bytes with which white space outside ASCII can begin or end in UTF-8.
_MAY_BEGIN, _MAY_END = table_of(b"\xc2\xe1\xe2\xe3"), table_of(bytes([*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))
_BEFORE_END = table_of(b"\x80\x81\x9a\xc2")
_LETTER, _MARK = table_of(bytes(range(65, 91)) + bytes(range(97, 123))), table_of(b",.;:!?")


def mark_cuts(data: np.ndarray) -> np.ndarray:
    """Places of a mark after an ASCII letter, where tokenizers that part letters from other characters begin a new word. It spares a copy of
    each word for each mark that may follow."""
    return np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1


def blank_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single blanks and line ends between two characters that are surely no white space.

    A byte-level token never crosses such a place: white space can only begin a token there. Where a neighbour might be white space outside
    ASCII, nothing is cut, which is always right.
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at + 1 < len(data))]
    before, after = data[at - 1], data[at + 1]
    odd_before = _MAY_END[before] & _BEFORE_END[data[at - 2]]
    at = at[~(_WHITE_OR_CONTROL[before] | _WHITE_OR_CONTROL[after] | odd_before | _MAY_BEGIN[after] & (data[np.minimum(at + 2, len(data) - 1)] < 0xA1))]
    return np.concatenate([at, mark_cuts(data)])


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a word begins after ASCII white space, or a mark after a letter, for tokenizers that drop white space."""
    white = WHITE[data]
    return np.concatenate([np.flatnonzero(white[:-1] & ~white[1:]) + 1, mark_cuts(data)])


class PieceTable:
    """What `encode` gives for pieces, each asked once, many at a time. When half of `most` pieces are new, those not met since are forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = KEPT_PIECES):
        self.encode, self.most = encode, most
        self.recent: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}

    def values(self, pieces: list[bytes]) -> list:
        found = list(map(self.recent.get, pieces))
        if None not in found:
            return found
        if len(self.recent) + len(pieces) > self.most // 2:
            self.older, self.recent = self.recent, {}
        missed = [x for x, v in zip(pieces, found, strict=True) if v is None]
        again = list(map(self.older.get, missed))
        new = [x for x, v in zip(missed, again, strict=True) if v is None]
        fresh = dict(zip(new, self.encode(new), strict=True)) if new else {}
        got = {x: fresh[x] if v is None else v for x, v in zip(missed, again, strict=True)}
        self.recent.update((x, v) for x, v in got.items() if len(x) <= LONG_PIECE)
        return [got[x] if v is None else v for x, v in zip(pieces, found, strict=True)]


_tables: dict[tuple, PieceTable] = {}


def worker_table(key: tuple, make: Callable[[], Callable[[list[bytes]], list]], most: int = KEPT_PIECES) -> PieceTable:
    """The table of this worker for one use of one tokenizer; it outlives a task. `make` gives the encoder."""
    if key not in _tables:
        _tables[key] = PieceTable(make(), most)
    return _tables[key]


def numbered_pieces(column: pa.Array, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], words_only: bool = False) -> tuple[pa.Array, list[bytes], np.ndarray]:
    """The number of each piece, the distinct pieces, and for each row the number of pieces before it (one more entry than rows).

    Null counts as empty; an empty text has no pieces. `words_only` is for tokenizers that drop white space and lower letters: ASCII white space
    is left out, and A-Z are lowered, but where a special token might begin, as those are told by case.
    """
    data, offsets = flat(column)
    if words_only and not ((data[:-1] == 60) & (data[1:] == 124)).any():
        data = ASCII_LOWER[data]
    begins = np.zeros(len(data) + 1, bool)
    if len(data):
        begins[cuts(data, offsets)] = True
    if words_only:
        solid = ~WHITE[data]
        rank = np.zeros(len(data) + 1, np.int64)
        np.cumsum(solid, out=rank[1:])
        data, offsets, begins = data[solid], rank[offsets], np.append(begins[:-1][solid], False)
    begins[offsets] = True
    begins[len(data)] = True
    starts = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    joined, places = flat(coded.dictionary)
    joined, places = joined.tobytes(), places.tolist()
    return coded.indices, [joined[low:high] for low, high in zip(places[:-1], places[1:], strict=True)], np.searchsorted(starts, offsets)


def gathered(values: list[bytes], numbers: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of all pieces in one buffer, and where each piece's begins in it (one more entry than pieces)."""
    taken = pa.array(values, pa.large_binary()).take(numbers)
    _, places, buffer = taken.buffers()
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(buffer) if buffer is not None else memoryview(b""), offsets


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column of about `limit` bytes, one row at least, with their first row."""
    _, offsets = flat(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, column.slice(low, high - low)
        low = high


def library_pieces(path: str, special_as_text: bool = False) -> Callable[[list[bytes]], list[bytes]]:
    """An encoder of pieces by the tokenizers library: ids as unsigned 32-bit integers, no special tokens added, nothing cut or padded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = special_as_text

    def by(one) -> Callable[[list[bytes]], list[bytes]]:
        return lambda pieces: [array("I", x.ids).tobytes() for x in one.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]

    whole = by(tokenizer)
    spec = json.loads(tokenizer.to_str())
    if not (_keeps_lower_ascii(spec["normalizer"]) and _keeps_letters(spec["pre_tokenizer"])):
        return whole
    bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][-1]}))
    words = by(bare)

    def encode(pieces: list[bytes]) -> list[bytes]:
        plain = list(map(bool, map(_LETTERS, pieces)))
        parts = (iter(words(list(compress(pieces, plain)))), iter(whole(list(compress(pieces, map(not_, plain))))))
        return [next(parts[0] if p else parts[1]) for p in plain]

    return encode


_LETTERS = re.compile(rb"[a-z]+").fullmatch


def _keeps_lower_ascii(normalizer: dict | None) -> bool:
    """Whether a normalizer surely leaves words of a-z as they are, so that they can go without."""
    if not normalizer:
        return False
    if normalizer["type"] == "Sequence":
        return all(map(_keeps_lower_ascii, normalizer["normalizers"]))
    return normalizer["type"] in ("NFC", "NFKC", "Lowercase") or normalizer["type"] == "Replace" and normalizer["pattern"] == {"Regex": r"\s+"}


def _keeps_letters(pre_tokenizer: dict | None) -> bool:
    """Whether a run of letters is one word before the merges, so that words of a-z need not be split: a pattern of words with an entry for such
    runs, then bytes without a pattern."""
    if not pre_tokenizer or pre_tokenizer["type"] != "Sequence" or len(pre_tokenizer["pretokenizers"]) != 2:
        return False
    split, last = pre_tokenizer["pretokenizers"]
    letters = split["type"] == "Split" and split["invert"] and r"|[\p{L}]+|" in split["pattern"].get("Regex", "")
    return letters and last["type"] == "ByteLevel" and not last["use_regex"] and not last["add_prefix_space"]


def library_table(path: str, special_as_text: bool = False) -> PieceTable:
    """This worker's table of the ids that the library gives."""
    return worker_table(("ids", path, special_as_text), lambda: library_pieces(path, special_as_text))


def encoded_rows(column: pa.Array, table: PieceTable, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], words_only: bool = False, limit: int = STEP_BYTES) -> Iterator[memoryview]:
    """The ids of each text of a column, by pieces, in steps of about `limit` bytes."""
    for _, some in text_steps(column, limit):
        numbers, pieces, before = numbered_pieces(some, cuts, words_only)
        ids, places = gathered(table.values(pieces), numbers)
        at = places[before].tolist()
        for low, high in zip(at[:-1], at[1:], strict=True):
            yield ids[low:high]
