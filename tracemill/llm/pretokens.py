"""Byte-level BPE by pieces: texts cut where no token can cross, and pieces encoded once a worker.

A text is cut before every blank that stands between two other characters, and before every line end that does. A token never crosses
such a place: white space can only begin a token there, and a single line end is a token of its own. To save a copy of nearly every
piece, its blank is left out: `abc` is the piece " abc", while a line end stays in front, and a carriage return marks the piece that begins the text, which has none.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

#: Pieces a worker keeps; a full cache is emptied.
CACHE_PIECES = 1_000_000
#: Longer pieces are not kept, so that the cache has a bound in bytes.
LONG_PIECE = 64
#: White space of any kind but blanks and line ends, by Python's and by Unicode's list.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Parts of a text whose tokens, put together, are those of the text; none of an empty text. `whole` gives a part's own text."""
    if not text:
        return []
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text):
        out = _CUT.split(text)  # around other white space than single blanks and line ends nothing is cut
    else:
        out = text.replace("\n", " \n").split(" ")
    out[0] = "\r" + out[0]
    return out


def whole(piece: str) -> str:
    """The text that a piece stands for."""
    return piece[1:] if piece[:1] == "\r" else piece if piece[:1] == "\n" else " " + piece


@lru_cache(1)
def library(path: str):
    """The tokenizer of a worker, without padding or truncation."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def library_ids(path: str, parts: list[str]) -> list[bytes]:
    """The ids of each part as the library gives them, as unsigned 32-bit integers."""
    return [array("I", x.ids).tobytes() for x in library(path).encode_batch_fast(parts, add_special_tokens=False)]


class PieceCache:
    """What `encode` gives for the texts of pieces, asked once for each piece, many at a time. `base` is known from the start and never forgotten."""

    def __init__(self, encode: Callable[[list[str]], list], base: dict | None = None, most: int = CACHE_PIECES):
        self.encode, self.base, self.most = encode, base or {}, most
        self.known = dict(self.base)

    def values(self, parts: list[str]) -> list:
        """What `encode` gives for each part."""
        found = list(map(self.known.get, parts))
        if None not in found:
            return found
        if len(self.known) + len(parts) > self.most + len(self.base):
            self.known = dict(self.base)
            found = list(map(self.known.get, parts))
        new = list({x for x, v in zip(parts, found, strict=True) if v is None})
        fresh = dict(zip(new, self.encode(list(map(whole, new))), strict=True))
        self.known.update((x, v) for x, v in fresh.items() if len(x) <= LONG_PIECE)
        return [fresh[x] if v is None else v for x, v in zip(parts, found, strict=True)]


_END = object()
_caches: dict[tuple, PieceCache] = {}


def worker_cache(key: tuple, encode: Callable[[list[str]], list], base: dict | None = None) -> PieceCache:
    """The cache of this worker for one use of one tokenizer; it outlives a task."""
    if key not in _caches:
        _caches[key] = PieceCache(encode, base)
    return _caches[key]




def values_of_texts(cache: PieceCache, texts: Iterable[str | None], step: int = 1 << 18) -> Iterator[tuple[str, list]]:
    """Each text (null as empty) with the values of its pieces; pieces are looked up for about `step` characters of texts at once."""
    some: list[str] = []
    size = 0
    for text in chain(texts, [_END]):
        if text is not _END:
            some.append(text or "")
            size += len(some[-1])
        if size >= step or text is _END:
            cut = [pieces(x) for x in some]
            found = cache.values([p for parts in cut for p in parts])
            at = 0
            for x, parts in zip(some, cut, strict=True):
                yield x, found[at : at + len(parts)]
                at += len(parts)
            some, size = [], 0
