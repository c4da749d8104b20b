"""First-fit packing and tokenizer alignment against brute force."""
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.rows import ODD_TEXTS, odd_docs
from tracemill.llm import alignment, piece_arrays, tournament
from tracemill.llm.bpe import bpe

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = {x: Tokenizer.from_file(x) for x in (BYTES, WORDS)}
PLAIN = Tokenizer.from_file(BYTES)
PLAIN.encode_special_tokens = True
ENCODERS = {x: piece_arrays.library_pieces(x) for x in LIBRARY}
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MORE = [*ODD_TEXTS, "Wait, what?! e.g. this;that:", "tab\tand odd space 　 x", " ́combining ́ mark", "ΣΑΣ ΟΔΟΣ. İstanbul", "a▁b ▁", "x\x00y \x1f z", "can't, won't; I'LL", "<|startoftext|>Hi<|endoftext|> <s> </s>", ". , .. ,,", "word,word.word;", "\r\n,\n.", "🙂,🙂.", "ab" * 40_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "'s", "é", "12", ",", ".", "...", "<|endoftext|>", "日本", " ", " ", "　", "\x1c", "🙂", "́", "Σ", "à", "€", "\r", "A", "<|EndOfText|>", "\x0b", "I'LL"]), max_size=12).map("".join), max_size=4))
def test_pieces_equal_the_library(texts):
    for path, cuts in ((BYTES, piece_arrays.blank_cuts), (WORDS, piece_arrays.word_cuts)):
        got = [bytes(x) for x in piece_arrays.encoded_rows(pa.array(texts, pa.string()), piece_arrays.PieceTable(ENCODERS[path], most=8), cuts, words_only=path == WORDS)]
        assert got == [np.array(LIBRARY[path].encode(x, add_special_tokens=False).ids, np.uint32).tobytes() for x in texts]


def test_slices_and_nulls():
    column = pa.array([None, "a b", "", "c, d", None], pa.string()).slice(1)
    assert [len(x) // 4 for x in piece_arrays.encoded_rows(column, piece_arrays.library_table(BYTES), piece_arrays.blank_cuts)] == [2, 0, 3, 0]
    assert not list(piece_arrays.encoded_rows(column.slice(4), piece_arrays.library_table(BYTES), piece_arrays.blank_cuts))


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 50), st.data())
def test_first_fit_is_first_fit(capacity, data):
    sizes = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=50)), np.int64)
    bins, offsets, fills = tournament.first_fit_decreasing(sizes, capacity)
    plain: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((k for k, fill in enumerate(plain) if fill + sizes[i] <= capacity), len(plain))
        plain += [0] * (at == len(plain))
        assert (bins[i], offsets[i]) == (at, plain[at])
        plain[at] += sizes[i]
    assert fills.tolist() == plain


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 50), st.data())
def test_parts_cover_rows_without_padding(capacity, data):
    sizes = np.array(data.draw(st.lists(st.integers(1, capacity - 1), max_size=50)), np.int64)
    of_row, of_sequence = defaultdict(list), defaultdict(list)
    for i, start, length, sequence, offset in tournament.packed_parts(sizes, capacity):
        of_row[i].append((start, length))
        of_sequence[sequence].append((offset, length))
    assert sorted(of_row) == list(range(len(sizes)))
    ends = lambda parts: [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
    for i, parts in of_row.items():
        assert [s for s, _ in sorted(parts)] == ends(parts)[:-1] and ends(parts)[-1] == sizes[i]
    for parts in of_sequence.values():
        assert [o for o, _ in sorted(parts)] == ends(parts)[:-1]
        assert ends(parts)[-1] == capacity or ends(parts)[-1].bit_count() == 1


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_packed_documents(spark, group_rows):
    texts = [*MORE, *[" ".join(["w"] * (1 + k * 37 % 60)) for k in range(150)]]
    rows = tournament.pack_first_fit(odd_docs(spark, texts), WORDS, capacity=64, end_id=2, group_rows=group_rows).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    assert sorted(of_doc) == list(range(len(texts)))
    for k, found in of_doc.items():
        ids, at = [*LIBRARY[WORDS].encode(texts[k] or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for found in of_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at.bit_count() == 1
    tokens = sum(r.length for r in rows)
    assert sum(len(x) == 1 and x[0].length == x[0].doc_tokens for x in of_doc.values()) > 0.5 * len([t for t in texts if len(t or "") < 64])
    assert len(of_sequence) <= tokens // 64 + 6 * max(1, 2 * len(texts) // group_rows)


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, "c")], "doc_id long, text string")
    rows = tournament.pack_first_fit(docs, WORDS, capacity=8, end_id=2).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == {None: 2, 7: 2} and sum(r.length for r in rows) == 3 + 3 + 1 + 2
    again = alignment.align_tokenizers(docs, BYTES, PIECES).collect()
    assert sorted((r.doc_id is None, r.n_a, r.n_links, r.n_best, r.count_sum) for r in again) == [(False, 0, 0, 0, 0), (False, 1, 1, 1, 1), (True, 2, 2, 2, 4), (True, 2, 2, 2, 4)]
    assert not tournament.pack_first_fit(docs.limit(0), WORDS).collect() and not alignment.align_tokenizers(docs.limit(0), BYTES, PIECES).collect()


def test_galloping_intersection():
    r = random.Random(3)
    for _ in range(300):
        a, b = (sorted(r.sample(range(1, 60), r.randrange(1, 40))) for _ in range(2))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in a if x in b]


def brute_alignment(texts):
    """Tokens, groups and links of whole texts by the libraries, byte by byte."""
    names_a, docs, counts = bpe(BYTES).bytes_of, [], Counter()
    for text in texts:
        full = (" " + text).encode() if text else b""
        a = PLAIN.encode(" " + text, add_special_tokens=False).ids if text else []
        b = MODEL.encode(text) if text else []
        pieces_b = [bytes([int(x[3:5], 16)]) if MODEL.is_byte(i) else x.replace("▁", " ").encode() for i in b for x in [MODEL.id_to_piece(i)]]
        if b"".join(names_a[i] for i in a) != full or b"".join(pieces_b) != full:
            a, b, pieces_b = [], [], []
        owner_a = [k for k, i in enumerate(a) for _ in names_a[i]]
        owner_b = [k for k, x in enumerate(pieces_b) for _ in x]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(owner_a, owner_b, strict=True))]
        groups, begin = [], 0
        for at in range(len(owner_a)):
            if at + 1 == len(owner_a) or owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1]:
                part = lambda ids, owner: ",".join(str(ids[k]) for k in dict.fromkeys(owner[begin : at + 1]))  # noqa: B023, E731
                groups.append(f"{part(a, owner_a)}|{part(b, owner_b)}")
                begin = at + 1
        docs.append((len(a), len(b), groups, links))
        counts.update(set(links))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in docs
    ]


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_alignment_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    texts = [*MORE, *[f"shared words {k % 3}, don't stop; naïve café {'x' * (k % 5)} 日本{k}" for k in range(40)]]
    rows = alignment.align_tokenizers(odd_docs(spark, texts), BYTES, PIECES).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}
    want = dict(enumerate(brute_alignment(texts)))
    assert sum(x[0] == 0 for x in want.values()) >= 3
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {} and len(rows) == len(texts)
