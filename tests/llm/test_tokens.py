"""Token counts, BPE and packing against the tokenizers library."""
import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.rows import ODD_TEXTS, odd_docs
from tracemill.llm import bpe, packing, pretokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "\r\n", "'s", "é", "12", "²", "...", "<|endoftext|>", "日本", " ", "\x1c", "﻿", "🙂", " "]), max_size=14).map("".join))
def test_pieces_and_bpe_equal_the_library(text):
    parts = pretokens.pieces(text)
    assert "".join(map(pretokens.whole, parts)) == text
    want = struct.pack(f"<{len(ids_of(text))}I", *ids_of(text))
    encoder = bpe.bpe(PATH)
    for encode in (lambda some: list(map(encoder.encode, some)), lambda some: pretokens.library_ids(PATH, some)):
        assert b"".join(pretokens.PieceCache(encode, most=5).values(parts)) == want
    assert encoder.decode(want).decode() == text


def test_decoding_broken_ids_like_the_library():
    encoder = bpe.bpe(PATH)
    r = random.Random(5)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(6))]
        assert encoder.decode(struct.pack(f"<{len(ids)}I", *ids)).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_cache_gives_the_same():
    texts = [f"word{k % 7} and {'x' * 80}{k}" for k in range(50)]
    cache = pretokens.PieceCache(lambda some: [len(x) for x in some], {"and": 4}, most=3)
    for text, values in pretokens.values_of_texts(cache, texts, step=30):
        assert sum(values) == len(text)
    assert len(cache.known) <= 4


def test_frequent_table_is_the_library_count():
    table = token_counts.frequent_lengths(PATH)
    assert 20_000 < len(table) < 50_257
    for piece in list(table)[::997]:
        assert table[piece] == len(ids_of(" " + piece))


def test_counts_and_round_trip_of_odd_rows(spark):
    docs = odd_docs(spark)
    for r in token_counts.count_tokens(docs, PATH, limit=20).collect():
        text = ODD_TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(ids_of(text)), len(ids_of(text)) > 20)
    for r in bpe.round_trip(docs, PATH).collect():
        text, ids = ODD_TEXTS[r.doc_id] or "", ids_of(ODD_TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for r in bpe.encode_decode(docs, PATH).collect():
        assert r.ids == ids_of(ODD_TEXTS[r.doc_id]) and r.decoded == (ODD_TEXTS[r.doc_id] or "")


def test_empty_table(spark):
    docs = odd_docs(spark).limit(0)
    assert not token_counts.count_tokens(docs, PATH).collect() and not bpe.round_trip(docs, PATH).collect() and not packing.pack_documents(docs, PATH).collect()


def check_packed(rows, texts, capacity, end=0):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for k, found in by_doc.items():
        ids, found = [*ids_of(texts[k]), end], sorted(found, key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(math.ceil(len(ids) / capacity)))
        assert all(r.length == capacity for r in found[1:]) and sum(r.length for r in found) == len(ids)
        at = 0
        for r in found:
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_packing_holds_every_piece_once(spark, group_rows):
    texts = [*ODD_TEXTS, *[" ".join(["w"] * (1 + k * 37 % 60)) for k in range(150)]]
    rows = packing.pack_documents(odd_docs(spark, texts), PATH, capacity=64, group_rows=group_rows).collect()
    used = check_packed(rows, texts, 64)
    need = packing.lower_bound(__import__("numpy").array([r.length for r in rows]), 64)
    assert need <= used <= need * (1.01 if group_rows > 8 else 1.06) + 1


def test_lower_bound_never_exceeds_the_best_packing():
    import numpy as np

    def best(sizes, capacity):
        sizes = sorted(sizes, reverse=True)
        answer = [len(sizes)]

        def place(k, rooms):
            if len(rooms) >= answer[0]:
                return
            if k == len(sizes):
                answer[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                    place(k + 1, [*rooms[:j], rooms[j] - sizes[k], *rooms[j + 1 :]])
            place(k + 1, [*rooms, capacity - sizes[k]])

        place(0, [])
        return answer[0]

    r = random.Random(9)
    tight = 0
    for _ in range(150):
        capacity = r.choice([10, 17, 30])
        sizes = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 9))]
        bound, least = packing.lower_bound(np.array(sizes), capacity), best(sizes, capacity)
        bins, _, fills = packing.best_fit_decreasing(np.array(sizes), capacity)
        assert bound <= least <= len(fills) and fills.max() <= capacity and len(bins) == len(sizes)
        tight += bound == least
    assert tight > 120


def test_groups_stay_small_where_gaps_are_large(spark, monkeypatch):
    """Two of these sizes never fill a sequence well, so every group keeps a gap and frees most of its rows."""
    seen, real = [], packing.materialize

    def counted(df, name, **options):
        out = real(df, name, **options)
        seen.extend(r["count"] for r in out.groupBy("grp").count().collect())
        return out

    monkeypatch.setattr(packing, "materialize", counted)
    rows = spark.range(20_000).selectExpr("id AS uid", "520 + id * 7919 % 480 AS length")
    got = packing.pack(rows, 2048, group_rows=256).collect()
    assert len({r.uid for r in got}) == len(got) == 20_000 and max(seen) < 2 * 256
    lengths = {r.uid: r.length for r in rows.collect()}
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, lengths[r.uid]))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 2048 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert all(r.gap >= 0 for r in got)
