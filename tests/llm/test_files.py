"""WARC bundles, licence scans and media: round trips and brute force."""
import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.rows import ODD_TEXTS, odd_docs
from tracemill.llm import licenses, media, warc
from tracemill.session import checkpoint_dir

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 300), (None, "n", "<p>x</p>"), (7, "s", "z" * 70000), (8, "s", "WARC/1.1\r\n\r\n"), (8, "s", "WARC/1.1\r\n\r\n"), (9, "s", "WARC/1.1\r\n\r\n")]


def expected_pages(rows):
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    out = []
    for i, _, html in rows:
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(same, default=None)
        refers = first if first is not None and first != i else None
        out.append((i or 0, len((html or "").encode()), sha(html), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages)
    assert got.schema["page_id"].dataType.simpleString() == got.schema["refers_to"].dataType.simpleString() == "bigint"
    assert sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == expected_pages(PAGES)
    assert not warc.archive_pages(pages.limit(0)).collect()


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_pages(pages, least_bytes=9).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {9}


def test_one_record_by_its_place(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>" * 40) for k in range(200)], "page_id long, url string, html string").repartition(2)
    folder = f"{checkpoint_dir(spark)}/warc-test"
    index = warc.write_bundles(warc.with_revisits(pages), folder, frame_bytes=2000, bundle_bytes=3000).collect()
    assert len(index) == 200 and len({r.bundle for r in index}) > 2 and len({(r.bundle, r.frame) for r in index}) > 20
    for r in index[::17]:
        header, block = warc.read_record(folder, r.bundle, r.frame, r.record_at, r.record_bytes)
        assert header["WARC-Record-ID"] == r.record_id == warc.record_id(r.page_id)
        assert block.partition(b"\r\n\r\n")[2] == (f"<p>{r.page_id}</p>" * 40).encode()
        assert warc.seek_table(folder, r.bundle)[r.frame] == (r.frame_at, r.frame_bytes, r.plain_bytes)


def test_damage_is_found():
    whole = warc.record("1", "u", b"abc", warc.payload_digest(b"abc"), None, "d")
    assert len(list(warc.parse_records(whole * 2))) == 2
    for broken in (whole[:-1], whole[3:], whole + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def places(words, phrase):
    need = words_of(phrase)
    return [i for i in range(len(words)) if words[i : i + len(need)] == need]


def test_phrases_equal_brute_force():
    scan, r = licenses.Scanner(), random.Random(3)
    vocabulary = ["mit", "license", "apache", "general", "public", "x", "the", "under", "gnu", "released", "this", "work"]
    for _ in range(4000):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(25)))
        words = words_of(text)
        n, found, _ = scan.scan(text)
        assert n == len(words) and sorted(found) == sorted((i, k) for k, (p, _) in enumerate(licenses.PHRASES) for i in places(words, p))


def test_matching_statistics_equal_brute_force():
    scan, r = licenses.Scanner(templates=(("a b c a b d", "one"), ("b c a a", "two"))), random.Random(5)
    runs = {tuple(s[i:j]) for s, _ in scan.sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    step = scan.automaton.step
    for _ in range(3000):
        run = tuple(r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(1, 7)))
        state = 0
        for w in run:
            state = step[state].get(scan.words[w], -1) if state >= 0 else -1
        assert (state >= 0) == (run in runs)
        if state >= 0:
            ends = {(k, i + len(run) - 1) for k, (s, _) in enumerate(scan.sequences) for i in range(len(s)) if tuple(s[i : i + len(run)]) == run}
            assert set(scan.automaton.ends[state]) == ends


def test_spans_survive_small_changes(spark):
    template = licenses.TEMPLATES[1][0]
    words = template.split()
    changed = words[:7] + ["whoever"] + words[8:]
    texts = ["x " + template.upper() + " y", "intro, " + ", ".join(changed) + ".", " ".join(words[:6]), "Licensed under CC BY-NC 4.0.", "cc by", None, ""]
    rows = {r.doc_id: r for r in licenses.scan_licenses(odd_docs(spark, texts)).collect()}
    assert rows[0].labels == rows[1].labels == "mit" and rows[0].base_labels == "" and rows[0].n_base == 0
    assert (rows[0].spans[0].start, rows[0].spans[0].end, rows[0].score) == (1, 1 + len(words), 1.0)
    assert rows[1].score == pytest.approx(1 - 1 / len(words))
    assert rows[2].labels == rows[4].labels == "" and rows[2].score == 0
    assert rows[3].labels == "cc-by-nc"
    assert (rows[5].n_words, rows[5].labels, rows[5].first_word, rows[5].score) == (0, "", None, 0.0) == (rows[6].n_words, rows[6].labels, rows[6].first_word, rows[6].score)


def test_license_query_equals_brute_force(spark):
    from tracemill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_license_scan"](spark, sf).collect():
        words = words_of(texts[r.doc_id])
        found = [(i, label) for p, label in licenses.PHRASES for i in places(words, p)]
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and {*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))}
    odd = licenses.scan_licenses(odd_docs(spark)).collect()
    assert len(odd) == len(ODD_TEXTS) and not licenses.scan_licenses(odd_docs(spark).limit(0)).collect()


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (130, 4)])
def test_pictures_survive(shape):
    samples = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(samples)) == samples).all() and (media.decode(media.encode_bmp(samples)) == samples).all()


def test_other_forms():
    assert media.decode(b"P1 # c\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 1\n3\n0 3\n").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, *[255] * 7, 0]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    bmp24 = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + b"\x03\x02\x01\x00\x06\x05\x04\x00"
    assert media.decode(bmp24).tolist() == [[[4, 5, 6]], [[1, 2, 3]]]
    for broken in (b"", b"P5\n2 2\n255\nabc", b"GIF89a", b"BM12", b"P5 x"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_area_means_are_exact():
    r = np.random.default_rng(3)
    for h, w, a, b in ((8, 9, 8, 9), (16, 18, 8, 9), (5, 7, 3, 2), (3, 4, 8, 9), (media.BAND_ROWS * 2 + 3, 4, 8, 9)):
        x = r.integers(0, 256, (h, w)).astype(float)
        rows = np.array([[max(0, min(i + 1, (k + 1) * h / a) - max(i, k * h / a)) for i in range(h)] for k in range(a)])
        cols = np.array([[max(0, min(j + 1, (k + 1) * w / b) - max(j, k * w / b)) for j in range(w)] for k in range(b)])
        assert np.allclose(media.resize_area(x, a, b), rows @ x @ cols.T / (h / a * w / b))


def test_media_of_odd_rows(spark):
    rows = {r.doc_id: r for r in media.media_digests(odd_docs(spark)).collect()}
    for k, text in enumerate(ODD_TEXTS):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[12].feature == rows[13].feature and rows[0].feature == rows[1].feature
    assert not media.media_digests(odd_docs(spark).limit(0)).collect()


def test_reading_media_tables(spark):
    good = media.encode_bmp(np.arange(256, dtype=np.uint8).reshape(16, 16))
    rows = {r.doc_id: r for r in media.read_media(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary"), side=4).collect()}
    assert (rows[1].height, rows[1].width, bytes(rows[1].samples)) == (16, 16, bytes(range(256)))
    assert np.load(io.BytesIO(rows[1].tile)).shape == (4, 4) and rows[1].dhash == "ff" * 8
    assert rows[2].height is None and rows[3].tile is None
