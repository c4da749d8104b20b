"""Near-duplicates, components, shingles and fingerprints against brute force."""
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.rows import ODD_TEXTS, arrow, odd_docs
from tracemill.llm import columns, neardup, sketches
from tracemill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, width, percent):
    sets = {k: shingles(t, width) for k, t in docs}
    keys = list(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(keys, links)
    return {k: (len(sets[k]), found[k], found[k] == k) for k in keys}


def corpus(seed, size):
    """Texts with copies, chains of small edits, a star around one centre, and texts that share a long passage."""
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]

    def edited(words, share):
        return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in words]

    texts, passage, centre = [], fresh(60), fresh(300)
    for _ in range(size):
        kind, base = r.randrange(6), fresh(r.randrange(5, 150))
        if kind == 0:
            texts += [base] * r.randrange(1, 6)
        elif kind == 1:
            for _ in range(r.randrange(2, 7)):
                texts.append(base)
                base = edited(base, 0.02)
        elif kind == 2:
            texts.append(edited(centre, 0.022))
        elif kind == 3:
            texts.append([*passage, *fresh(r.randrange(5, 40))])
        else:
            texts.append(base)
    texts.append(centre)
    r.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


@pytest.mark.parametrize("width,percent,seed", [(3, 85, 1), (5, 80, 2), (1, 85, 3)])
def test_components_equal_brute_force(spark, width, percent, seed):
    docs = corpus(seed, 150)
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs, width, percent)


def test_star_of_copies_that_do_not_link_among_themselves(spark):
    r = random.Random(8)
    centre = [f"w{k}" for k in range(400)]
    docs = [(0, " ".join(centre))] + [(k, " ".join(f"e{k}-{j}" if r.random() < 0.021 else w for j, w in enumerate(centre))) for k in range(1, 250)]
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: v[1] for k, v in brute(docs, 3, 85).items()}


@pytest.mark.parametrize("edits", [False, True])
def test_pairs_in_a_crowd_below_the_threshold(spark, monkeypatch, edits):
    """Texts of one template, each with an end of its own or edits of its own, and pairs that share part of that."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 300_000)
    r, template, docs = random.Random(9), [f"t{k}" for k in range(270)], []
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]

    def changed(words, places):
        return [f"w{r.randrange(10**9)}" if k in places else w for k, w in enumerate(words)]

    for k in range(700):
        one = changed(template, {*r.sample(range(270), 9)}) if edits else template + fresh(29)
        docs.append(one)
        if k < 60:
            docs.append(changed(one, {*r.sample(range(270), 5)}) if edits else one[:-20] + fresh(20))
    r.shuffle(docs)
    docs = [(k, " ".join(t)) for k, t in enumerate(docs)]
    want = brute(docs, 3, 85)
    assert 600 < len({v[1] for v in want.values()}) <= 700
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in rows} == want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = neardup.near_duplicates(docs, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(list(enumerate(ODD_TEXTS)), 3, 85)
    assert not neardup.near_duplicates(docs.limit(0)).collect()
    some = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(some).collect()) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_sets_do_not_depend_on_steps(monkeypatch):
    texts = [*ODD_TEXTS, "q " * 50, "Ab" * 30]
    whole = [s.tolist() for s in neardup._sets(arrow(texts), 3)]
    monkeypatch.setattr(columns, "STEP_BYTES", 16)
    again = []
    for t in texts:
        again += [s.tolist() for s in neardup._sets(arrow([t]), 3)]
    assert whole == again and [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts]
    same = {}
    for t, s in zip(texts, whole, strict=True):
        assert same.setdefault(shingles(t, 3), s) == s
    assert len({tuple(s) for s in whole}) == len(same)


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = (np.frombuffer(neardup.signature(columns.mix(v), 512), ">u4") for v in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.08


def test_connected_components(spark):
    r = random.Random(6)
    links = [(k, k + 1) for k in range(300, 360)] + [(1, k) for k in range(2, 80)] + [(r.randrange(100, 290), r.randrange(100, 290)) for _ in range(120)] + [(7, 7), (None, 3), (400, 400)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def md5_sketch(text, width, below):
    import hashlib

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = {hashlib.md5(" ".join(x).encode()).hexdigest()[:16] for x in runs}
    return sorted(h for h in hashes if h < below) or sorted(hashes)[:1]


@pytest.mark.parametrize("runs", [1, 3, 40])
def test_fingerprints_of_odd_rows(spark, runs):
    texts = [*ODD_TEXTS, *[" ".join(f"w{(k * j) % 97}" for j in range(60)) for k in range(12)]]
    rows = {r.doc_id: r for r in sketches.fingerprints(odd_docs(spark, texts), runs).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        text, after = text or "", texts[k - 1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, other = (md5_sketch(t, 5, "2") for t in (text, edited, after))
        near = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0
        r = rows[k]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), " ".join(own), " ".join(changed))
        assert r.edited_sha256 == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - near(own, changed)) < 1e-12 and abs(r.near_next - near(own, other)) < 1e-12


def test_fingerprints_of_tied_and_missing_ids(spark):
    rows = [(1, "b"), (1, "a"), (None, "n"), (5, "e"), (5, "e")]
    got = sorted((r.doc_id or 0, r.edited_sha256) for r in sketches.fingerprints(spark.createDataFrame([(i, t * 3) for i, t in rows], "doc_id long, text string"), 2).collect())
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    # in order: e e a b n
    assert got == sorted([(5, sha("eee")), (5, sha("eea")), (1, sha("aab")), (1, sha("bbn")), (0, sha("nne"))])
    assert not sketches.fingerprints(spark.createDataFrame([], "doc_id long, text string"), 3).collect()
    assert sketches.fingerprints(spark.createDataFrame([(None, "abc")], "doc_id long, text string"), 3).head().edited_sha256 == sha("aba")


def test_merged_sketches_are_the_sketch_of_both(spark):
    from pyspark.sql import functions as F

    parts = [" ".join(f"x{k}" for k in range(a, b)) for a, b in ((0, 80), (60, 200))]
    row = spark.createDataFrame([(parts[0], parts[1])], "a string, b string").select(sketches.merge(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("m"), sketches.containment(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("c")).head()
    assert row.m == sorted({*md5_sketch(parts[0], 5, "2"), *md5_sketch(parts[1], 5, "2")}) and 0 <= row.c <= 1


def test_more_links_follow_only_those_between_components(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neardup, "components", lambda links: seen.append(links.count()) or components(links))
    first, more = [(1, 2), (3, 4), (4, 5)], [(2, 1), (3, 5), (5, 2), (4, 1), (8, 9)]
    labels = components(spark.createDataFrame(first, "a long, b long"))
    got = neardup._merged(labels, spark.createDataFrame(more, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == roots({1, 2, 3, 4, 5, 8, 9}, first + more) and seen == [3]


def test_pairs_inside_a_component_are_not_formed(spark):
    """Components travel with the classes of a large group; they are not looked up for each pair of neighbours in it."""
    sig = lambda k: bytes(12) + k.to_bytes(4, "big") + bytes(8)
    rows = [(k, sig(k), 0 if k < 90 else k) for k in range(100)]
    classes = spark.createDataFrame(rows, "doc_id long, sig binary, root long")
    pairs, cut = neardup.candidates(classes, 1, 6, 3, 4, 100)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(90, 100) for a in range(b - 4, b)}
    assert {r.node for r in cut.collect()} == {*range(100)}
