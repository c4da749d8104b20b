"""The prefix trie against a plain trie, and list ranks against a walk."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracemill.llm import prefix_trie
from tracemill.llm.list_rank import ranks

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def said(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """The nodes by plain dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, said(role, text), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns_ in built.items():
        for d in range(len(turns_) + 1):
            members[turns_[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == n))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def some_rows(seed):
    r = random.Random(seed)
    rows = [(c, turn, r.choice(["user", "assistant"]), r.choice("ab") * r.randrange(1, 3)) for c in [0, 3, 7, 100, 105, 199, 250, 400, 401, 402, 403, 404, 1000, 1001] for turn in range(r.randrange(1, 9))]
    rows += [(7, None, None, None), (7, None, None, "é🙂"), (105, 2, "user", "a"), (105, 2, "user", "a"), (250, 3, None, ""), (None, 0, "user", "x"), (-5, 0, "user", "neg"), (-100, 1, "user", "neg")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "base_rows"), [(1, 16_384), (2, 1)])
def test_trie_equals_brute_force(spark, seed, base_rows):
    rows = some_rows(seed)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS id", "2 AS pos")
    assert got(prefix_trie.rebuilt_trie(table, base_rows)) == brute(rows)


def test_long_and_many_conversations(spark, monkeypatch):
    """A long conversation and a hot first turn over several chunks, and ids of one node over several pieces of text."""
    for name in ("CHUNK", "ID_PIECE", "FAN"):
        monkeypatch.setattr(prefix_trie, name, 4)
    rows = [(0, t, "user", f"t{t}") for t in range(40)] + [(200 + 100 * k, t, "user", "same") for k in range(30) for t in range(3)] + [(5, t, "user", f"t{t}") for t in range(12)]
    assert got(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 131)]
    want = brute(rows)
    assert got(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == want and {x[1] for x in want} <= {0, 1}
    assert got(prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_ranks_equal_a_walk(spark):
    r = random.Random(4)
    names = [f"n{k}" for k in range(300)]
    r.shuffle(names)
    weights = [r.randrange(1, 9) for _ in names]
    rows = [(name, names[k + 1] if k + 1 < len(names) else None, weights[k]) for k, name in enumerate(names)]
    table = spark.createDataFrame(rows, "id string, next string, weight long")
    want = {name: sum(weights[:k]) for k, name in enumerate(names)}
    assert {x.id: x.rank for x in ranks(table, 40).collect()} == want
    assert not ranks(table.limit(0)).collect()
