"""A prefix trie of conversations, with subtree sums by the Euler tour.

A node is a distinct sequence of first turns, told from others of its depth by 128 bits of hash. Nodes whose smallest member is the same conversation form
a downward path, so a node is named by (conv_id, depth). The tour has an enter and an exit arc for each node, and goes down a node's own path
before it visits the other children by conv_id. Arcs that follow each other along one path form a run: one run of enters a path, and one
of exits from each node that has side children. Runs are linked and ranked as a list (`list_rank`); an arc's place is its run's rank plus its place in
the run. Leaves and savings of a subtree are differences of prefix sums at its two arcs.

A hot conversation, node or parent is split everywhere: positions, prefixes and siblings are found on (group, chunk) pieces
(`operators.grouping`), sums are combined before the shuffle, and digests read the ids of a node as sorted pieces of text, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.list_rank import BASE_ROWS, ranks
from tracemill.operators.grouping import id_chunk, nearest_value, number_rows
from tracemill.session import materialize

#: Turns, depths or arcs in one piece of a group, and ids in one piece of text of a digest.
CHUNK, FAN, ID_PIECE = 512, 4096, 4096
#: Conversations of one block share the first turns of the block's first one; at most `HEAD_TURNS` of them.
BLOCK, HEAD_TURNS = 100, 5


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), said (a digest of role and text) and chars of each turn. Null role or text counts as
    empty, rows without a conv_id are left out, equal turns go by `said`, and repeated rows are turns of their own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.length(text).cast("long").alias("chars"))
    chunk = F.coalesce(F.floor(F.col("turn") / F.lit(CHUNK)).cast("long"), F.lit(-(1 << 62)))
    return number_rows(rows, ["conv_id"], chunk, [F.col("turn").asc_nulls_first(), F.col("said")], "pos").drop("turn")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their turns (conv_id, pos, said, chars) rebuilt: the first h turns of the block's first conversation, then
    the own ones after the first h, where h is the CRC-32 of the decimal conv_id modulo 6."""
    turns = materialize(numbered_turns(turns), "turns")
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (HEAD_TURNS + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    convs = own.select("conv_id", "h", "base").distinct()
    first = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") <= HEAD_TURNS)).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", "said", "chars")
    lengths = first.groupBy("base").agg(F.max("pos").alias("most"))
    shift = F.col("pos") - F.col("h") + F.least("h", F.coalesce("most", F.lit(0)))
    tails = own.where("pos > h").join(lengths, "base", "left").select("conv_id", shift.alias("pos"), "said", "chars")
    return convs.select("conv_id"), heads.unionByName(tails)


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the hash of the turns up to each (k1, k2) and of those before it (p1, p2): combined hashes of the turns with their positions."""
    parts = {f"x{n}": F.xxhash64(F.lit(n), F.col("pos"), F.col("said")) for n in (1, 2)}
    rows = turns.withColumns(parts).withColumn("_c", id_chunk("pos", CHUNK)).drop("said")
    inside = Window.partitionBy("conv_id", "_c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "_c").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carry = totals.select("conv_id", "_c", *[F.bit_xor(x).over(before).alias(f"before_{x}") for x in ("x1", "x2")]).where("before_x1 IS NOT NULL")
    rows = rows.withColumns({f"in_{x}": F.bit_xor(x).over(inside) for x in ("x1", "x2")}).join(carry, ["conv_id", "_c"], "left")
    keys = {f"k{n}": F.col(f"in_x{n}").bitwiseXOR(F.coalesce(f"before_x{n}", F.lit(0))) for n in (1, 2)}
    rows = rows.withColumns(keys)
    return rows.select("conv_id", F.col("pos").alias("depth"), "chars", "k1", "k2", *[F.col(f"k{n}").bitwiseXOR(F.col(f"x{n}")).alias(f"p{n}") for n in (1, 2)])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of (depth, k1, k2, conv_id): the digest of the ids of each key, ascending and comma-joined.

    The rows are sorted over all tasks and joined to pieces of `ID_PIECE` ids wherever they lie; one task then reads the pieces of
    a key in order, with nothing but the running digest in memory.
    """
    key = ["depth", "k1", "k2"]

    def runs(columns: list[list]) -> Iterator[tuple[tuple, int, int]]:
        low, keys = 0, list(zip(*columns, strict=True))
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[low]:
                yield keys[low], low, at
                low = at

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("conv_id").to_pylist(), []
            for k, low, high in runs([batch.column(c).to_pylist() for c in key]):
                rows += [(*k, ids[at], ",".join(map(str, ids[at : min(at + ID_PIECE, high)]))) for at in range(low, high, ID_PIECE)]
            yield pa.RecordBatch.from_pydict(dict(zip([*key, "low", "ids"], map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in [*key, "low", "ids"]}, pa.schema([(c, pa.string() if c == "ids" else pa.int64()) for c in [*key, "low", "ids"]]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in key), ("ends_sha256", pa.string())])
        last, state = None, None
        for batch in batches:
            texts, out = batch.column("ids").to_pylist(), []
            for k, low, high in runs([batch.column(c).to_pylist() for c in key]):
                if k != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(texts[low:high]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in enumerate(schema)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*last, state.hexdigest()), schema, strict=True)], schema=schema)

    longs = ends.select(*[F.col(c).cast("long") for c in [*key, "conv_id"]])
    joined = longs.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pieces, "depth long, k1 long, k2 long, low long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "low").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def running_sums(rows: DataFrame, place: str, values: list[str], places: int) -> DataFrame:
    """Adds the sum of each value over all rows up to this one by `place`, a number from 0 below `places`: inside chunks of `FAN` places, plus the sums of the
    chunks before, which are found the same way."""
    if places <= FAN:
        w = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({f"{v}_sum": F.sum(v).over(w) for v in values})
    rows = rows.withColumn("_c", id_chunk(place, FAN))
    totals = rows.groupBy("_c").agg(*[F.sum(v).alias(v) for v in values])
    totals = running_sums(totals.withColumnRenamed("_c", "_at"), "_at", values, -(-places // FAN)).select(F.col("_at").alias("_c"), *[(F.col(f"{v}_sum") - F.col(v)).alias(f"_{v}") for v in values])
    w = Window.partitionBy("_c").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{v}_sum": F.sum(v).over(w) for v in values}).join(totals, "_c")
    return rows.withColumns({f"{v}_sum": F.col(f"{v}_sum") + F.col(f"_{v}") for v in values}).drop("_c", *[f"_{v}" for v in values])


def _run(conv: str | Column, start: str | Column | None = None) -> Column:
    """The name of a run: a conversation's enters, or its exits from the depth `start` up."""
    conv, start = (F.col(c) if isinstance(c, str) else c for c in (conv, start if start is not None else F.lit(None).cast("long")))
    return F.concat(conv.cast("string"), F.coalesce(F.concat(F.lit("^"), start.cast("string")), F.lit("")))


def tour_places(nodes: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """conv_id, depth, entered and left (places of the two arcs in the tour, from 0) of each node of (conv_id, depth, parent_conv_id)."""
    side = F.col("parent_conv_id") != F.col("conv_id")
    tops = nodes.where(side | F.col("parent_conv_id").isNull()).select("conv_id", F.col("depth").alias("top"), "parent_conv_id")
    sides = tops.where("parent_conv_id IS NOT NULL").select("conv_id", F.col("parent_conv_id").alias("at_conv"), (F.col("top") - 1).alias("at_depth"))
    sides = nearest_value(sides, ["at_conv", "at_depth"], F.col("conv_id"), id_chunk("conv_id"), F.col("conv_id"), "sibling", forward=True)
    first = sides.groupBy(F.col("at_conv").alias("conv_id"), F.col("at_depth").alias("start")).agg(F.min("conv_id").alias("child"))
    # A run of exits starts at the end of each path and at each node with side children.
    ends = nodes.groupBy("conv_id").agg(F.max("depth").alias("start"))
    starts = ends.withColumn("last", F.lit(True)).join(first, ["conv_id", "start"], "full")
    starts = nearest_value(starts, ["conv_id"], F.col("start"), id_chunk("start", CHUNK), F.struct("start", "child"), "above")
    starts = materialize(starts.join(tops.select("conv_id", "top"), "conv_id"), "starts")
    low = F.coalesce(F.col("above.start") + 1, F.col("top"))
    after_top = sides.select("conv_id", F.when(F.col("sibling").isNotNull(), _run("sibling")).otherwise(_run("at_conv", "at_depth")).alias("after"))
    exits = starts.join(after_top, "conv_id", "left").select(
        _run("conv_id", "start").alias("id"), F.when(F.col("above").isNotNull(), _run("above.child")).otherwise(F.col("after")).alias("next"), (F.col("start") - low + 1).alias("weight")
    )
    enters = starts.where("last").select(_run("conv_id").alias("id"), F.when(F.col("child").isNotNull(), _run("child")).otherwise(_run("conv_id", "start")).alias("next"), (F.col("start") - F.col("top") + 1).alias("weight"))
    found = ranks(enters.unionByName(exits), base_rows)
    of_path = starts.where("last").select("conv_id", "top", _run("conv_id").alias("id")).join(found, "id").select("conv_id", "top", F.col("rank").alias("enter_rank"))
    of_exit = starts.select("conv_id", "start", _run("conv_id", "start").alias("id")).join(found, "id").select("conv_id", F.col("start").alias("depth"), F.struct("start", "rank").alias("run"))
    arcs = nearest_value(nodes.select("conv_id", "depth").join(of_exit, ["conv_id", "depth"], "left"), ["conv_id"], F.col("depth"), id_chunk("depth", CHUNK), F.col("run"), "exit", forward=True, inclusive=True)
    return arcs.join(of_path, "conv_id").select("conv_id", "depth", (F.col("enter_rank") + F.col("depth") - F.col("top")).alias("entered"), (F.col("exit.rank") + F.col("exit.start") - F.col("depth")).alias("left"))


def prefix_trie(convs: DataFrame, turns: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """The trie of conversations `convs` (conv_id, distinct) with turns (conv_id, pos from 1 without gaps, said, chars).

    Per node: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. No conversation gives no node, not even a root.
    """
    low, count = convs.agg(F.min("conv_id"), F.count("*")).first()
    rows = materialize(prefixes(turns), "prefixes")
    own = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.sparkSession.createDataFrame([(0, 0, 0, low, count, 0, None, None)] if count else [], "depth long, k1 long, k2 long, conv_id long, n_convs long, chars long, p1 long, p2 long")
    own = materialize(own.select(*root.columns).unionByName(root), "nodes")
    parents = own.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = own.join(parents, ["depth", "p1", "p2"], "left").drop("p1", "p2")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in ("depth", "k1", "k2")])
    places = materialize(tour_places(nodes.select("conv_id", "depth", "parent_conv_id"), base_rows), "places")
    worth = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    entered = worth.join(places, ["conv_id", "depth"]).select("conv_id", "depth", F.col("entered").alias("place"), F.lit(-1).alias("sign"), "leaves", "saved")
    arcs = entered.unionByName(places.select("conv_id", "depth", F.col("left").alias("place"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    sums = running_sums(arcs, "place", ["leaves", "saved"], 2 * places.count())
    # What came between the two arcs, and the node's own.
    inside = sums.groupBy("conv_id", "depth").agg(*[F.sum(F.col(v) + F.col("sign") * F.col(f"{v}_sum")).alias(n) for v, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))])
    out = nodes.join(inside, ["conv_id", "depth"]).join(end_digests(ends), ["depth", "k1", "k2"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text); cases as in numbered_turns and prefix_trie. Other columns are not read."""
    convs, turns = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"))
    return prefix_trie(convs, turns, base_rows)


#: The checksum is worked out bit by bit, as DuckDB has none.
ORACLE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos, said, chars
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, ''))::BIGINT AS chars
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), LAMBDA c: ascii(c)::BIGINT)),
      LAMBDA crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), LAMBDA i: i)), LAMBDA x, k: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.pos, said, chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), said, chars
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, pos AS depth, chars, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY depth, k
), parents AS (
  SELECT n.*, (SELECT p.k FROM prefixes p WHERE p.conv_id = n.conv_id AND p.depth = n.depth - 1) AS parent FROM nodes n
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM parents n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.parent
  LEFT JOIN (SELECT depth - 1 AS depth, parent AS k, count(*) AS n FROM parents WHERE depth > 0 GROUP BY 1, 2) c ON c.depth = n.depth AND c.k = n.k
), sums AS (
  SELECT p.depth, p.k, sum((n.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM linked n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k
), ends AS (
  SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM prefixes GROUP BY conv_id) GROUP BY depth, k
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM linked n JOIN sums s ON s.depth = n.depth AND s.k = n.k LEFT JOIN ends e ON e.depth = n.depth AND e.k = n.k
"""
