"""Near-duplicates by an LSH forest: several sorted orders of MinHash signatures, whose neighbours by longest common prefix are candidates.

1. Each text becomes its set of distinct word shingles; equal sets are one class from here on, so copies cost nothing further.
2. `trees` groups of `depth` MinHash values make as many sort keys of a class. Each order is range-partitioned and sorted, ties by a hash,
   so no region is ever one task's. A row meets the `reach` rows before it, as far as the first `least_depth` values agree: the depth adapts,
   as in a dense region the nearest rows agree in more values than in a sparse one.
3. Candidates are confirmed on the full sets. First each class's best candidate; in the end those between classes that still aren't
   connected. For these the orders are sorted once more, with each class's component beside it, so that a pair inside a component is not formed.
4. Two sets that both link to a third have a Jaccard distance of at most twice the allowed one (it is a metric). So a candidate pair that
   failed, but is within that, may still meet in a third: each end is compared with the best-connected classes of the other end's component,
   until nothing new links. This finds a group's centre without comparing all of its members.
5. A row whose reach was cut (the next one still agrees in `least_depth` values) may have missed a partner in its run of such rows. Where
   a run still has classes of several components, those outside its largest one are compared exactly with all of its crowd (runs that
   share classes), block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.columns import ASCII_LOWER, flat, shingle_sets, steps, table_of
from tracemill.llm.components import components
from tracemill.llm.tables import id_and_text
from tracemill.operators.grouping import top_rows
from tracemill.session import discard, materialize

#: Words are runs of other bytes than the blank and tab to carriage return.
SEPARATOR = table_of(b" \t\n\v\f\r")
TREES, DEPTH, LEAST_DEPTH, REACH = 16, 6, 3, 4
#: Best-connected classes of a component that stand for its middle.
CENTRES = 16
#: Rows of a sorted run at least, so that neighbours lie in a run or the next one.
RUN_ROWS = 1000
#: Bytes of sets in a block of a crowd (about, as they are dealt by a hash), and entries of the table a block is compared by.
BLOCK_BYTES, TABLE_ENTRIES = 8 << 20, 1 << 24


@lru_cache(2)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(20240101).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


def signature(hashes: np.ndarray, count: int) -> bytes:
    """MinHash values of a set as big-endian 32-bit numbers, so that bytes sort like values."""
    times, plus = _multipliers(count)
    least = np.full(count, ~np.uint64(0), np.uint64)
    for low in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[low : low + 4096, None] * times + plus).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = flat(texts)
    for low, high in steps(offsets):
        part = ASCII_LOWER[data[offsets[low] : offsets[high]]]
        yield from shingle_sets(part, offsets[low : high + 1] - offsets[low], SEPARATOR, width)


def shingled(rows: DataFrame, width: int, values: int) -> DataFrame:
    """doc_id, n_shingles, two halves of a digest of the set (h1, h2) and sig, `values` MinHash values; sig is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for s in _sets(batch.column("text"), width):
                n.append(len(s))
                digest.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                sig.append(signature(s, values) if len(s) else None)
            halves = np.stack(digest) if digest else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, n_shingles long, h1 long, h2 long, sig binary")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def candidates(classes: DataFrame, trees: int, depth: int, least_depth: int, reach: int, size: int, cuts: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """a, b, hits (orders in which they are neighbours) and lcp (longest common prefix in any) of candidate pairs of (doc_id, sig, root) with
    different roots; `size` is the number of classes. And, if `cuts`, tree, key (the first `least_depth` values) and node of the rows whose
    reach was cut, or may have been, at the borders of tasks."""
    kind = classes.schema["doc_id"].dataType.simpleString()
    orders = classes.select("doc_id", "sig", "root", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    orders = orders.select("tree", F.substring(F.col("sig"), F.col("tree") * (4 * depth) + 1, F.lit(4 * depth)).alias("key"), "doc_id", "root")
    partitions = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * trees // RUN_ROWS))
    # Equal keys come in another order in each tree, so that a class meets other ones of them each time.
    order = ["tree", "key", F.xxhash64("doc_id", "tree"), "doc_id"]
    runs = orders.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "side", "place", "a", "b", "lcp", "tree", "key", "root"]
        number = TaskContext.get().partitionId()
        held: pa.Table | None = None
        seen = 0
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, fresh]) if held else fresh
            old = len(rows) - len(fresh)
            keys = np.frombuffer(b"".join(rows["key"].to_pylist()), ">u4").reshape(len(rows), depth)
            tree, ids = rows["tree"].to_numpy(), rows["doc_id"].combine_chunks()
            root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            cut = np.zeros(len(rows), bool)
            for back in range(1, reach + 2):
                at = np.arange(max(old, back), len(rows))
                same = np.cumprod(keys[at] == keys[at - back], axis=1).sum(axis=1)
                ok = (same >= least_depth) & (tree[at] == tree[at - back])
                if back > reach:
                    cut[at[ok]] = cut[at[ok] - back] = True
                    break
                ok &= root[at] != root[at - back]
                if ok.any():
                    n = int(ok.sum())
                    nothing = pa.nulls(n, pa.int32())
                    yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, ids.take(pa.array(at[ok] - back)), ids.take(pa.array(at[ok])), pa.array(same[ok].astype(np.int32)), nothing, pa.nulls(n, pa.binary()), pa.nulls(n, ids.type)], names)
            if seen <= reach:
                cut[old : old + reach + 1 - seen] = True
            if cuts and cut.any():
                yield _border(rows.filter(pa.array(cut)), number, 2, range(int(cut.sum())), names)
            if seen < reach:
                yield _border(fresh.slice(0, reach - seen), number, 0, range(seen, seen + min(len(fresh), reach - seen)), names)
            seen += len(fresh)
            held = rows.slice(max(0, len(rows) - reach - 1))
        if held is not None:
            if cuts:
                yield _border(held, number, 2, range(len(held)), names)
            held = held.slice(max(0, len(held) - reach))
            yield _border(held, number, 1, range(len(held) - 1, -1, -1), names)

    met = materialize(runs.mapInArrow(meet, f"run int, side int, place int, a {kind}, b {kind}, lcp int, tree int, key binary, root {kind}"), "met")
    heads = met.where("side = 0").select((F.col("run") - 1).alias("run"), "tree", F.col("place").alias("after"), F.col("a").alias("b"), F.col("key").alias("next_key"), F.col("root").alias("next_root"))
    tails = met.where("side = 1").select("run", "tree", F.col("place").alias("before"), "a", "key", "root")
    lcp = reduce(lambda x, y: x + y, (F.when(F.substring("key", 1, 4 * d) == F.substring("next_key", 1, 4 * d), 1).otherwise(0) for d in range(1, depth + 1)))
    across = tails.join(heads, ["run", "tree"]).where((F.col("before") + F.col("after") < reach) & (F.col("root") != F.col("next_root"))).select("a", "b", lcp.cast("int").alias("lcp")).where(F.col("lcp") >= least_depth)
    pairs = met.where("side IS NULL").select("a", "b", "lcp").union(across)
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("hits"), F.max("lcp").alias("lcp"))
    out = materialize(pairs, "candidates")
    cut = materialize(met.where("side = 2").select("tree", F.substring("key", 1, 4 * least_depth).alias("key"), F.col("a").alias("node")).distinct(), "cut") if cuts else None
    discard(met)
    return out, cut


def _border(rows: pa.Table, number: int, side: int, places: range, names: list[str]) -> pa.RecordBatch:
    n = len(rows)
    ids = rows["doc_id"].combine_chunks()
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(list(places)[:n], pa.int32()), ids, pa.nulls(n, ids.type), pa.nulls(n, pa.int32()), rows["tree"].combine_chunks(), rows["key"].combine_chunks(), rows["root"].combine_chunks()], names
    )


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b and linked for those of (a, b) whose sets have a Jaccard similarity of `percent` or more (linked) or of 2 * `percent` - 100 or
    more. Stored."""
    kind = pairs.schema["a"].dataType.simpleString()
    near = max(1, 2 * percent - 100)
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, linked = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                union = len(x) + len(y) - common
                keep.append(100 * common >= near * union)
                linked.append(100 * common >= percent * union)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(linked, pa.bool_()).filter(keep)], ["a", "b", "linked"])

    return materialize(both.mapInArrow(run, f"a {kind}, b {kind}, linked boolean"), "compared")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with those (ra, rb); a node without links is a component by itself."""
    at, bt = (labels.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
    out = pairs.join(at, "a", "left").join(bt, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return out.where("ra <> rb")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after some more links. Only links between different components are followed, each once. Stored."""
    roots = components(_apart(links, labels).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    tops = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    # A linked class without links before was a component by itself.
    nodes = labels.union(roots.join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))
    out = materialize(nodes.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    discard(roots)
    discard(labels)
    return out


def _met(found: DataFrame, met: DataFrame | None, labels: DataFrame) -> DataFrame:
    """one and root of each class that failed a near comparison with another component, each once: what was met before, by the components of
    now, and the failed pairs of the last comparisons alone. Stored."""
    ends = F.array(F.struct(F.col("a").alias("one"), F.col("rb").alias("root")), F.struct(F.col("b").alias("one"), F.col("ra").alias("root")))
    out = _apart(found.where("NOT linked"), labels).select(F.explode(ends).alias("m")).select("m.one", "m.root")
    if met is not None:
        out = out.union(_apart(met.toDF("a", "b"), labels).select(F.col("a").alias("one"), F.col("rb").alias("root")))
    out = materialize(out.distinct(), "ends")
    if met is not None:
        discard(met)
    return out


def _degrees(found: DataFrame, degrees: DataFrame | None) -> DataFrame:
    """node and its links so far. Stored."""
    out = found.where("linked").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    if degrees is not None:
        out = degrees.union(out).groupBy("node").agg(F.sum("links").alias("links"))
    out = materialize(out, "degrees")
    if degrees is not None:
        discard(degrees)
    return out


def _to_centres(met: DataFrame, degrees: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class that failed a near comparison with another component, and that component's best-connected classes."""
    centres = top_rows(degrees.join(labels, "node"), ["root"], [F.desc("links"), F.col("node")], CENTRES).select("root", F.col("node").alias("centre"))
    meets = met.join(centres, "root")
    return meets.select(F.least("one", "centre").alias("a"), F.greatest("one", "centre").alias("b")).where("a <> b").distinct()


def _crowds(cut: DataFrame, labels: DataFrame) -> DataFrame:
    """node, root, crowd and asks of the classes in runs of cut rows that have several components. Runs that share classes are one crowd;
    asks is whether the class is outside the largest component of such a run. Stored."""
    known = cut.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = known.groupBy("tree", "key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("tree", "key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1").select("tree", "key", F.col("most.root").alias("most"))
    rows = materialize(known.join(mixed, ["tree", "key"]), "mixed")
    nodes = rows.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("most")).alias("asks"))
    firsts = rows.groupBy("tree", "key").agg(F.min("node").alias("a"))
    crowd = components(rows.join(firsts, ["tree", "key"]).select("a", F.col("node").alias("b"))).select("node", F.col("root").alias("crowd"))
    out = materialize(nodes.join(crowd, "node"), "crowds")
    discard(rows)
    return out


def _tables(sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of sets, their distinct hashes (sorted) and which set (column) has which hash (row), of `TABLE_ENTRIES` or of one set."""
    low = 0
    while low < len(sets):
        high = min(low + 256, len(sets))
        while True:
            words = np.unique(np.concatenate(sets[low:high]))
            if high == low + 1 or len(words) * (high - low) <= TABLE_ENTRIES:
                break
            high = low + (high - low) // 2
        has = np.zeros((len(words), high - low), np.float32)
        for k in range(low, high):
            has[np.searchsorted(words, sets[k]), k - low] = 1
        yield low, high, words, has
        low = high


def _links(asking: pa.Table, asked: pa.Table, percent: int) -> tuple[list, list]:
    """Links between (node, root, shingles) rows of different components; of each asking row one to a component at least."""
    x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in t["shingles"].combine_chunks()] for t in (asking, asked))
    roots = pa.chunked_array([*asking["root"].chunks, *asked["root"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    x_root, y_root = roots[: len(x)], roots[len(x) :]
    a, b, done = [], [], set()
    for low, high, words, has in _tables(x):
        sizes = np.array([len(s) for s in x[low:high]])
        for k, s in enumerate(y):
            at = np.minimum(np.searchsorted(words, s), len(words) - 1)
            common = has[at[words[at] == s]].sum(axis=0).astype(np.int64)
            for i in np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (x_root[low:high] != y_root[k])).tolist():
                if (low + i, y_root[k]) not in done:
                    done.add((low + i, y_root[k]))
                    a.append(low + i)
                    b.append(k)
    return a, b


def crowd_links(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b and linked (true) of links between components inside each crowd, found by comparing each asking class with all others. Stored.

    Both sides are dealt into blocks of a bounded size; a task compares two of them.
    """
    kind = crowds.schema["node"].dataType.simpleString()
    rows = crowds.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("int")
    bytes_of = F.length("shingles")
    counts = rows.groupBy("crowd").agg(blocks(F.sum(F.when(F.col("asks"), bytes_of).otherwise(0))).alias("ask_blocks"), blocks(F.sum(bytes_of)).alias("all_blocks"))
    rows = rows.join(counts, "crowd").withColumn("dealt", F.xxhash64("node"))
    own, every = F.pmod("dealt", "ask_blocks").cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("asks").select("crowd", own.alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("asking"), "node", "root", "shingles")
    asked = rows.select("crowd", every("ask_blocks").alias("i"), F.pmod("dealt", "all_blocks").cast("int").alias("j"), F.lit(False).alias("asking"), "node", "root", "shingles")

    def meet(block: pa.Table) -> pa.Table:
        left, right = block.filter(block["asking"]), block.filter(pc.invert(block["asking"]))
        a, b = _links(left, right, percent) if len(left) and len(right) else ([], [])
        return pa.table({"a": left["node"].take(pa.array(a, pa.int64())), "b": right["node"].take(pa.array(b, pa.int64())), "linked": pa.array([True] * len(a), pa.bool_())})

    return materialize(asking.union(asked).groupBy("crowd", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}, linked boolean"), "crowd-links")


def linked_classes(rows: DataFrame, classes: DataFrame, width: int, percent: int, trees: int, depth: int, least_depth: int, reach: int) -> DataFrame:
    """node and root of every class that links to another. `rows` has the texts by doc_id, `classes` (doc_id, sig) one row per distinct set."""
    pairs, cut = candidates(classes.withColumn("root", F.col("doc_id")), trees, depth, least_depth, reach, classes.count(), cuts=False)
    ways = pairs.select("a", "b", "hits", "lcp").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "hits", "lcp"))
    best = materialize(ways.groupBy("a").agg(F.max(F.struct("hits", "lcp", "b")).alias("best")).select("a", "best.b"), "best")
    discard(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in _sets(batch.column("text"), width)], pa.binary())], ["doc_id", "shingles"])

    # A merge join at every size: few documents have candidates, but how many grows with the corpus, so they are never broadcast.
    sets = materialize(rows.join(best.select(F.col("a").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(run, f"doc_id {_kind(rows)}, shingles binary"), "sets")
    todo, swept = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried"), False
    discard(best)
    tried = labels = met = degrees = None
    while True:
        tried = todo if tried is None else tried.union(todo)
        found = compared(todo, sets, percent)
        if labels is None:
            labels = components(found.where("linked"))
        elif not found.where("linked").isEmpty():
            labels = _merged(labels, found.where("linked"))
        met, degrees = _met(found, met, labels), _degrees(found, degrees)
        discard(found)
        todo = materialize(_to_centres(met, degrees, labels).join(tried, ["a", "b"], "left_anti"), "tried")
        if todo.isEmpty() and not swept:
            # What is still apart after that: all other candidates. A class without any has none in this order either.
            apart = classes.join(sets.select("doc_id"), "doc_id", "left_semi").join(labels, F.col("doc_id") == F.col("node"), "left")
            apart = materialize(apart.select("doc_id", "sig", F.coalesce("root", "doc_id").alias("root")), "apart")
            pairs, cut = candidates(apart, trees, depth, least_depth, reach, apart.count())
            todo, swept = materialize(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "tried"), True
            discard(apart)
            discard(pairs)
        if todo.isEmpty():
            break
    # Exact, so once is enough: what is still apart now and was cut meets here.
    crowds = _crowds(cut, labels)
    if not crowds.isEmpty():
        found = crowd_links(crowds, sets, percent)
        if not found.isEmpty():
            labels = _merged(labels, found)
    for stored in (met, degrees):
        discard(stored)
    discard(crowds)
    discard(cut)
    discard(sets)
    return labels


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int = TREES,
    depth: int = DEPTH,
    least_depth: int = LEAST_DEPTH,
    reach: int = REACH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that can be reached over links) and kept (whether that is its own).

    A text's set has its distinct shingles of `width` words, letters A-Z lowered; all its words, if they are fewer. Texts link if the sets'
    Jaccard similarity is at least `percent` hundredths. A null text, or one without words, links with nothing. Rows of one id are one
    document; rows without id link with nothing, have no component and are kept. An empty table gives none; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    known = materialize(shingled(rows, width, trees * depth), "shingled")
    solid = known.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = solid.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig")).alias("one")).select("h1", "h2", "one.doc_id", "one.sig")
    classes = materialize(classes, "classes")
    labels = linked_classes(rows, classes.select("doc_id", "sig"), width, percent, trees, depth, least_depth, reach)
    # Rows of one id with different texts are one node: their classes hang together over the id.
    heads = classes.select("h1", "h2", F.col("doc_id").alias("head"))
    placed = known.select("doc_id", "n_shingles", "h1", "h2").join(heads, ["h1", "h2"], "left").join(labels, F.col("head") == F.col("node"), "left")
    empty = F.col("n_shingles") == 0
    component = F.when(F.col("doc_id").isNull(), None).when(empty, F.col("doc_id")).otherwise(F.coalesce("root", "head"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
