"""Ranking of sessions by the words of a question, with stored postings and bounds.

Each word of a question adds the same to every session that holds it, so what the most common words can add is known before they are read. Words are
read rarest first; once the best sessions found are ahead of all that the words left could add, these are looked up only in the texts of sessions that
are still in the running. No common word is joined with all its sessions unless a question has nothing rarer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import text as T
from tracemill.operators.grouping import top_rows
from tracemill.session import held, materialize

MAX_HITS = 10
#: Entries that the first words of a question may read.
FIRST_ENTRIES = 2000
#: Tokens of a question in one number.
BITS = 62
#: Sessions that are scored in full, for each hit asked for, to know what the best must reach.
TRIES = 4
#: Needles meet words over pieces of this length; shorter needles occur nearly everywhere and come last.
LONG_PIECE, SHORT_PIECE = 5, 3
_PER_WORD, _UNFINISHED = 4, 8
_QUERY = ["tenant_id", "query_id"]


def _field(name: str, summaries: DataFrame) -> Column:
    c = F.col(name)
    c = F.array_join(c, " ") if summaries.schema[name].dataType.typeName() == "array" else c
    return F.lower(F.coalesce(c, F.lit("")))


def _searched(summaries: DataFrame) -> DataFrame:
    return summaries.select("tenant_id", "session_id", *[_field(n, summaries).alias(n) for n, _ in V.RECALL_WEIGHTS])



def build_postings(summaries: DataFrame) -> DataFrame:
    """tenant_id, word and session_id of each lower-case word of the searched fields, once a session. To be stored once for a state of the
    summaries (`store_postings`) and used for any number of questions."""
    words = F.array_distinct(F.split(F.concat_ws(" ", *[n for n, _ in V.RECALL_WEIGHTS]), r"(?U)\s+"))
    return _searched(summaries).select("tenant_id", "session_id", F.explode(words).alias("word")).where("word <> ''")


def store_postings(postings: DataFrame, path: str) -> None:
    """Writes postings in order of tenant and word, so that a reader skips the row groups of other words. A common word goes over many files."""
    order = ["tenant_id", "word", "session_id"]
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def matches(words: DataFrame, needles: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """needle and word of every word (distinct) that contains a needle (distinct), over pieces of `sizes` (descending): a needle's first piece of the
    largest size it has, and all such pieces of a word. Words of all tenants meet here once."""
    size = F.coalesce(*[F.when(F.length("needle") >= s, F.lit(s)) for s in sizes])
    keyed = needles.select("needle", size.alias("size")).where("size IS NOT NULL").withColumn("piece", F.substr("needle", F.lit(1), F.col("size")))

    def pieces(s: int) -> Column:
        last = F.length("word") - (s - 1)
        every = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr("word", i, F.lit(s)))
        return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))

    cut = words.select("word", F.explode(F.array_distinct(F.concat(*[pieces(s) for s in sizes]))).alias("piece"))
    return cut.join(keyed, "piece").where(F.contains("word", F.col("needle"))).select("needle", "word")


def _found(tokens: DataFrame, hits: DataFrame, postings: DataFrame, parts: int) -> DataFrame:
    """tenant_id, query_id, session_id and a bit (in m0, m1, ...) for each token of the question that the session holds."""
    met = tokens.withColumnRenamed("word", "needle").join(hits, "needle")
    masks = [f"m{p}" for p in range(parts)]
    bit = F.lit(1).cast("long")
    of_part = [F.when(F.floor(F.col("pos") / BITS) == p, F.call_function("shiftleft", bit, (F.col("pos") % BITS).cast("int"))).otherwise(0).cast("long").alias(m) for p, m in enumerate(masks)]
    of_word = met.select(*_QUERY, "word", *of_part).groupBy(*_QUERY, "word").agg(*[F.bit_or(m).alias(m) for m in masks])
    of_word = held(materialize(of_word, "asked-words"))  # the postings stay where they are
    return of_word.join(postings, ["tenant_id", "word"]).groupBy(*_QUERY, "session_id").agg(*[F.bit_or(m).alias(m) for m in masks])


def _limits(scored: DataFrame, k: int) -> DataFrame:
    """The k-th best of the scores so far of each question that has as many."""
    best = top_rows(scored, _QUERY, [F.desc("score")], k)
    return best.groupBy(*_QUERY).agg(F.min("score").alias("limit"), F.count("*").alias("sure")).where(F.col("sure") >= k).drop("sure")


def recall(summaries: DataFrame, queries: DataFrame, *, as_of: Column | None = None, k: int = 5, postings: DataFrame | None = None, first_entries: int = FIRST_ENTRIES) -> DataFrame:
    """Best sessions per query (`tenant_id, query_id, query`): whole query in a field, plus four per word found anywhere.

    A field can only hold the whole query where every word was found, so texts meet those pairs alone. A session that matches nothing
    stays at zero and is left out; unfinished and recent sessions get a bonus, so a future date earns more. Of equal scores the newest session
    comes first, by date, time of update and id. `postings` are stored ones of the same summaries; without them they are built.
    """
    k = max(0, min(k, MAX_HITS))
    asked = queries.select(*_QUERY, F.lower(T.strip("query")).alias("query")).where("query <> ''")
    tokens = asked.select(*_QUERY, F.posexplode(F.split("query", r"(?U)\s+")).alias("pos", "word")).where("word <> ''")
    postings = materialize(build_postings(summaries), "postings") if postings is None else postings
    vocabulary = postings.groupBy("tenant_id", "word").agg(F.count("*").alias("n"))
    vocabulary = materialize(vocabulary, "vocabulary")
    known = vocabulary.select("word").distinct()
    hits = materialize(matches(known, tokens.select(F.col("word").alias("needle")).distinct(), (LONG_PIECE, SHORT_PIECE)), "hits")
    cost = hits.join(vocabulary, "word").groupBy("tenant_id", F.col("needle").alias("word")).agg(F.sum("n").alias("cost"))
    unknown = F.when(F.length("word") < SHORT_PIECE, F.lit(1 << 40)).otherwise(0)
    order = Window.partitionBy(*_QUERY).orderBy("cost", "word", "pos")
    ranked = tokens.join(cost, ["tenant_id", "word"], "left").withColumn("cost", F.coalesce("cost", unknown)).withColumns({
        "before": F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.count("*").over(order.rowsBetween(0, Window.unboundedFollowing)) * _PER_WORD,
    })
    ranked = materialize(ranked.withColumn("first", (F.col("before") == 0) | (F.col("before") + F.col("cost") <= first_entries)), "ranked-words")
    parts = 1 + (ranked.agg(F.max("pos")).head()[0] or 0) // BITS
    masks = [f"m{p}" for p in range(parts)]
    found_words = reduce(lambda x, y: x + y, [F.bit_count(m).cast("long") for m in masks])
    facts = summaries.select("tenant_id", "session_id", "status", "date", "updated")
    bonus = F.when(F.col("status").isin("in_progress", "blocked"), _UNFINISHED).otherwise(0)
    newest = F.lit(0)
    if as_of is not None:
        earned = lambda day: F.coalesce(F.greatest(F.lit(0), F.lit(10) - F.least(F.datediff(F.to_date(as_of), day), F.lit(10))), F.lit(0))
        bonus, newest = bonus + earned(F.col("date")), earned(F.max("date"))
    facts = facts.select("tenant_id", "session_id", "date", "updated", bonus.alias("bonus"))
    most = summaries.groupBy("tenant_id").agg((newest + _UNFINISHED).alias("most"))

    asked_words = tokens.groupBy(*_QUERY).agg(F.collect_list("word").alias("unread"))
    texts = _searched(summaries)

    def scored(found: DataFrame) -> DataFrame:
        return found.join(facts.select("tenant_id", "session_id", "bonus"), ["tenant_id", "session_id"]).withColumn("score", found_words * _PER_WORD + F.col("bonus"))

    def looked_up(pairs: DataFrame) -> DataFrame:
        """`score` with what the words of `unread` add that the texts hold, and the fields that hold the whole query if those are all and `complete`."""
        names = [n for n, _ in V.RECALL_WEIGHTS]
        pairs = materialize(pairs, "looked-up")
        wanted = held(materialize(pairs.select("tenant_id", "session_id").distinct(), "looked-up-sessions"))
        look = pairs.join(asked, _QUERY).join(texts.join(wanted, ["tenant_id", "session_id"], "left_semi"), ["tenant_id", "session_id"])
        look = look.withColumn("added", T.let(F.concat_ws(" ", *names), lambda t: F.filter("unread", lambda u: F.contains(t, u))))
        weighed = reduce(lambda a, b: a + b, [F.when(F.contains(n, F.col("query")), w).otherwise(0) for n, w in V.RECALL_WEIGHTS])
        every = F.col("complete") & (F.size("added") == F.size("unread"))
        return look.select(*_QUERY, "session_id", (F.col("score") + F.size("added") * _PER_WORD + F.when(every, weighed).otherwise(0)).alias("score"))

    # The best sessions by the rarest words are scored in full: that is what the words left have to reach.
    opening = F.col("first") & (F.length("word") >= SHORT_PIECE)
    first = materialize(_found(ranked.where(opening).select(*_QUERY, "pos", "word"), hits, postings, parts), "first-words")
    tries = top_rows(scored(first), _QUERY, [F.desc("score")], k * TRIES)
    full = looked_up(tries.select(*_QUERY, "session_id", F.col("bonus").alias("score"), F.lit(True).alias("complete")).join(asked_words, _QUERY))
    limits = materialize(_limits(full, k), "limits")
    judged = ranked.join(limits, _QUERY, "left").join(most, "tenant_id")
    needed = F.col("first") | F.col("limit").isNull() | (F.col("left") + F.col("most") >= F.col("limit"))
    judged = materialize(judged.withColumn("read", needed), "judged-words")
    # Short needles are matched only where a question needs them.
    more = judged.where(F.col("read") & ~opening)
    short = more.where(F.length("word") < SHORT_PIECE).select(F.col("word").alias("needle")).distinct()
    every = hits if short.isEmpty() else hits.unionByName(matches(known, short, tuple(range(SHORT_PIECE - 1, 0, -1))))
    second = _found(more.select(*_QUERY, "pos", "word"), every, postings, parts)
    found = first.unionByName(second).groupBy(*_QUERY, "session_id").agg(*[F.bit_or(m).alias(m) for m in masks])
    # What the words not read could still add, and a whole query where all that were read are there.
    rest = judged.groupBy(*_QUERY).agg(
        F.max("limit").alias("limit"), F.sum(F.when(F.col("read"), 0).otherwise(_PER_WORD)).alias("rest"), F.count(F.when(F.col("read"), 1)).alias("reads"),
        F.collect_list(F.when(~F.col("read"), F.col("word"))).alias("unread"),
    )
    whole = sum(w for _, w in V.RECALL_WEIGHTS)
    complete = found_words == F.col("reads")
    running = scored(found).join(rest, _QUERY).where(
        F.col("limit").isNull() | (F.col("score") + F.col("rest") + F.when(complete, whole).otherwise(0) >= F.col("limit")))
    running = materialize(running.select(*_QUERY, "session_id", "score", "unread", complete.alias("complete")), "running")
    # Texts meet only pairs that have words left to look up, or may hold the whole query.
    open_ = F.col("complete") | (F.size("unread") > 0)
    exact = running.where(~open_).select(*_QUERY, "session_id", "score").unionByName(looked_up(running.where(open_)))
    best = exact.join(facts.drop("bonus"), ["tenant_id", "session_id"]).select(*_QUERY, "session_id", "date", "updated", F.col("score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("date"), F.desc("updated"), F.desc("session_id")]
    return top_rows(best, _QUERY, order, k, rank="position").drop("date", "updated")
