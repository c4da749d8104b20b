"""Document fingerprints by a threshold-scaled sketch: of all shingle hashes, those below a fixed fraction of the range are kept.

Whether a hash is kept depends on nothing but itself, so sketches of parts can be merged, and two sketches compare documents of very
unequal lengths. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle. Hashes are MD5 digests; those whose first hex digit is below this one are kept: an eighth of all.
WIDTH, BELOW = 5, "2"
#: Fixed value: upper and lower letters; other characters keep their case, so that every engine agrees.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that stand between words: ASCII besides digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, width: int = WIDTH, below: str = BELOW) -> Column:
    """Sorted kept shingle hashes of a text, 16 hex digits each. A text of fewer words is one shingle. If no hash of a text is low
    enough, its lowest is kept, so that only texts without words have an empty sketch. Null counts as empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return _let(F.filter(F.split(folded, _BETWEEN), lambda w: w != ""), lambda words: _let(_hashes(words, width), lambda hashes: _kept(hashes, below)))


def _hashes(words: Column, width: int) -> Column:
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, F.lit(width)), " ")), 1, 16))


def _kept(hashes: Column, below: str) -> Column:
    return _let(
        F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < below))),
        lambda low: F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low),
    )


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of either text that both have, 0 to 1; 1 for two texts without words, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of `a` that `b` has too, 0 to 1; 1 if `a` has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next_row(rows: DataFrame, key: str, carried: list[str], ties: list[str], runs: int) -> DataFrame:
    """Adds next_<c> for each of `carried`: its value in the row that follows in descending `key` (then ascending `ties`; null keys last),
    and for the last row that of the first.

    Keys are cut into about `runs` ranges at approximate quantiles, which are keys themselves. The row at a cut opens its range from above,
    so a copy of it closes the range before: the order is never gathered, and every row is shuffled once. One row follows itself.
    """
    probe = rows.agg(F.percentile_approx(key, [k / runs for k in range(1, runs)] or [0.5], 10 * runs).alias("cuts"), F.max(key).alias("top")).head()
    cuts = sorted({*(probe["cuts"] or []), probe["top"]} - {None}) if probe["top"] is not None else []
    chunk = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k : k + chunk] for k in range(0, len(cuts), chunk)]
    kind = rows.schema[key].dataType.simpleString()
    tops = F.array(*[F.lit(b[-1]) for b in blocks]).cast(f"array<{kind}>")
    nested = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]).cast(f"array<array<{kind}>>")
    k = F.col(key)
    # cuts below the key: whole blocks by their tops, then inside the block. Null keys go below all.
    block = F.size(F.filter(tops, lambda x: x < k))
    own = F.coalesce(block * chunk + F.size(F.filter(F.get(nested, block), lambda x: x < k)), F.lit(0)) if cuts else F.lit(0)
    opens = F.coalesce(F.get(F.get(nested, (F.col("_range") / chunk).cast("int")), F.col("_range") % chunk) == k, F.lit(False)) if cuts else F.lit(True)
    above = F.when(F.col("_range") + 1 < len(cuts), F.col("_range") + 1).otherwise(0)
    placed = rows.withColumn("_range", own).withColumn("_at", F.when(opens, F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")), F.struct(above.alias("r"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")))))
    spread = placed.withColumn("_at", F.explode("_at")).withColumns({"_range": F.col("_at.r"), "_guest": F.col("_at.guest")}).drop("_at")
    order = Window.partitionBy("_range").orderBy(F.col("_guest"), F.col(key).desc_nulls_last(), *ties)
    return spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_guest")).drop("_range", "_guest")


def fingerprints(docs: DataFrame, runs: int, width: int = WIDTH, below: str = BELOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the containment
    of the text in its edited form (held_by_edited).

    The edited text has its last third replaced by as many first code points of the next row, in descending doc_id. Rows of one id follow
    each other by text; a row with no other follows itself. A null text counts as empty; null ids come last. An empty table gives none.
    Fingerprints are the sketch's hashes joined by blanks, so texts without words have the empty one. Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text"), width, below))
    rows = with_next_row(rows, "doc_id", ["text", "sketch"], ["text"], runs)
    n = F.char_length("text")
    taken = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - taken)), F.substring(F.col("next_text"), F.lit(1), taken))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), width, below))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.array_join("sketch", " ").alias("fingerprint"),
        F.array_join("edited_sketch", " ").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )


def oracle(width: int = WIDTH, below: str = BELOW) -> str:
    """The same over table `documents` in DuckDB."""
    folded = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"

    def hashes(words: str) -> str:
        return f"CASE WHEN len({words}) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(len({words}) - {width - 1}, 1) + 1), lambda i: substr(md5(array_to_string({words}[i:i + {width - 1}], ' ')), 1, 16)) END"

    def kept(h: str) -> str:
        low = f"list_filter({h}, lambda x: x < '{below}')"
        return f"CASE WHEN len({low}) = 0 AND len({h}) > 0 THEN [list_min({h})] ELSE list_sort(list_distinct({low})) END"

    both = lambda a, b: f"len(list_intersect({a}, {b}))"
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE {both(a, b)}::DOUBLE / (len({a}) + len({b}) - {both(a, b)}) END"
    word_list = lambda t: f"regexp_extract_all({folded.format(t)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (SELECT *, lead(text) OVER o AS follows, first_value(text) OVER o AS opening FROM base WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)),
edited AS (SELECT doc_id, text, coalesce(follows, opening) AS next_text,
  concat(substr(text, 1, length(text) - length(text) // 3), substr(coalesce(follows, opening), 1, length(text) // 3)) AS edited FROM ordered),
worded AS (SELECT *, {word_list("text")} AS w, {word_list("next_text")} AS nw, {word_list("edited")} AS ew FROM edited),
hashed AS (SELECT *, {hashes("w")} AS h, {hashes("nw")} AS nh, {hashes("ew")} AS eh FROM worded),
sketched AS (SELECT *, {kept("h")} AS s, {kept("nh")} AS ns, {kept("eh")} AS es FROM hashed)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, ' ') AS fingerprint,
  array_to_string(es, ' ') AS edited_fingerprint, {near("s", "es")} AS near_edited, {near("s", "ns")} AS near_next,
  CASE WHEN len(s) = 0 THEN 1.0::DOUBLE ELSE {both("s", "es")}::DOUBLE / len(s) END AS held_by_edited
FROM sketched"""
