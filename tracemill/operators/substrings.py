"""Exact "text contains needle" joins as equality joins.

A needle without white space lies inside one white-space-delimited word. So texts are reduced to their distinct words, the
distinct words of the whole corpus are matched to needles over short character grams, and the matches are joined back on the
word. No pair of a text and a needle is formed unless the text contains the needle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def short_text_matches(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: Sequence[str] = ()) -> DataFrame:
    """Rows of `texts` joined with every needle (of the same `on` values) that the short text contains."""
    grams = F.array_distinct(F.concat(*[_grams(F.col(text), n) for n in range(1, GRAM + 1)]))
    keyed = needles.where(F.length(needle) > 0).withColumn("_gram", F.substring(needle, 1, GRAM))
    return texts.withColumn("_gram", F.explode(grams)).join(keyed, [*on, "_gram"]).where(F.contains(text, F.col(needle))).drop("_gram")


def needles_in_texts(texts: DataFrame, ident: Sequence[str], text: Column, needles: DataFrame, needle: str, on: Sequence[str] = ()) -> DataFrame:
    """Distinct (`ident`, needle) pairs where the text contains the needle; needles must hold no white space. `on` names the columns of
    `ident` (a tenant, say) that a needle must share with the text."""
    words = texts.select(*ident, F.explode(F.array_distinct(F.split(text, r"(?U)\s+"))).alias("_word")).where("_word <> ''")
    vocabulary = words.select(*on, "_word").distinct()
    hits = short_text_matches(vocabulary, "_word", needles.select(*on, needle).distinct(), needle, on)
    return words.join(hits, [*on, "_word"]).select(*ident, needle).distinct()
