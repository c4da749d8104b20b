"""Token counts by a map-side lookup in two tiers.

Tier one is a broadcast table of the tokens that frequent pre-tokens have: the entries of the tokenizer's own vocabulary, which are the
strings that were frequent where it was trained. Its size is that of the vocabulary, whatever the corpus. Tier two is the cache of each
worker: a pre-token that the table misses is encoded by the library once a worker. No pre-token is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.pretokens import library, library_ids, values_of_texts, whole, worker_cache
from tracemill.llm.tables import id_and_text


def frequent_lengths(tokenizer_path: str) -> dict[str, int]:
    """Tokens of each vocabulary entry that can be a whole piece after a blank, as the library encodes it."""
    tokenizer = library(tokenizer_path)
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    table = sorted({x[1:] for x in texts if x[:1] == " " and x[1:] and "\ufffd" not in x and not any(map(str.isspace, x[1:]))})
    return {x: len(ids) // 4 for x, ids in zip(table, library_ids(tokenizer_path, list(map(whole, table))), strict=True)}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than `limit`) of each row.

    A null text counts as empty, with no bytes and no tokens; an empty table gives none; repeated rows and null ids are kept as they
    are; other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(("lengths", tokenizer_path), lambda parts: [len(x) // 4 for x in library_ids(tokenizer_path, parts)], table.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text, lengths in values_of_texts(cache, (x.as_py() for x in batch.column("text"))):
                n_bytes.append(len(text.encode()))
                n_tokens.append(sum(lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
