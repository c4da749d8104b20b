"""Rows that every operator must bear, and helpers."""
import pyarrow as pa

ODD_TEXTS = [
    None, "", " ", "\n", "a", "It's 12 o'clock.", "x  y\t z \r\n w\n\nq ", "<|endoftext|> and <|endoftext|>x", "MIT License", "éÉ ñ ß 日本語 テキスト 字 🙂 ok",
    " a b\x1cc", "the the the the the the", "same text for two rows of the table here", "same text for two rows of the table here", "123 456 !!! ???", "word " * 3000, "z" * 5000,
]


def odd_docs(spark, texts=None):
    """Odd texts with clashing columns of other operators' names."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(k, t, None if k % 5 == 0 else "en", k % 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int").selectExpr("*", "'x' AS sig", "1 AS length", "2 AS node", "'y' AS _text", "0 AS grp")


def arrow(texts):
    return pa.array(texts, pa.string())
