"""Language identification in two levels: first the language family, then one-versus-one linear support vector machines inside it.

Features are hashed byte trigrams of the whole text, letters folded to lower case and everything else to single blanks; square roots of
counts, scaled to length one. Families are a parameter; a language that it doesn't name is a family of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.columns import flat, mix, steps
from tracemill.llm.tables import spread_sample

#: Languages by family (public knowledge), for the codes that are common in web text.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "gu", "pa"),
}
UNKNOWN = "und"
BUCKETS = 4096

#: a-z and bytes of other letters stay, A-Z are lowered, every other byte is a blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of hashed trigram features, for a step of rows at a time, in order."""
    data, offsets = flat(texts)
    for low, high in steps(offsets):
        part, places = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        yield _histogram(part, places)


def _histogram(part: np.ndarray, places: np.ndarray) -> np.ndarray:
    rows = len(places) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    if len(part) < 3:
        return out
    letters = _FOLD[part]
    second = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)) + 1
    letters[second] += 32
    a, b, c = (letters[k : len(letters) - 2 + k].astype(np.uint64) for k in range(3))
    row = np.repeat(np.arange(rows), np.diff(places))
    use = (row[:-2] == row[2:]) & ~((b == 32) & ((a == 32) | (c == 32)))
    bucket = mix((a << np.uint64(16) | b << np.uint64(8) | c)[use]) & np.uint64(BUCKETS - 1)
    out += np.bincount(row[:-2][use] * BUCKETS + bucket.astype(np.int64), minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine (squared hinge loss), by dual coordinate descent. y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    slack = 0.5 / cost
    diagonal = (x * x).sum(axis=1) + slack
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * float(x[i] @ w) - 1 + slack * alpha[i]
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class Duels:
    """One-versus-one machines between classes: the most duels won, then the largest sum of margins, then the first name."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Duels:
        self.pairs = list(combinations(range(len(self.names)), 2))
        if self.pairs:
            chosen = [np.flatnonzero((y == i) | (y == j)) for i, j in self.pairs]
            self.weights = np.stack([svm(x[rows], np.where(y[rows] == i, 1.0, -1.0)) for rows, (i, _) in zip(chosen, self.pairs, strict=True)], axis=1)
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each row, and its confidence from 0.5 to 1: the logistic of its smallest margin over the others."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        wins, total, least = (np.zeros((len(x), len(self.names))) for _ in range(3))
        least += np.inf
        for m, (i, j) in zip(margins.T, self.pairs, strict=True):
            for k, own in ((i, m), (j, -m)):
                wins[:, k] += own >= 0 if k == i else own > 0
                total[:, k] += own
                least[:, k] = np.minimum(least[:, k], own)
        best = np.argmax(wins + 1e-6 * np.tanh(total), axis=1)
        return best, 1 / (1 + np.exp(-2.5 * np.maximum(least[np.arange(len(x)), best], 0)))


@dataclass
class LanguageModel:
    families: Duels
    inside: list[Duels]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language (`und` without a letter) and score of each text."""
        names, scores = [], []
        for x in features(texts):
            family, sure = self.families.predict(x)
            name, score = np.empty(len(x), object), np.zeros(len(x))
            for k, duels in enumerate(self.inside):
                rows = np.flatnonzero(family == k)
                best, inner = duels.predict(x[rows])
                name[rows], score[rows] = np.array(duels.names, object)[best], sure[rows] * inner
            names += name.tolist()
            scores += score.tolist()
        letters = has_letter(texts)
        return [n if ok else UNKNOWN for n, ok in zip(names, letters, strict=True)], [s if ok else 0.0 for s, ok in zip(scores, letters, strict=True)]


def has_letter(texts: pa.Array) -> list[bool]:
    """Whether each text has a character of the Unicode letter categories. Null has none."""
    plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
    return [ok or any(map(str.isalpha, texts[k].as_py() or "")) for k, ok in enumerate(plain)]


def train(labelled: DataFrame, rows_per_language: int = 800, families: dict[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model of the languages in `labelled`, from about `rows_per_language` rows of each, chosen by a hash of the id.

    That bound and the number of languages bound what the driver gets. Rows without text or language are not used. None without rows.
    """
    rows = labelled.select(labelled[id_col].alias("key"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = spread_sample(rows, "key", rows_per_language, "lang").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in features(batch.column("text")):
                places, values = zip(*((np.flatnonzero(r).astype(np.uint16), r[r > 0].astype(np.float16)) for r in x), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, len(x)), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], ["lang", "places", "values"])
                at += len(x)

    found = chosen.mapInArrow(run, "lang string, places binary, values binary").toPandas().sort_values(["lang", "places", "values"], kind="stable")
    if not len(found):
        return None
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, (places, values) in enumerate(zip(found["places"], found["values"], strict=True)):
        x[row, np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float16)
    langs = found["lang"].to_numpy(object)
    family_of = {code: name for name, codes in families.items() for code in codes}
    own = np.array([family_of.get(code, code) for code in langs], object)
    names = sorted(set(own))
    top = Duels(names).fit(x, np.array([names.index(f) for f in own]))
    inside = []
    for name in names:
        rows_of = np.flatnonzero(own == name)
        members = sorted(set(langs[rows_of]))
        inside.append(Duels(members).fit(x[rows_of], np.array([members.index(c) for c in langs[rows_of]])))
    return LanguageModel(top, inside)


def held_out(key) -> object:
    """Column: whether the row is kept out of learning, crc32 of the id as text modulo 4 being 2. A null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The `keep` columns, lang_pred and score of each row, from the text alone.

    `und` and 0 for a null text, a text without a letter, or without a model. Repeated rows are kept; an empty table gives none.
    """
    rows = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shipped.value.predict(batch.column(len(keep))) if shipped.value else ([UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kept}lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, least_score: float = 0.0, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of at least `least_score`; `lang_col`, if named, is a column
    that takes the language. Without a model all stay as they are."""
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place, at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shipped.value.predict(batch.column(place))
            if at is not None:
                columns = [pa.array(names, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
