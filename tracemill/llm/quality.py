"""Quality by ordinal regression: one weight vector over hashed text features and ordered thresholds between grades.

P(grade >= k) is the logistic of (weights . features - threshold k), the thresholds ascend. Features of the whole text: hashed words,
hashed four-grams of character classes (upper, lower, digit, blank, other signs as they are), and a few shares.

Toxic prose is like clean prose in all of that but a few words, so the step between these grades has a model of its own: words that toxic
documents have more often than clean ones (marks), and a logistic over which of them a text has. P(grade >= 2) is P(grade >= 1) times that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.columns import ASCII_LOWER, flat, hash_words, mix, steps, table_of, words
from tracemill.llm.tables import spread_sample

WORD_BUCKETS, SHAPE_BUCKETS, SHARES = 3072, 1016, 8
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS + SHARES
#: Grades of `ratings` between which marks decide.
TOXIC, CLEAN = 1, 2
#: Hashes of words among which marks are sought; the least score of a mark, and documents it is in; marks a model has at most.
MARK_BUCKETS, MARK_SCORE, MARK_DOCS, MARKS = 1 << 20, 4.0, 3, 1024
_SEPARATOR = table_of(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Classes of bytes: A upper, a lower and other letters, 0 digit, blank, other signs as they are.
_SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b <= 32 else b for b in range(256)], np.uint8)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of features, for a step of rows at a time, in order."""
    data, offsets = flat(texts)
    for low, high in steps(offsets):
        yield _rows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])


def _unit(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return root / np.maximum(np.sqrt((root * root).sum(axis=1, keepdims=True)), 1e-9)


def _rows(part: np.ndarray, places: np.ndarray) -> np.ndarray:
    rows = len(places) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    lower = ASCII_LOWER[part]
    starts, ends, before = words(lower, places, _SEPARATOR)
    hashes = hash_words(lower, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(before))
    out[:, :WORD_BUCKETS] = _unit(np.bincount(row * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=rows * WORD_BUCKETS).reshape(rows, -1))
    shape = _SHAPE[part]
    of_byte = np.repeat(np.arange(rows), np.diff(places))
    if len(part) >= 4:
        a, b, c, d = (shape[k : len(shape) - 3 + k].astype(np.uint64) for k in range(4))
        use = of_byte[:-3] == of_byte[3:]
        bucket = mix((a << np.uint64(24) | b << np.uint64(16) | c << np.uint64(8) | d)[use]) % np.uint64(SHAPE_BUCKETS)
        out[:, WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = _unit(np.bincount(of_byte[:-3][use] * SHAPE_BUCKETS + bucket.astype(np.int64), minlength=rows * SHAPE_BUCKETS).reshape(rows, -1))
    n_words, n_bytes = np.maximum(np.diff(before), 1), np.maximum(np.diff(places), 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    share = lambda mask, of: np.bincount(of, mask, rows)
    out[:, -SHARES:] = np.stack(
        [
            share(again, row) / n_words,
            share(shape == 65, of_byte) / n_bytes,
            share(shape == 48, of_byte) / n_bytes,
            share(shape == 32, of_byte) / n_bytes,
            share(~np.isin(shape, np.frombuffer(b"Aa0 .,", np.uint8)), of_byte) / n_bytes,
            np.minimum(n_bytes / n_words / 10, 2),
            np.minimum(np.log1p(n_words) / 10, 1),
            (np.diff(before) == 0).astype(float),
        ],
        axis=1,
    )
    return out


def word_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's words, letters A-Z lowered."""
    data, offsets = flat(texts)
    for low, high in steps(offsets):
        part, places = ASCII_LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends, before = words(part, places, _SEPARATOR)
        hashes = (hash_words(part, starts, ends) % np.uint64(MARK_BUCKETS)).astype(np.uint32)
        for a, b in zip(before[:-1], before[1:], strict=True):
            yield np.unique(hashes[a:b])


@dataclass
class OrdinalModel:
    """Weights, thresholds (ascending, one fewer than grades) and the grades, ascending. With both TOXIC and CLEAN among the grades also
    marks (sorted hashes) and the model of CLEAN against TOXIC over them."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    marks: np.ndarray | None = None
    clean: OrdinalModel | None = None

    def text_tails(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Rows as in `tails`, for a step of texts at a time; the tail of CLEAN is by the marks."""
        sets = word_sets(texts) if self.clean else None
        for x in features(texts):
            tails = self.tails(x)
            if sets is not None:
                at = int(np.searchsorted(self.grades, CLEAN))
                clean = self.clean.tails(present([next(sets) for _ in range(len(x))], self.marks))[:, 0]
                tails[:, at - 1] = clean * (tails[:, at - 2] if at > 1 else 1)
            yield tails

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1 on, one column each."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 250, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam steps over all rows. y are grades; one grade gives no thresholds."""
    grades, level = np.unique(y, return_inverse=True)
    steps_ = len(grades) - 1
    w, n = np.zeros(x.shape[1], np.float32), len(x)
    if steps_ < 1:
        return OrdinalModel(w, np.zeros(0, np.float32), grades)
    above = level[:, None] > np.arange(steps_)[None, :]
    part = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    cut = -np.log(part / (1 - part))
    gap = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    state = [np.zeros(len(w) + steps_) for _ in range(2)]
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        theta = gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])
        z = (x @ w).astype(np.float64)[:, None] - theta[None, :]
        tail = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        slope = full * (1 - full)
        high, low = full[rows, level], full[rows, level + 1]
        p = np.maximum(high - low, 1e-9)
        of_z = -(slope[rows, level] - slope[rows, level + 1]) / p / n
        of_theta = np.zeros(steps_)
        for k in range(steps_):
            of_theta[k] = (slope[level == k + 1, k + 1] / p[level == k + 1]).sum() / n - (slope[level == k, k + 1] / p[level == k]).sum() / n
        of_gap = np.array([of_theta.sum(), *(of_theta[k:].sum() * np.exp(gap[k]) for k in range(1, steps_))])
        g = np.concatenate([x.T @ of_z.astype(np.float32) + penalty * w, of_gap])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= move[: len(w)].astype(np.float32)
        gap -= move[len(w) :]
    theta = gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])
    return OrdinalModel(w, theta.astype(np.float32), grades)


def present(sets: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
    """1 for each text (row) that has a mark (column)."""
    return np.stack([np.isin(marks, s, assume_unique=True) for s in sets]).astype(np.float32)


def find_marks(toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """Hashes of words that more toxic than clean documents have, by the score of two shares, sorted."""
    n, m = len(toxic), len(clean)
    of_toxic, of_clean = (np.bincount(np.concatenate(s), minlength=MARK_BUCKETS) for s in (toxic, clean))
    part = (of_toxic + of_clean) / (n + m)
    score = (of_toxic / n - of_clean / m) / np.sqrt(np.maximum(part * (1 - part), 1e-9) * (1 / n + 1 / m))
    score[of_toxic < MARK_DOCS] = 0
    best = np.argsort(-score, kind="stable")[:MARKS]
    return np.sort(best[score[best] >= MARK_SCORE]).astype(np.uint32)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade from (doc_id, quality, toxic): 0 for bad quality, 1 for good but toxic, 2 for good. Several labels of a document
    count with the lowest; labels without id or quality are not used, a null toxic counts as 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, rows_per_grade: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """A model from about `rows_per_grade` rated documents of each grade, chosen by a hash of the id; that bounds what the driver gets.
    None without rated documents. Rated documents without text are not used."""
    chosen = spread_sample(rated.select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade")), "rated_id", rows_per_grade, "grade")
    texts = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).where("text IS NOT NULL")
    # About rows_per_grade rows of each grade, so their size has a bound and the texts need no shuffle.
    rows = texts.join(F.broadcast(chosen), F.col("key") == F.col("rated_id")).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = 0, word_sets(batch.column("text"))
            for x in features(batch.column("text")):
                own = [next(sets).tobytes() for _ in range(len(x))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grade").slice(at, len(x)), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in x], pa.binary()), pa.array([r[r != 0].astype(np.float16).tobytes() for r in x], pa.binary()), pa.array(own, pa.binary())],
                    ["grade", "places", "values", "words"],
                )
                at += len(x)

    found = rows.mapInArrow(run, "grade int, places binary, values binary, words binary").toPandas().sort_values(["grade", "places", "values", "words"], kind="stable")
    if not len(found):
        return None
    x = np.zeros((len(found), BUCKETS), np.float32)
    for row, (places, values) in enumerate(zip(found["places"], found["values"], strict=True)):
        x[row, np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float16)
    y = found["grade"].to_numpy()
    model = fit(x, y)
    if (y == TOXIC).any() and (y == CLEAN).any():
        some = np.flatnonzero((y == TOXIC) | (y == CLEAN))
        sets = [np.frombuffer(found["words"].iloc[k], np.uint32) for k in some]
        model.marks = find_marks([s for s, g in zip(sets, y[some], strict=True) if g == TOXIC], [s for s, g in zip(sets, y[some], strict=True) if g == CLEAN])
        model.clean = fit(present(sets, model.marks), y[some])
    return model


def grade(docs: DataFrame, model: OrdinalModel | None, least_grade: int = 1, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, tail (probability of `least_grade` or more), kept (tail at least `least_tail`), and tail_1 and
    tail_2, the probabilities of grade 1 or more and of grade 2 or more.

    A null text counts as empty. Without a model nothing is known: null grade and tails, and the row is kept. Repeated rows and null ids
    are kept as they are; an empty table gives none; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail, one, two = _scores(shipped.value, batch.column("text"), (least_grade, TOXIC, CLEAN))
            kept = [t is None or t >= least_tail for t in tail]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept, pa.bool_()), pa.array(one, pa.float64()), pa.array(two, pa.float64())], ["doc_id", "expected_grade", "tail", "kept", "tail_1", "tail_2"]
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double, kept boolean, tail_1 double, tail_2 double")


def _scores(model: OrdinalModel | None, texts: pa.Array, least_grades: tuple[int, ...]) -> list[list]:
    """The expected grade of each text, and for each of `least_grades` the probability of that grade or more."""
    out: list[list] = [[] for _ in range(1 + len(least_grades))]
    if model is None:
        return [[None] * len(texts) for _ in out]
    for tails in model.text_tails(texts):
        n = len(tails)
        out[0] += (model.grades[0] + tails @ np.diff(model.grades)).tolist()
        for k, least in enumerate(least_grades, 1):
            at = int(np.searchsorted(model.grades, least))
            out[k] += [1.0] * n if at == 0 else [0.0] * n if at > len(model.thresholds) else tails[:, at - 1].astype(np.float64).tolist()
    return out


def keep_graded(docs: DataFrame, model: OrdinalModel | None, least_grade: int = 1, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose probability of `least_grade` or more is at least `least_tail`. Without a model all stay."""
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tail = _scores(shipped.value, batch.column(place), (least_grade,))
            yield batch.filter(pa.array([t is None or t >= least_tail for t in tail], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
