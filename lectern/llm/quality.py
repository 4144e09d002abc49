"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - s), where s is linear in hashed features of the text with the same weights for
every grade and the thresholds are ordered. The expected grade and the probability of a grade or better select documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lectern.llm.common import hashed, slices, split_words, word_codes

#: Buckets of word shapes, of words, and two of structure (a word repeated at once; no words).
SHAPES, WORDS = 1 << 12, 1 << 13
FEATURES = SHAPES + WORDS + 2
#: At most so many rated rows fit the model. They are chosen among the ratings, before any text is read or moved.
FIT_ROWS = 6_000

_RUNS = re.compile(r"([Aa0])\1+")
_CLASS = {c: "A" for c in map(chr, range(65, 91))} | {c: "a" for c in map(chr, range(97, 123))} | {c: "0" for c in "0123456789"}


def _shape(word: str) -> str:
    """'Hello!!' -> 'Aa!!': runs of a kind of letter become one; letters beyond ASCII count by case."""
    return _RUNS.sub(r"\1", "".join(_CLASS.get(c) or (("A" if c.isupper() else "a") if c.isalnum() else c) for c in word))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its shape and word features and whether it repeats the one before; rows of the words."""
    words, rows = split_words(texts, lower=False)
    codes, distinct = word_codes(words)
    if not len(distinct):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), rows
    shapes = (hashed(pa.array([_shape(w) for w in distinct.to_pylist()])) % np.uint64(SHAPES)).astype(np.int64)
    own = (hashed(distinct) % np.uint64(WORDS)).astype(np.int64) + SHAPES
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    return shapes[codes], own[codes], again, rows


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per rated row its mean features."""
    for batch in batches:
        for part in slices(batch, "text"):
            shapes, own, again, rows = _features(part.column("text"))
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            features, values = [], []
            for i in range(part.num_rows):
                lo, hi = ends[i], ends[i + 1]
                if lo == hi:
                    features.append([SHAPES + WORDS + 1])
                    values.append([1.0])
                    continue
                f, n = np.unique(np.concatenate([shapes[lo:hi], own[lo:hi]]), return_counts=True)
                features.append(np.append(f, SHAPES + WORDS))
                values.append(np.append(n, again[lo:hi].sum()) / (hi - lo))
            columns = [part.column("rated"), part.column("grade"), part.column("h"), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rated", "grade", "h", "f", "x"])


def _gradients(w: np.ndarray, theta: np.ndarray, y: np.ndarray, sparse: tuple[np.ndarray, np.ndarray, np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood of grades y and of ridge / 2 * |w|^2, by the weights and by the thresholds; rows, columns and values are sparse."""
    row, col, val = sparse
    k, n = len(theta) + 1, len(y)
    s = np.bincount(row, w[col] * val, n)
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + d] - s, -40, 40))) for d in (1, 0))
    hi, lo = np.where(y == k - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by its upper and lower edge
    by_weight = np.bincount(col, ((dhi - dlo) / n)[row] * val, len(w)) + ridge * w
    return by_weight, np.array([(dlo[y == j + 1].sum() - dhi[y == j].sum()) / n for j in range(k - 1)])


def fit(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, rounds: int = 300, rate: float = 0.3, ridge: float = 3e-4) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Weights, thresholds and grades from ratings (id, grade) of docs; at most FIT_ROWS ratings, by hash, so the driver's share is bounded."""
    some = ratings.select(F.col(id_col).cast("long").alias("rated"), F.col("grade").cast("int").alias("grade")).where("grade is not null and rated is not null")
    some = some.orderBy(F.xxhash64("rated"), "rated", "grade").limit(FIT_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = texts.join(F.broadcast(some), F.col("id") == F.col("rated")).select("rated", "grade", F.xxhash64("text").alias("h"), "text")
    # an id may have several texts: the bound holds behind the join, too
    told = features.mapInArrow(_sparse, "rated long, grade int, h long, f array<int>, x array<float>")
    rows = told.orderBy(F.xxhash64("rated"), "rated", "grade", "h").limit(FIT_ROWS).toPandas()
    grades = sorted(int(g) for g in rows["grade"].unique())
    if len(grades) < 2:
        return np.zeros(FEATURES), np.zeros(0), grades
    y = np.searchsorted(grades, rows["grade"].to_numpy())
    length = rows["f"].map(len).to_numpy()
    sparse = np.repeat(np.arange(len(rows)), length), np.concatenate(rows["f"].to_list()), np.concatenate(rows["x"].to_list()).astype(np.float64)
    share = np.array([(y <= j).mean() for j in range(len(grades) - 1)])
    w, theta = np.zeros(FEATURES), np.log(share / (1 - share))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, theta)]
    for t in range(1, rounds + 1):
        for x, g, (a, b) in zip((w, theta), _gradients(w, theta, y, sparse, ridge), state, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        theta[:] = np.maximum.accumulate(theta)
    return w, theta, grades


def grade(docs: DataFrame, ratings: DataFrame, at_least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with expected_grade, tail_prob = P(grade >= at_least; by default the best grade) and grade_decided.

    Every column of docs stays (one named like an added column is replaced). Texts without a word, null ones too, get the lowest grade
    and tail 0. With fewer than two grades in the ratings nothing can be told: tail is 1. ratings: id and grade; null ids and
    grades are left out, repeated ratings count again. Rows stay rows, with repeated or null ids too; an empty table gives no rows.
    """
    w, theta, grades = fit(docs, ratings, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((w, theta))
    least = grades[-1] if at_least is None and grades else (at_least or 0)
    from_edge = int(np.searchsorted(grades, least)) - 1  # the threshold below the first grade that counts
    added = ["expected_grade", "tail_prob", "grade_decided"]
    kept = [c for c in docs.columns if c not in added]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                shapes, own, again, rows = _features(part.column(text_col))
                n = np.bincount(rows, minlength=part.num_rows)
                s = np.bincount(rows, w[shapes] + w[own] + again * w[SHAPES + WORDS], part.num_rows) / np.maximum(n, 1)
                above = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -40, 40)))  # P(grade > k)
                steps = np.diff(grades) if len(grades) > 1 else np.zeros(0)
                expected = (grades[0] if grades else 0) + above @ steps
                tail = np.ones(part.num_rows) if from_edge < 0 or not len(theta) else (above[:, from_edge] if from_edge < len(theta) else np.zeros(part.num_rows))
                if len(theta):
                    expected, tail = np.where(n > 0, expected, grades[0]), np.where(n > 0, tail, 0.0)
                decided = np.asarray(grades or [0])[(above >= 0.5).sum(axis=1)] if len(theta) else np.zeros(part.num_rows, int)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(np.where(n > 0, decided, grades[0] if grades else 0), pa.int32())], names=[*kept, *added])

    schema = StructType(docs.select(*kept).schema.fields + [StructField(name, kind) for name, kind in zip(added, (DoubleType(), DoubleType(), IntegerType()), strict=True)])
    return docs.select(*kept).mapInArrow(score, schema)


def selected(docs: DataFrame, ratings: DataFrame, min_tail: float = 0.5, at_least: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose tail probability is min_tail or more."""
    return grade(docs, ratings, at_least, id_col, text_col).where(F.col("tail_prob") >= min_tail).select(*docs.columns)
