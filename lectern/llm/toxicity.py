"""Toxicity: class-conditional Kneser-Ney models over the letters of words, compared by their log-likelihoods.

Spark counts, over every labelled training row, how often each class writes a byte after the five before it in the word.
A class's probability is its own discounted count and, for the rest, the Kneser-Ney probability of both classes together,
which backs off to shorter contexts by continuation counts. So rare words, and forms of a word never seen, lean on
shared counts and on parts of words. A word's evidence is the difference of its two log-likelihoods. A document's is
normalised by length: the mean over all its words, the mean of what words have beyond each of MARGINS and, as a few clear
expressions drown in a long neutral text, the greatest mean of that over a window of each of WINDOWS words. Windows run
around the end of a text to its beginning, so how often a text repeats doesn't matter, and a text's length is no feature. A logistic regression turns them into a score.
It is cross-fitted: a model of one half of the training rows is measured on rows of the other half, and the model that
scores counts both.

The model is two tables that grow with the counted strings: the difference of the log-probabilities of each six-byte
string, and of an unseen byte by context (there the shared part cancels). Tables of MODEL_STRINGS rows or fewer are sent
to the tasks; beyond that the distinct words of the documents are joined with them. Both give the same evidence: no
counted string is left out, none takes another's value, and values are multiples of 1 / SCALE, whose sums are exact in any
order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounds, checked_broadcast, joined_back, slices, split_words, word_codes, written

ORDER = 6
DISCOUNT = 0.75
#: How far a word's difference goes beyond neutral: 1 is 2.7 times as likely in toxic texts, 4 is 55 times.
MARGINS = (1.0, 2.0, 4.0)
#: So many consecutive words have the greatest mean of what goes beyond a margin.
WINDOWS = (8, 64, 512)
#: Values are rounded to multiples of 1 / SCALE.
SCALE = 65536.0
#: At most so many labelled rows calibrate the score.
CALIBRATION_ROWS = 20_000
#: Rows of the tables that are sent to every executor, 12 bytes each.
MODEL_STRINGS = 8_000_000

_FEATURES = ["mean", *(f"over{m:g}{w}" for m in MARGINS for w in ("", *(f"_{w}" for w in WINDOWS)))]


def _strings(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the words, and their ends, with the five bytes before it as one number; the word of each."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(off)
    at = off[:-1] - off[0] + ORDER * np.arange(len(words))  # a word's place: four zeros, a 1, its bytes, a 2
    stream = np.zeros(int(size.sum()) + ORDER * len(words), np.uint64)
    stream[at + 4] = 1
    stream[at + 5 + size] = 2
    owner = np.repeat(np.arange(len(words)), size)
    stream[np.arange(int(size.sum())) + ORDER * owner + 5] = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(owner) else 0
    keys = np.zeros(max(0, len(stream) - 5), np.uint64)
    for j in range(ORDER):
        keys = (keys << np.uint64(8)) | stream[j : len(stream) - 5 + j]
    told = np.repeat(at, size + 1) + np.arange(int(size.sum()) + len(words)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return keys[told], np.repeat(np.arange(len(words)), size + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice its strings, and how often rows of each half and class write them."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, rows = split_words(part.column("text"), alnum=True)
            codes, distinct = word_codes(words)
            if not len(distinct):
                continue
            own = (part.column("half").to_numpy(zero_copy_only=False) * 2 + part.column("toxic").to_numpy(zero_copy_only=False))[rows]
            keys, owner = _strings(distinct)
            some, place = np.unique(keys, return_inverse=True)
            n = [np.bincount(place, np.bincount(codes[own == c], minlength=len(distinct))[owner], len(some)) for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], names=["k", "a0", "a1", "b0", "b1"])


def _looked_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the table has each string, and its value or 0."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys.astype(np.int64)), len(known) - 1)
    there = known[at] == keys.astype(np.int64)
    return there, np.where(there, value[at], np.float32(0))


def _table(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n rows (k, value) as sorted strings and their values; the driver gets them in packed batches."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, value = batch.column("k").to_numpy(), (np.rint(batch.column("value").to_numpy() * SCALE) / SCALE).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())], names=["k", "vals"])

    at = 0
    known, value = np.zeros(n, np.int64), np.zeros(n, np.float32)
    for r in rows.select("k", "value").mapInArrow(packed, "k binary, vals binary").toLocalIterator():
        k = np.frombuffer(r["k"], np.int64)
        known[at : at + len(k)], value[at : at + len(k)] = k, np.frombuffer(r["vals"], np.float32)
        at += len(k)
    order = np.argsort(known)
    return known[order], value[order]


@dataclass
class Model:
    """Log-probability differences (k, value) of strings and, for unseen bytes, of contexts; `sent` has them for tasks, if they are few enough."""

    strings: DataFrame
    unseen: DataFrame
    sent: Broadcast | None


def counts(train: DataFrame) -> DataFrame:
    """A written table (k, a0, a1, b0, b1): how often each string is in rows (text, toxic 0 or 1, half 0 or 1) of half a and b, and class 0 and 1."""
    rows = train.select("text", "toxic", "half").mapInArrow(_counted, "k long, a0 long, a1 long, b0 long, b1 long")
    return written(rows.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1"))))


def fit(grams: DataFrame, most: int = MODEL_STRINGS) -> Model | None:
    """The model of strings (k, n0, n1), counted in class 0 and 1; None unless both classes have some."""
    grams = grams.where("n0 + n1 > 0")
    seen = grams.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).first()
    if not seen["a"] or not seen["b"]:
        return None
    less = lambda n: F.greatest(n - DISCOUNT, F.lit(0.0))
    tail = lambda size: F.col("k").bitwiseAND((1 << (8 * size)) - 1)

    # shared: strings of two and four bytes by the distinct bytes before them, of six by counts of both classes
    four = grams.groupBy(tail(4).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    two = four.groupBy(tail(2).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def backed(rows: DataFrame, lower: DataFrame | None, size: int) -> DataFrame:
        """Rows (k, n) with the probability p of k's last byte after the ones before."""
        context = rows.groupBy(F.shiftright("k", 8).alias("h")).agg(F.sum("n").alias("all"), F.sum(less(F.col("n"))).alias("mass"))
        out = rows.withColumn("h", F.shiftright("k", 8)).join(context, "h")
        if lower is None:
            out = out.withColumn("q", F.lit(1 / 256))
        else:
            out = out.withColumn("s", tail(size - 2)).join(lower.select(F.col("k").alias("s"), F.col("p").alias("q")), "s")
        return out.select("k", ((less(F.col("n")) + (F.col("all") - F.col("mass")) * F.col("q")) / F.col("all")).alias("p"))

    shared = backed(grams.select("k", (F.col("n0") + F.col("n1")).alias("n")), backed(four, backed(two, None, 2), 4), 6)
    both = [f(F.col(f"n{c}")).alias(f"{t}{c}") for c in (0, 1) for f, t in ((F.sum, "all"), (lambda n: F.sum(less(n)), "mass"))]
    context = grams.groupBy(F.shiftright("k", 8).alias("h")).agg(*both)
    left = lambda c: F.when(F.col(f"all{c}") > 0, (F.col(f"all{c}") - F.col(f"mass{c}")) / F.col(f"all{c}")).otherwise(F.lit(1.0))
    context = written(context.select("h", "all0", "all1", left(0).alias("left0"), left(1).alias("left1")))
    own = lambda c: less(F.col(f"n{c}")) / F.greatest(F.col(f"all{c}"), F.lit(1)) + F.col(f"left{c}") * F.col("p")
    told = grams.join(shared, "k").withColumn("h", F.shiftright("k", 8)).join(context, "h")
    strings = written(told.select("k", F.log(own(1) / own(0)).alias("value")))
    unseen = written(context.select(F.col("h").alias("k"), F.log(F.col("left1") / F.col("left0")).alias("value")))
    n, m = strings.count(), unseen.count()
    sent = grams.sparkSession.sparkContext.broadcast([*_table(strings, n), *_table(unseen, m)]) if n + m <= most else None
    return Model(strings, unseen, sent)


def _means(x: np.ndarray, rows: np.ndarray, n: int, windows: tuple[int, ...]) -> list[np.ndarray]:
    """Per row of n the mean of its words' values, and the greatest mean of each number of consecutive ones; 0 without words. rows is sorted."""
    out = [np.zeros(n) for _ in range(len(windows) + 1)]
    if not len(rows):
        return out
    ends = bounds(rows, n)
    some = np.flatnonzero(np.diff(ends))
    first, size = ends[some], np.diff(ends)[some]
    sums = np.concatenate([[0.0], np.cumsum(x)])
    total = sums[first + size] - sums[first]
    out[0][some] = total / size
    at, begin, stop = np.arange(len(rows)), np.repeat(first, size), np.repeat(first + size, size)
    for w, best in zip(windows, out[1:], strict=True):
        # w words around the ring are some whole rounds and a stretch shorter than the text
        rounds, rest = np.divmod(w, size)
        to = at + np.repeat(rest, size)
        behind = sums[np.minimum(to, stop)] - sums[at]
        around = sums[begin + np.maximum(to - stop, 0)] - sums[begin]
        best[some] = (rounds * total + np.maximum.reduceat(behind + around, first)) / w
    return out


def _features(diff: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """_FEATURES per row of n, from the differences of its words in order: means, on scales that suit a linear score."""
    out = _means(diff, rows, n, ())
    for m in MARGINS:
        whole, *best = _means(np.maximum(diff - m, 0), rows, n, WINDOWS)
        out += [np.sqrt(whole), *(np.log1p(w * x) for w, x in zip(WINDOWS, best, strict=True))]
    return out


def _by_tables(model: Model, docs: DataFrame) -> DataFrame:
    kept, sent = [c for c in docs.columns if c != "text"], model.sent

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, contexts, context_value = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = split_words(part.column("text"), alnum=True)
                codes, distinct = word_codes(words)
                keys, owner = _strings(distinct)
                there, each = _looked_up(keys, known, value)
                each = np.where(there, each, _looked_up(keys >> np.uint64(8), contexts, context_value)[1])
                values = _features(np.bincount(owner, each, len(distinct))[codes], rows, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, values)], names=[*kept, *_FEATURES])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(add, ", ".join([*kinds, *(f"{c} double" for c in _FEATURES)]))


def _by_join(model: Model, docs: DataFrame) -> DataFrame:
    """As _by_tables, for tables of any size: words get their differences by joins, documents those of their words with their places."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = split_words(part.column("text"), alnum=True)
                codes, distinct = word_codes(words)
                pair = rows * max(1, len(distinct)) + codes
                order = np.argsort(pair, kind="stable")
                pair, start = np.unique(pair[order], return_index=True)
                row, word = (pa.array(x) for x in np.divmod(pair, max(1, len(distinct))))
                place = order - bounds(rows, part.num_rows)[rows[order]]
                places = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)).astype(np.int32)), pa.array(place.astype(np.int32)))
                columns = [part.column("id").take(row), part.column("h").take(row), distinct.take(word).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, places], names=["id", "h", "word", "places"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                keys, owner = _strings(part.column("word"))
                yield pa.RecordBatch.from_arrays([part.column("word").take(pa.array(owner)), pa.array(keys.astype(np.int64))], names=["word", "k"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a document at a time
                one = batch.slice(i, 1)
                told = one.column("told").flatten()
                diff, places = told.field("diff").to_numpy(zero_copy_only=False), told.field("places")
                order = np.argsort(pc.list_flatten(places).to_numpy(zero_copy_only=False))
                each = np.repeat(diff, pc.list_value_length(places).to_numpy(zero_copy_only=False))[order]
                values = _features(each, np.zeros(len(each), np.int64), 1)
                yield pa.RecordBatch.from_arrays([one.column("i"), one.column("g"), *map(pa.array, values)], names=["i", "g", *_FEATURES])

    rows = docs.withColumn("h", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    # rows of one id and text have the same words
    told = written(rows.select("id", "h", "text").mapInArrow(tell, f"id {kind}, h long, word string, places array<int>").dropDuplicates(["id", "h", "word"]))
    words = told.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    letters = written(words.select("word").mapInArrow(spell, "word string, k long").withColumn("c", F.shiftright("k", 8)))
    fixed = lambda c: F.rint(F.col(c) * SCALE) / SCALE

    def valued(rows: DataFrame, table: DataFrame, key: str, out: str) -> DataFrame:
        """rows with the table's value of each key, 0 without; many words begin alike, so a hot key's rows stay where they are."""
        keys = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return joined_back(rows, written(keys.join(table.select(F.col("k").alias(key), fixed("value").alias(out)), key, "left")), [key])

    spelt = valued(valued(letters, model.strings, "k", "own"), model.unseen, "c", "unseen")
    value = spelt.groupBy("word").agg(F.sum(F.coalesce("own", "unseen", F.lit(0.0))).alias("diff"))
    each = joined_back(told, written(words.join(value, "word")), ["word"])
    found = each.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_list(F.struct("diff", "places")).alias("told"))
    found = found.mapInArrow(gather, f"i {kind}, g long, " + ", ".join(f"{c} double" for c in _FEATURES))
    whole = rows.drop("text").join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return whole.select(*(c for c in docs.columns if c != "text"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in _FEATURES))


def evidence(model: Model | None, docs: DataFrame) -> DataFrame:
    """docs (id, text and others) with _FEATURES in the place of the text; zeros without a model."""
    if model is None:
        return docs.drop("text").withColumns({c: F.lit(0.0) for c in _FEATURES})
    return (_by_tables if model.sent else _by_join)(model, docs)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", most: int = MODEL_STRINGS) -> DataFrame:
    """Per document: id, held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Rows with crc32(id as text) mod 3 = 1 are held out. The labelled others, all of them, count the model that scores; the
    calibration measures rows of remainder 2 with a model of remainder 0. Only the text is scored. Null and empty texts get the
    score of no evidence; null or other labels are left out; repeated labels count again; with labels of one class only every
    score is 0.5. Other columns are left out; ids may repeat, and a null id isn't held out. An empty table gives no rows.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 3
    marked = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("long"), fold.alias("fold"))
    marked = marked.where("toxic in (0, 1) and fold <> 1 and id is not null")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = texts.join(checked_broadcast(written(marked)), "id").withColumn("half", (F.col("fold") == 2).cast("long"))
    grams = counts(known)
    half = fit(grams.select("k", F.col("a0").alias("n0"), F.col("a1").alias("n1")), most)
    whole = fit(grams.select("k", (F.col("a0") + F.col("b0")).alias("n0"), (F.col("a1") + F.col("b1")).alias("n1")), most)

    order = (F.xxhash64("id"), "id", "toxic")
    some = marked.where("fold = 2").select("id", "toxic").orderBy(*order).limit(CALIBRATION_ROWS)
    told = evidence(half, texts.join(F.broadcast(some), "id"))
    seen = told.orderBy(*order, *_FEATURES).limit(CALIBRATION_ROWS).toPandas()  # an id may have several texts
    if half is None or whole is None or seen["toxic"].nunique() < 2:
        beta = [0.0] * (len(_FEATURES) + 1)
    else:
        beta = _logistic(seen[_FEATURES].to_numpy(), seen["toxic"].to_numpy()).tolist()
    z = F.lit(beta[-1])
    for b, x in zip(beta, _FEATURES, strict=False):
        z = z + b * F.col(x)
    scored = evidence(whole, texts.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))))
    scored = scored.select(F.col("id").alias(id_col), "held_out", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
