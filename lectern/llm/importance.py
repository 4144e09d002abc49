"""Importance resampling towards a target text collection over hashed word features.

Two passes over the documents. The first counts each partition's features into one vector of buckets (np.bincount), which
treeReduce adds up; so does one pass over the target. A bucket's gain compares both. The second pass looks up every feature's gain
and adds up each document's (bincount with weights). Documents are then drawn without replacement by weight: the
highest sums of weight and Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import bounds, slices, split_words, word_codes, written
from lectern.operators.relational import numbered

BUCKETS = 10_000
#: Gains, weights and noise are in thousandths.
UNIT = 1000
#: Documents with fewer words aren't drawn.
LEAST_WORDS = 20
#: Percent of the documents with enough words that are drawn.
PERCENT = 10
SEED = 2024


def _features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of every feature of the texts: runs of 1 to `longest` words, joined by one space."""
    words, rows = split_words(texts, alnum=True)
    codes, names = word_codes(words)
    names = [w.encode() for w in names.to_pylist()]
    table = np.array([crc32(w) % buckets for w in names], np.int64) if names else np.zeros(0, np.int64)
    found, owners = [table[codes]], [rows]
    for size in range(2, longest + 1):
        starts = np.flatnonzero(rows[size - 1 :] == rows[: len(rows) - size + 1]) if len(rows) >= size else np.zeros(0, np.int64)
        grams = np.column_stack([codes[starts + k] for k in range(size)]) if len(starts) else np.zeros((0, size), np.int64)
        distinct, which = np.unique(grams, axis=0, return_inverse=True)
        hashed = np.array([crc32(b" ".join(names[i] for i in g)) % buckets for g in distinct], np.int64)
        found.append(hashed[which.ravel()] if len(hashed) else np.zeros(0, np.int64))
        owners.append(rows[starts])
    return np.concatenate(found), np.concatenate(owners)


def feature_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Null, empty and blank texts have none; an empty table gives zeros.

    Every partition sends one vector of `buckets` longs, and they are added on the executors, as a tree.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_features(part.column("text"), longest, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add)


def gains(own: np.ndarray, target: np.ndarray) -> list[int]:
    """By bucket: floor(1000 ln of how much likelier it is in the target), with one added to every count."""
    s, t, buckets = own.tolist(), target.tolist(), len(own)
    all_own, all_target = sum(s), sum(t)
    return [math.floor(UNIT * math.log((b + 1) * (all_own + buckets) / ((a + 1) * (all_target + buckets)))) for a, b in zip(s, t, strict=True)]


def weighted(docs: DataFrame, gain: list[int], text_col: str = "text", longest: int = 1) -> DataFrame:
    """The rows with n_features, n_words and weight: the mean gain of the features, rounded down; 0 without any."""
    others = [c for c in docs.columns if c.lower() not in ("n_features", "n_words", "weight")]
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    given = f"c{next(i for i, c in enumerate(others) if c.lower() == text_col.lower())}"
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch, given):
                texts, n = part.column(given), len(part)
                found, owners = _features(texts, longest, len(table))
                many = np.bincount(owners, minlength=n)
                # sums of whole numbers below 2 ** 53 are exact in doubles
                sums = np.bincount(owners, weights=table[found], minlength=n).astype(np.int64)
                words = many if longest == 1 else np.diff(bounds(split_words(texts, alnum=True)[1], n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(many), pa.array(words), pa.array(sums // np.maximum(many, 1))], names=[*part.schema.names, "n_features", "n_words", "weight"])

    schema = StructType([*source.schema.fields]).add("n_features", "long").add("n_words", "long").add("weight", "long")
    done = source.mapInArrow(weigh, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), "n_features", "n_words", "weight")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: the id, n_features, weight, score and rank; `percent` of the documents with `least_words` words are drawn and have ranks from 1.

    Words are runs of ASCII digits and letters, A-Z lower-cased, and other characters; features are runs of 1 to `longest` of them, repeats
    counted. score is weight plus Gumbel noise from the first 32 bits of sha256 of "seed:id", in thousandths. Null, empty and blank texts have no
    features and weight 0. Ties go to smaller ids, null ids last; rows of one id share their noise (a null id that of an empty one) and are rows
    of their own. Other columns are left out, whatever their names; the target may be empty; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gain = gains(feature_counts(docs, "text", longest, buckets), feature_counts(target, text_col, longest, buckets))
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(first, 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.floor(-UNIT * F.log(-F.log(uniform)))
    scored = written(weighted(docs, gain, "text", longest).drop("text").withColumn("score", F.col("weight") + noise).withColumn("uid", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    # scores are whole numbers within some ten thousands of 0, so there are few classes of 64
    sizes = {r["c"]: r["n"] for r in able.groupBy(F.floor(F.col("score") / 64).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most, held, cut = percent * sum(sizes.values()) // 100, 0, None
    for c in sorted(sizes, reverse=True):
        if held >= most:
            break
        held, cut = held + sizes[c], c
    if cut is None:
        return scored.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cut * 64)
    drawn = numbered(scored.where(high), [], [F.col("score").desc(), F.asc_nulls_last("id"), F.col("uid")], "rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long"))
