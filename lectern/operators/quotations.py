"""Quotations: runs of words that passages share, found by n-grams of a bounded document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.similarity import quotation_score, relation_kind
from lectern.functions.text import gram_hashes, quotation_words
from lectern.operators.relational import islands
from lectern.sources.shared import discard, written

#: Grams are dealt by hash into so many rounds, one after another, so that a part of the postings is on disk at a time.
ROUNDS = 8


def postings(passages: DataFrame, n: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gram, at): a 64-bit hash of each n-gram of each passage, at its first word's place from 0."""
    # a column of word hashes, so that they aren't computed for each gram
    words = passages.select(F.col(id_col).alias("id"), F.transform(quotation_words(text_col), lambda w: F.xxhash64(w)).alias("hashes"))
    return words.select("id", F.posexplode(gram_hashes(F.col("hashes"), n)).alias("at", "gram")).select("id", "gram", "at")


def shared(posts: DataFrame, most: int = 8, occurrences: bool = False) -> DataFrame:
    """The postings of grams that 2 to `most` passages have (or, with `occurrences`, that occur so often), with their df.

    A gram's least and greatest passage are aggregated before anything is shuffled, so what one passage has alone goes
    at once, and neither a stock phrase nor a long passage is gathered anywhere.
    """
    if occurrences:
        common = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, most))
        return posts.join(common, "gram")
    spread = posts.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("gram")
    met = posts.join(spread, "gram", "left_semi")
    common = met.groupBy("gram").agg(F.countDistinct("id").alias("df")).where(F.col("df").between(2, most))
    return met.join(common, "gram")


def _grams_of(stored: DataFrame, n: int, part: int, parts: int) -> DataFrame:
    """postings() of one of several parts of all grams, from stored rows (id, hashes) of word hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(flat) - n + 1
            if size <= 0:
                continue
            gram = np.zeros(size, np.uint64)
            for j in range(n):  # wraps around
                gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + size]
            gram = (gram ^ (gram >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            gram ^= gram >> np.uint64(29)
            held = np.flatnonzero((row[:size] == row[n - 1 :]) & (gram % np.uint64(parts) == part))
            first = np.searchsorted(row, np.arange(batch.num_rows))
            of = row[held]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), pa.array(gram[held].view(np.int64)), pa.array((held - first[of]).astype(np.int32))], ["id", "gram", "at"])

    return stored.mapInArrow(each, f"id {stored.schema['id'].dataType.simpleString()}, gram long, at int")


def common(passages: DataFrame, n: int = 6, most: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> list[DataFrame]:
    """shared() postings of all passages as written tables, one a round: words are hashed and stored once, and a round deals its grams by a single shuffle."""
    hashes = passages.select(F.col(id_col).alias("id"), F.transform(quotation_words(text_col), lambda w: F.xxhash64(w)).alias("hashes"))
    stored = written(hashes.where(F.size("hashes") >= n))
    out = []
    for part in range(rounds):
        posts = _grams_of(stored, n, part, rounds)
        own = Window.partitionBy("gram")
        met = posts.withColumns({"lo": F.min("id").over(own), "hi": F.max("id").over(own)}).where("lo < hi").drop("lo", "hi")
        # passages of a gram are numbered, but rows without an id, which come first
        numbered = met.withColumn("nth", F.dense_rank().over(own.orderBy("id")))
        df = F.max("nth").over(own) - F.max(F.col("id").isNull().cast("int")).over(own)
        out.append(written(numbered.withColumn("df", df.cast("long")).where(F.col("df").between(2, most)).drop("nth").select("gram", "id", "at", "df")))
    discard(stored)
    return out


def worded(common: DataFrame, passages: DataFrame, n: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grams of shared() in words: gram, occurrences and passages; the words are read at one place of each."""
    told = common.groupBy("gram").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("occurrences"), F.max("df").alias("passages"))
    places = told.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "occurrences", "passages")).alias("g"))
    words = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(places, "id").select(quotation_words("text").alias("words"), "g")
    each = words.select("words", F.explode("g").alias("g"))
    return each.select(F.array_join(F.slice("words", F.col("g.at") + 1, n), " ").alias("gram"), "g.occurrences", "g.passages")


def runs(posts: DataFrame, n: int = 6) -> DataFrame:
    """Maximal runs of shared words of two passages: a, b, start_a, start_b, length in words."""
    a = posts.select("gram", F.col("id").alias("a"), F.col("at").alias("start_a"))
    b = posts.select(F.col("gram").alias("g"), F.col("id").alias("b"), F.col("at").alias("start_b"))
    met = a.join(b, (F.col("gram") == F.col("g")) & (F.col("a") < F.col("b"))).select("a", "b", "start_a", "start_b")
    return islands(met, ["a", "b"], "start_a", "start_b").select("a", "b", "start_a", "start_b", (F.col("steps") + n - 1).alias("length"))


def scored(found: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_id: str = "source", place: str = "lang") -> DataFrame:
    """Per pair: longest run, words of all runs, score and kind of relation."""
    pairs = found.groupBy("a", "b").agg(F.max("length").alias("longest"), F.sum("length").alias("total"), F.count(F.lit(1)).alias("runs"))
    facts = passages.select(F.col(id_col).alias("id"), F.col(text_id).alias("t"), F.col(place).alias("p"))
    a = facts.select(F.col("id").alias("a"), F.col("t").alias("text_a"), F.col("p").alias("place_a"))
    b = facts.select(F.col("id").alias("b"), F.col("t").alias("text_b"), F.col("p").alias("place_b"))
    both = pairs.join(a, "a").join(b, "b")
    score = quotation_score(F.col("longest"), F.col("total"))
    kind = relation_kind(F.col("text_a"), F.col("text_b"), F.col("place_a"), F.col("place_b"))
    return both.select("a", "b", "text_a", "text_b", "longest", "total", "runs", score.alias("score"), kind.alias("kind"))


def quotations(passages: DataFrame, n: int = 6, most: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of passages that share n words in a row which few others have, scored."""
    return scored(runs(shared(postings(passages, n, id_col, text_col), most), n), passages, id_col)
