"""Misspelled queries: the best run of words of a passage by shared trigrams.

An inverted file of the vocabulary's trigrams tells which words share any with the query, so only these words' postings are read.
Passages where a run of words can be similar enough, by the trigrams that its words share with the query, are read and compared exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import strings, trigrams
from lectern.operators.search import tokens

#: Words alike that are given to the index as a list; more of them are joined with it.
LISTED_WORDS = 5_000


def trigram_file(posts: DataFrame, weight: str = "A") -> DataFrame:
    """(gram, term, size) for each distinct word of a field: its trigrams, and how many there are."""
    words = posts.where(F.col("weight") == weight).select("term").distinct()
    grams = words.withColumn("grams", trigrams(F.col("term")))
    return grams.select(F.explode("grams").alias("gram"), "term", F.size("grams").alias("size"))


def query_words(query: str) -> list[str]:
    return re.findall(r"(?:[^\W_]|')+", query.lower())


def query_grams(query: str) -> list[str]:
    """The trigrams of all words of a query, each once."""
    return sorted({f"  {w} "[i : i + 3] for w in query_words(query) for i in range(len(w) + 1)})


def words_alike(grams: DataFrame, query: str, least: float | None = None) -> DataFrame:
    """(term, size, held): words that share trigrams with the query and which these are; with `least`, those that are so similar by themselves.

    Similarity is the share of common trigrams in all trigrams of both, so a word must hold `least` of the query's. Only the
    query's own lists of a file sorted by trigram are read.
    """
    own = query_grams(query)
    found = grams.where(F.col("gram").isin(own)).groupBy("term", "size").agg(F.array_sort(F.collect_set("gram")).alias("held"))
    if least is None:
        return found
    shared = F.size("held")
    return found.withColumn("similarity", shared / (len(own) + F.col("size") - shared)).where(F.col("similarity") >= least)


def similarity(words: Column, own: Column, size: int) -> Column:
    """The trigram similarity of some words, as one set, to a query's."""
    grams = F.array_distinct(F.flatten(F.transform(words, trigrams)))
    shared = F.size(F.array_intersect(grams, own))
    return shared / (size + F.size(grams) - shared)


def extents(passages: DataFrame, posts: DataFrame, grams: DataFrame, query: str, least: float = 0.6, reach: int | None = None, weight: str = "A", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, relevance): the best similarity of the query to any run of up to `reach` words of a passage, where it is `least` or more.

    reach is one more than the query's words by default, so a word may stand between two or one be split. A run that is similar enough holds
    `least` of the query's trigrams, and its best end is a word with one of them. Ties and repeated words don't matter; null
    and empty passages, and a query without words, find nothing.
    """
    own, words = query_grams(query), query_words(query)
    reach = reach or len(words) + 1
    needed = math.ceil(least * len(own) - 1e-9)
    alike = words_alike(grams, query) if own else words_alike(grams, "").where(F.lit(False))
    listed = [r["term"] for r in alike.select("term").limit(LISTED_WORDS + 1).collect()]
    field = posts.where(F.col("weight") == weight)
    held = alike.select("term", "held")
    if len(listed) <= LISTED_WORDS:
        # the list reaches the scan of an index sorted by term
        field, held = field.where(F.col("term").isin(listed)), F.broadcast(held)
    hits = field.join(held, "term").select("id", F.explode("positions").alias("at"), "held")
    run = Window.partitionBy("id").orderBy("at").rangeBetween(-(reach - 1), 0)
    near = hits.withColumn("near", F.size(F.array_distinct(F.flatten(F.collect_list("held").over(run)))))
    ends = near.where(F.col("near") >= needed).groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("ends"))
    read = passages.select(F.col(id_col).alias("id"), tokens(text_col).alias("words")).join(ends, "id")
    given = strings(own)
    best = F.transform("ends", lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.least(F.lit(reach), e + 1)), lambda n: similarity(F.slice("words", e - n + 2, n), given, len(own)))))
    return read.select("id", F.array_max(best).alias("relevance")).where(F.col("relevance") >= least)
