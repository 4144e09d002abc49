"""Full-text retrieval over a postings table: exact, relaxed and widened passes, coverage and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.similarity import candidate_score
from lectern.functions.text import strings, word_similarity

#: Weights of fields A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


@dataclass
class Query:
    """A parsed query: every group needs one of its words; phrases need all in a row; excluded words must be absent."""

    groups: list[list[str]] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys([*(w for g in self.groups for w in g), *(w for p in self.phrases for w in p)]))


def parse(query: str) -> Query:
    """Words are all needed, "phrases" in order, `or` joins neighbours, -word excludes."""
    out, join = Query(), False
    for phrase, minus, word in re.findall(r'"([^"]*)"|(-?)([^\W_][\w\']*)', query.lower()):
        if phrase:
            out.phrases.append(re.findall(r"[\w']+", phrase))
        elif word == "or" and out.groups:
            join = True
            continue
        elif minus:
            out.excluded.append(word)
        elif join:
            out.groups[-1].append(word)
        else:
            out.groups.append([word])
        join = False
    return out


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def index(passages: DataFrame, fields: dict[str, Column | str], id_col: str = "doc_id", terms: Sequence[str] | None = None) -> DataFrame:
    """Postings (id, weight, term, tf, positions) of each field; fields are given by their weight's letter. With `terms`, of these only, and only their places are shuffled."""
    parts = [passages.select(F.col(id_col).alias("id"), F.lit(letter).alias("weight"), F.posexplode(tokens(text)).alias("at", "term")) for letter, text in fields.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    if terms is not None:
        whole = whole.where(F.col("term").isin(list(terms)))
    return whole.groupBy("id", "weight", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def exact(posts: DataFrame, query: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, relevance) of passages that match the whole query. Relevance is the sum of weight times count of its terms."""
    q = parse(query)
    if not q.terms:
        raise ValueError("a query without terms is a filter")
    weight = F.lit(0.0)
    for letter, w in weights.items():
        weight = F.when(F.col("weight") == letter, w).otherwise(weight)
    hits = posts.where(F.col("term").isin(q.terms))
    scored = hits.groupBy("id").agg(F.sum(weight * F.col("tf")).alias("relevance"), F.collect_set("term").alias("found"))
    for group in q.groups:
        scored = scored.where(F.arrays_overlap("found", strings(group)))
    for phrase in q.phrases:
        scored = scored.where(F.size(F.array_intersect("found", strings(phrase))) == len(set(phrase)))
        starts = hits.where(F.col("term").isin(phrase)).select("id", "weight", "term", F.explode("positions").alias("at"))
        place = [starts.where(F.col("term") == w).select("id", "weight", (F.col("at") - i).alias("start")).distinct() for i, w in enumerate(phrase)]
        for p in place[1:]:
            place[0] = place[0].join(p, ["id", "weight", "start"], "left_semi")
        scored = scored.join(place[0], "id", "left_semi")
    if q.excluded:
        scored = scored.join(posts.where(F.col("term").isin(q.excluded)).select("id"), "id", "left_anti")
    return scored.select("id", "relevance")


def relaxed(posts: DataFrame, query: str, least: float = 0.6) -> DataFrame:
    """(id, relevance) of passages with a word whose trigrams are like the query's; each distinct word is compared once."""
    words = posts.select("term").distinct().withColumn("relevance", word_similarity(query, F.array("term"))).where(F.col("relevance") >= least)
    return posts.select("id", "term").join(words, "term").groupBy("id").agg(F.max("relevance").alias("relevance"))


def search(passages: DataFrame, posts: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, relevance, match_mode): exact matches, or relaxed ones if there are none; every passage for no terms."""
    if not parse(query).terms:
        return passages.select(F.col(id_col).alias("id"), F.lit(0.0).alias("relevance"), F.lit("filters-only").alias("match_mode"))
    found = exact(posts, query).withColumn("match_mode", F.lit("exact"))
    if len(query) >= 4 and found.isEmpty():
        return relaxed(posts.where("weight = 'A'"), query).withColumn("match_mode", F.lit("relaxed"))
    return found


def coverage(text: Column | str, terms: Sequence[str]) -> Column:
    """The share of terms that the text has as substrings; 1 without terms."""
    if not terms:
        return F.lit(1.0)
    return F.aggregate(F.transform(strings(terms), lambda t: F.contains(F.lower(text), t).cast("int")), F.lit(0), lambda s, v: s + v) / len(terms)


def normalised(found: DataFrame, rank: str = "relevance") -> DataFrame:
    """Ranks as shares of the page's best."""
    best = found.agg(F.max(rank).alias("_best"))
    return found.crossJoin(F.broadcast(best)).withColumn("rank", F.when(F.col("_best") > 0, F.col(rank) / F.col("_best")).otherwise(0.0)).drop("_best")  # one row


def covered(found: DataFrame, passages: DataFrame, query: str, density: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """found with coverage of the query's terms and the candidate score."""
    own = normalised(found).join(passages.select(F.col(id_col).alias("id"), text_col), "id")
    own = own.withColumn("coverage", coverage(text_col, parse(query).terms))
    return own.withColumn("score", candidate_score(F.col("rank"), F.col("coverage"), density if density is not None else F.lit(0.5))).drop(text_col)


def widened(posts: DataFrame, query: str, terms: Sequence[str]) -> DataFrame:
    """Literal hits, then hits of further terms that weren't seen before: id, relevance, term, term_rank."""
    parts = [exact(posts, t).select("id", "relevance", F.lit(t).alias("term"), F.lit(i).alias("term_rank")) for i, t in enumerate([query, *terms])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = Window.partitionBy("id").orderBy("term_rank", F.desc("relevance"))
    return whole.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
