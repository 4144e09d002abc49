"""Theme scores of passages, and the analyses that compare texts by theme."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import significant_terms, strings
from lectern.operators.relational import top_n


def _themed(passages: DataFrame, themes: Mapping[str, Sequence[str]], text_col: str = "text") -> DataFrame:
    """Adds `_themes`: (score, theme, evidence) of every theme that a passage has."""
    terms = significant_terms(text_col)
    each = []
    for name, words in themes.items():
        hits = F.filter(strings(words), lambda w: F.contains(F.col("_lower"), w))
        raw = F.least(F.lit(1.0), 0.6 * F.size(hits) / len(words) + F.when(F.array_contains(F.col("_terms"), name), 0.2).otherwise(0.0))
        each.append(F.struct(raw.alias("score"), F.lit(name).alias("theme"), F.slice(hits, 1, 3).alias("evidence")))
    # a column, as what stands inside a lambda is computed anew for each word
    read = passages.withColumns({"_terms": terms, "_lower": F.lower(text_col)})
    return read.withColumn("_themes", F.filter(F.array(*each), lambda t: t["score"] > 0)).drop("_terms", "_lower")


def with_themes(passages: DataFrame, themes: Mapping[str, Sequence[str]], most: int = 5, text_col: str = "text", out: str = "themes") -> DataFrame:
    """Adds the names of a passage's best themes, those of theme_scores(), in the order of names; each row by itself, without a shuffle."""
    best = F.slice(F.array_sort(F.transform("_themes", lambda t: F.struct((-t["score"]).alias("s"), t["theme"].alias("theme")))), 1, most)
    return _themed(passages, themes, text_col).withColumn(out, F.array_sort(F.transform(best, lambda t: t["theme"]))).drop("_themes")


def theme_scores(passages: DataFrame, themes: Mapping[str, Sequence[str]], most: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, theme, score, confidence, evidence, rank): the best derived themes by keyword; source is always derived."""
    scored = _themed(passages, themes, text_col).select(F.col(id_col).alias("id"), *keep, F.explode("_themes").alias("t"))
    flat = scored.select("id", *keep, "t.theme", "t.score", F.least(F.lit(0.6), F.col("t.score")).alias("confidence"), "t.evidence", F.lit("derived").alias("source_kind"))
    return top_n(flat, ["id"], [F.desc("score"), F.col("theme")], most)


def needs_judgement(scores: DataFrame, passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, needs): no theme, none that is strong, or two that are close; a single strong theme is enough."""
    best = scores.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    needs = F.col("top").isNull() | (F.col("top") < 0.2) | F.coalesce(F.col("top") - F.col("second") < 0.05, F.lit(False))
    return passages.select(F.col(id_col).alias("id")).join(best, "id", "left").select("id", needs.alias("needs"))


def compared(scores: DataFrame, theme: str, text: str, bar: float = 0.3, each: int = 4, floor: int = 5) -> DataFrame:
    """The best passages of a theme in every text that has at least `floor` of them."""
    strong = scores.where((F.col("theme") == theme) & (F.col("score") >= bar))
    return top_n(strong, [text], [F.desc("score"), F.col("id")], each, floor=floor)


def cooccurring(scores: DataFrame, theme: str, bar: float = 0.0, limit: int = 20) -> DataFrame:
    """Themes of the passages that have a theme: how many passages, and their mean score."""
    centre = scores.where((F.col("theme") == theme) & (F.col("score") >= bar)).select("id")
    rest = scores.join(centre, "id", "left_semi").where(F.col("theme") != theme)
    return rest.groupBy("theme").agg(F.count(F.lit(1)).alias("passages"), F.avg("score").alias("mean_score")).orderBy(F.desc("passages"), "theme").limit(limit)


def journey(scores: DataFrame, theme: str, texts: Sequence[str], text: str, limit: int) -> DataFrame:
    """The strongest passages of a theme in the given texts, in the order of the texts."""
    strong = scores.where((F.col("theme") == theme) & F.col(text).isin(list(texts))).orderBy(F.desc("score"), "id").limit(limit * 4)
    place = F.array_position(strings(texts), F.col(text))
    return strong.withColumn("text_order", place).orderBy("text_order", "id").limit(limit)


def shared_themes(scores: DataFrame, least: int = 2) -> DataFrame:
    """Themes of two or more passages, with the passages and the mean score."""
    return scores.groupBy("theme").agg(F.count(F.lit(1)).alias("passages"), F.avg("score").alias("mean_score")).where(F.col("passages") >= least)


def coverage(labels: DataFrame, theme: str, text: str, book: Column, least_passages: int = 150, least_texts: int = 4) -> DataFrame:
    """Themes that enough passages and texts have."""
    counted = labels.groupBy(theme).agg(F.count(F.lit(1)).alias("passages"), F.countDistinct(text).alias("texts"), F.countDistinct(book).alias("books"))
    return counted.where((F.col("passages") >= least_passages) & (F.col("texts") >= least_texts))


def strongest(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.withColumn("strength_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "theme"))).where(F.col("strength_rank") <= n)
