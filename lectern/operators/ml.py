"""Lexical classification: TF-IDF, centroids, thresholds and measures, all as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.similarity import idf, sublinear

#: Terms of a vocabulary, or rows of a few numbers, that may be sent to every executor (some 60 MB); of more, rows are joined by a shuffle.
SENT_TERMS = 2_000_000


def term_counts(posts: DataFrame, weight: str = "A", least: int = 3) -> DataFrame:
    """(id, term, n) of one field of a search index; words of fewer letters than `least` don't count."""
    return posts.where((F.col("weight") == weight) & (F.length("term") >= least)).select("id", "term", F.col("tf").alias("n"))


def vocabulary(counts: DataFrame, min_df: int = 3, most: int | None = 40_000) -> DataFrame:
    """(term, df) of the most frequent terms, equal ones by name; of all terms if `most` is None."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return terms if most is None else terms.orderBy(F.desc("df"), "term").limit(most)


def tfidf(counts: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """(id, term, weight), each document of length 1."""
    raw = counts.join(terms, "term").select("id", "term", (sublinear(F.col("n")) * idf(F.lit(float(documents)), F.col("df"))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # a document's terms, rows without an id too
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def sent(small: DataFrame, most: int = SENT_TERMS) -> DataFrame:
    """A table that is cheap to count, marked for broadcast if it has few rows."""
    return F.broadcast(small) if small.count() <= most else small


def counted(words: DataFrame) -> DataFrame:
    """(id, term, n) of rows (id, words): rows of one id are added up."""
    return words.select("id", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def ids_repeat(words: DataFrame) -> bool:
    """Whether an id has several rows."""
    return not words.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def documents_with(words: DataFrame, min_df: int, repeat: bool) -> DataFrame:
    """(term, df) of all terms in at least min_df documents, of rows (id, words); unless ids repeat only terms and their counts are shuffled."""
    each = counted(words) if repeat else words.select(F.explode(F.array_distinct("words")).alias("term"))
    return vocabulary(each, min_df, None)


def vectors(words: DataFrame, terms: DataFrame, documents: int, repeat: bool, most: int = SENT_TERMS) -> DataFrame:
    """tfidf() of rows (id, words) and a written table of terms (term, df).

    Up to `most` terms are sent to all tasks, which weigh the words of each row where it is; nothing is shuffled. Of more
    terms, or of ids that repeat, the words are joined.
    """
    if repeat or terms.count() > most:
        return tfidf(counted(words), terms, documents)
    known = terms.select("term", "df").toArrow().combine_chunks()
    spread = words.sparkSession.sparkContext.broadcast((known["term"].combine_chunks(), known["df"].to_numpy()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, df = spread.value
        rarity = np.log((documents + 1) / (df + 1)) + 1
        for batch in batches:
            lists = batch.column("words")
            code = pc.index_in(pc.list_flatten(lists), value_set=term)
            held = pc.is_valid(code).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[held]
            pairs, n = np.unique(row.astype(np.int64) * len(df) + code.drop_null().to_numpy(), return_counts=True)
            row, code = pairs // max(1, len(df)), pairs % max(1, len(df))
            w = (1 + np.log(n)) * rarity[code]
            norm = np.sqrt(np.bincount(row, w * w, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), term.take(pa.array(code)), pa.array(w / norm[row])], ["id", "term", "weight"])

    return words.select("id", "words").mapInArrow(each, f"id {words.schema['id'].dataType.simpleString()}, term string, weight double")


def centroids(vectors: DataFrame, labels: DataFrame, min_support: int = 2) -> DataFrame:
    """(label, term, weight) of labels (id, label) with enough documents, each centroid of length 1."""
    enough = labels.groupBy("label").agg(F.countDistinct("id").alias("support")).where(F.col("support") >= min_support).select("label")
    sums = vectors.join(sent(labels.join(enough, "label", "left_semi")), "id").groupBy("label", "term").agg(F.sum("weight").alias("w"))
    norm = sums.groupBy("label").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norm, "label").select("label", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_scores(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, label, score) of documents and labels that share a term."""
    c = sent(centres.select("label", "term", F.col("weight").alias("c")))
    return vectors.join(c, "term").groupBy("id", "label").agg(F.sum(F.col("weight") * F.col("c")).alias("score"))


def chosen_labels(scores: DataFrame, threshold: float = 0.5, least: int = 1, most: int = 4) -> DataFrame:
    """Labels of the threshold or more, `most` at most, and the best `least` in any case."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label")))
    return ranked.where((F.col("rank") <= least) | ((F.col("score") >= threshold) & (F.col("rank") <= most)))


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of (id, label) pairs."""
    a = truth.select("id", "label", F.lit(1).alias("t"))
    b = predicted.select("id", "label", F.lit(1).alias("p"))
    both = a.join(b, ["id", "label"], "full_outer")
    hit = F.col("t").isNotNull() & F.col("p").isNotNull()
    return both.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def f1(tp, fp, fn):
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def measures(counts: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1, and macro F1 over labels with support."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    macro = F.avg(F.when(F.col("tp") + F.col("fn") > 0, f1(F.col("tp"), F.col("fp"), F.col("fn"))))
    return counts.agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("micro_f1"), macro.alias("macro_f1"))


def best_thresholds(scores: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Per label of scored rows (label, score, truth): the first cut with the best F1."""
    grid = scores.select("label", "score", "truth", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    said = F.col("score") >= F.col("cut")
    counted = grid.groupBy("label", "cut").agg(F.count_if(said & (F.col("truth") == 1)).alias("tp"), F.count_if(said & (F.col("truth") == 0)).alias("fp"), F.count_if(~said & (F.col("truth") == 1)).alias("fn"))
    ranked = counted.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("f1"), "cut"))).where("_n = 1").drop("_n")


def reliable(by_label: DataFrame, least_f1: float = 0.55, least_support: int = 100) -> DataFrame:
    """Labels that may be used: F1 and support are enough."""
    own = by_label.withColumns({"f1": f1(F.col("tp"), F.col("fp"), F.col("fn")), "support": F.col("tp") + F.col("fn")})
    return own.withColumn("reliable", (F.col("f1") >= least_f1) & (F.col("support") >= least_support))


def held_out(df: DataFrame, id_col: str = "doc_id", percent: int = 20) -> DataFrame:
    """Rows with whether they are held out, by a hash of the id, so a row's side never changes."""
    number = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4), 16, 10).cast("int")
    return df.withColumn("held_out", number % 100 < percent)


def one_vs_rest(train: DataFrame, labels: Sequence[str], features: str = "features"):
    """A logistic model for each label (a 0/1 column), positives weighted by how rare they are; fitted by Spark's own trainer."""
    from pyspark.ml.classification import LogisticRegression

    models = {}
    for label in labels:
        counts = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("int")).count().collect()}
        if counts.get(0) and counts.get(1):
            ratio = max(1.0, counts[0] / counts[1])
            weighted = train.withColumn("_w", F.when(F.col(label) == 1, ratio).otherwise(1.0))
            models[label] = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", regParam=1e-5, maxIter=30).fit(weighted)
    return models


def scored_by(fit, rows: DataFrame, labels: Sequence[str], label: str, vector: str, id_col: str) -> DataFrame:
    """(id, a score for each label, best): one-vs-rest models fitted on rows with a label and a vector, and what they say of each row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = rows.where(F.col(label).isNotNull()).select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"), *((F.col(label).cast("string") == c).cast("double").alias(f"is_{c}") for c in labels))
    models = fit(known, [f"is_{c}" for c in labels])
    told = known.select(id_col, "features")
    for c in labels:
        model = models.get(f"is_{c}")
        if model is None:
            told = told.withColumn(f"score_{c}", F.lit(0.0))
            continue
        told = model.transform(told).withColumn(f"score_{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    best = F.array_max(F.array(*(F.struct(F.col(f"score_{c}").alias("s"), F.lit(c).alias("label")) for c in labels)))["label"]
    return told.select(id_col, *(f"score_{c}" for c in labels), best.alias("best"))


def saved_model(centroids: DataFrame, path: str, places: int = 4) -> DataFrame:
    """Writes (label, term, weight) with rounded weights, and gives what a reader of the path gets."""
    centroids.withColumn("weight", F.round("weight", places)).write.mode("overwrite").parquet(path)
    return centroids.sparkSession.read.parquet(path)
