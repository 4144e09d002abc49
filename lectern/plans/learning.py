"""Queries of lexical classification and of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import ml as M
from lectern.operators import search as FT
from lectern.plans.registry import query, words_sql
from lectern.plans.retrieval import posts
from lectern.sources.readers import passages, table
from lectern.sources.shared import shared, written
from lectern.streaming import logs

_COUNTS = f"counts AS (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id, unnest(list_filter({words_sql('text')}, lambda w: length(w) >= 3)) AS term FROM documents) GROUP BY 1, 2), vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 5)"
_TFIDF = f"{_COUNTS}, raw AS (SELECT id, term, (1 + ln(n)) * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1) AS w FROM counts JOIN vocab USING (term)), vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"
_CENTRES = f"{_TFIDF}, lab AS (SELECT doc_id AS id, quality::VARCHAR || toxic::VARCHAR AS label FROM labels), cs AS (SELECT label, term, sum(weight) AS w FROM vec JOIN lab USING (id) GROUP BY 1, 2), cen AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS weight FROM cs), pred AS (SELECT id, label, sum(vec.weight * cen.weight) AS score FROM vec JOIN cen USING (term) GROUP BY 1, 2)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.term_counts(posts(spark, sf))


def _weighed(spark: SparkSession, sf: str, ids: DataFrame | None = None) -> DataFrame:
    """Vectors of all documents or of those with the given distinct ids; terms are counted over all."""
    words = passages(spark, sf).select(F.col("doc_id").alias("id"), FT.tokens("text").alias("words"))
    words = words.select("id", F.filter("words", lambda w: F.length(w) >= 3).alias("words"))
    repeat = M.ids_repeat(words)
    terms = shared(spark, sf, "terms", lambda: M.documents_with(words, 5, repeat))
    own = words if ids is None else words.join(M.sent(ids), "id", "left_semi")
    return M.vectors(own, terms, table(spark, sf, "documents").count(), repeat)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "vectors", lambda: _weighed(spark, sf))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return M.cosine_scores(vectors, written(M.centroids(vectors, _labels(spark, sf))))


def _scores_of_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """_scores() of the documents with a label, which make the centroids too: no others are weighed."""
    labels = _labels(spark, sf)
    build = lambda: _weighed(spark, sf, labels.select("id").distinct())
    vectors = shared(spark, sf, "vectors of labelled", build, of=("documents", "labels"))
    return M.cosine_scores(vectors, written(M.centroids(vectors, labels)))


@query(f"WITH {_COUNTS} SELECT term, df FROM vocab")
def doc_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return M.vocabulary(_counts(spark, sf), 5, None)


@query(f"WITH {_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM vec")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _weighed(spark, sf).withColumn("weight", F.round("weight", 6))  # all rows are asked for once, so they aren't stored


@query(f"WITH {_CENTRES} SELECT id, label, round(score, 6) AS score FROM pred")
def centroid_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


@query(f"WITH {_CENTRES} SELECT id, label, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) AS r FROM pred) WHERE r <= 1 OR (score >= 0.5 AND r <= 4)")
def label_selection(spark: SparkSession, sf: str) -> DataFrame:
    return M.chosen_labels(_scores(spark, sf).withColumn("score", F.round("score", 9))).withColumn("score", F.round("score", 6))


@query(f"""WITH {_CENTRES},
g AS (SELECT p_label AS label, cut, count(*) FILTER (WHERE score >= cut AND truth = 1) AS tp, count(*) FILTER (WHERE score >= cut AND truth = 0) AS fp, count(*) FILTER (WHERE score < cut AND truth = 1) AS fn FROM (SELECT pred.label AS p_label, round(score, 9) AS score, (lab.label = pred.label)::INT AS truth, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS cut FROM pred JOIN lab USING (id)) GROUP BY 1, 2),
f AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM g) SELECT label, cut, tp, fp, fn, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, cut) AS n FROM f) WHERE n = 1""")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    own = _labels(spark, sf).withColumnRenamed("label", "own")
    told = _scores(spark, sf).join(own, "id").select("label", F.round("score", 9).alias("score"), (F.col("label") == F.col("own")).cast("int").alias("truth"))
    return M.best_thresholds(told, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])


@query(f"""WITH {_CENTRES}, best AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) AS r FROM pred SEMI JOIN lab USING (id)) WHERE r = 1),
c AS (SELECT coalesce(a.label, b.label) AS label, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.id IS NULL) AS fp, count(*) FILTER (WHERE b.id IS NULL) AS fn FROM lab a FULL JOIN best b ON a.id = b.id AND a.label = b.label GROUP BY 1)
SELECT round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS recall, round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 6) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE) FILTER (tp + fn > 0), 6) AS macro_f1 FROM c""")
def micro_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    truth = _labels(spark, sf)
    best = M.chosen_labels(_scores(spark, sf).join(truth.select("id"), "id", "left_semi").withColumn("score", F.round("score", 9)), 2.0, 1, 1)
    return M.measures(M.confusion(truth, best)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "micro_f1", "macro_f1")))


@query("""WITH lab AS (SELECT doc_id AS id, quality::VARCHAR || toxic::VARCHAR AS label FROM labels), m AS (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), c AS (SELECT coalesce(a.label, b.label) AS label, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.id IS NULL) AS fp, count(*) FILTER (WHERE b.id IS NULL) AS fn FROM lab a FULL JOIN (SELECT id, m.label FROM lab, m) b ON a.id = b.id AND a.label = b.label GROUP BY 1)
SELECT round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 6) AS micro_f1 FROM c""")
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    truth = _labels(spark, sf)
    most = truth.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select("label")
    said = truth.select("id").crossJoin(F.broadcast(most))  # one row
    return M.measures(M.confusion(truth, said)).select(F.round("micro_f1", 6).alias("micro_f1"))


@query("SELECT 'quality' AS label, greatest(1, count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1)::DOUBLE) AS positive_weight FROM labels UNION ALL SELECT 'toxic', greatest(1, count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1)::DOUBLE) FROM labels")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("v")))).alias("x")).select("x.*")
    return rows.groupBy("label").agg(F.greatest(F.lit(1.0), F.count_if(F.col("v") == 0) / F.count_if(F.col("v") == 1)).alias("positive_weight"))


_DIGIT = "strpos('0123456789abcdef', substring(md5(doc_id::VARCHAR), {0}, 1)) - 1"


@query(f"SELECT doc_id, (({_DIGIT.format(1)}) * 4096 + ({_DIGIT.format(2)}) * 256 + ({_DIGIT.format(3)}) * 16 + {_DIGIT.format(4)}) % 100 < 20 AS held_out FROM labels")
def held_out_split(spark: SparkSession, sf: str) -> DataFrame:
    return M.held_out(table(spark, sf, "labels").select("doc_id"))


@query("""SELECT user_id, event_type, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS n FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE n <= 12""")
def recent_queries(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "event_type"))).where("rank <= 12").select("user_id", "event_type", "rank")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def log_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tumbling_counts(table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query("SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def log_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return logs.distinct_events(rows.unionByName(rows)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM g GROUP BY user_id, s""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sessions(table(spark, sf, "events"))


@query("SELECT conv_id, turn, round(0.5 + 0.4::DOUBLE * cos(2 * pi() * i / n), 6) AS x, round(0.5 + 0.4::DOUBLE * sin(2 * pi() * i / n), 6) AS y FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def ring_layout(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("conv_id")
    angle = 2 * F.pi() * (F.row_number().over(by.orderBy("turn")) - 1) / F.count(F.lit(1)).over(by)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(0.5 + 0.4 * F.cos(angle), 6).alias("x"), F.round(0.5 + 0.4 * F.sin(angle), 6).alias("y"))
