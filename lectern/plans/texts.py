"""Queries of text functions and theme analyses over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators import themes as T
from lectern.plans.registry import query, word_list, words_sql
from lectern.sources.readers import passages, table
from lectern.sources.shared import shared
from lectern.vocab import FIXTURE_THEMES, INTENT_KEYWORDS, STOP_WORDS, THEME_CATEGORIES

_TERMS = f"list_distinct(list_filter({words_sql('text')}, lambda w: length(w) > 3 AND NOT list_contains({word_list(STOP_WORDS)}, w)))"


def _themes_sql() -> str:
    parts = []
    for name, words in FIXTURE_THEMES.items():
        hits = " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)
        parts.append(f"SELECT doc_id AS id, source, lang, '{name}' AS theme, least(1.0, 0.6::DOUBLE * ({hits}) / {len(words)} + CASE WHEN list_contains({words_sql('text')}, '{name}') THEN 0.2::DOUBLE ELSE 0 END)::DOUBLE AS score FROM documents WHERE ({hits}) > 0")
    return f"raw AS ({' UNION ALL '.join(parts)}), scores AS (SELECT *, least(0.6::DOUBLE, score) AS confidence, row_number() OVER (PARTITION BY id ORDER BY score DESC, theme) AS rank FROM raw)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Theme scores of all passages, written once."""
    return shared(spark, sf, "theme scores", lambda: T.theme_scores(passages(spark, sf), FIXTURE_THEMES, keep=("source", "lang")))


@query(f"WITH {_themes_sql()} SELECT source, id, round(score, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k, count(*) OVER (PARTITION BY source) AS n FROM scores WHERE theme = 'linking' AND score >= 0.3) WHERE n >= 5 AND k <= 4")
def theme_compare(spark: SparkSession, sf: str) -> DataFrame:
    return T.compared(scores(spark, sf).drop("rank"), "linking", "source").select("source", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT doc_id, array_to_string(list_sort({_TERMS}), ' ') AS terms FROM documents")
def significant_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.significant_terms("text")), " ").alias("terms"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b\p{{Lu}}\p{{L}}{{2,}}\b'), lambda w: lower(w)), lambda w: NOT list_contains({word_list(STOP_WORDS)}, w)))), ' ') AS names FROM documents")
def proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.proper_nouns("text")), " ").alias("names"))


@query(r"SELECT doc_id, regexp_matches(lower(text), '\bthat\b') AS has_that, regexp_matches(lower(text), '\bof the\b') AS has_phrase FROM documents")
def contains_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.contains_keyword("text", "that").alias("has_that"), X.contains_keyword("text", "of the").alias("has_phrase"))


@query(f"WITH {_themes_sql()} SELECT id, theme, round(score, 6) AS score, round(confidence, 6) AS confidence, rank FROM scores WHERE rank <= 5")
def theme_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("id", "theme", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "rank")


@query(f"""WITH {_themes_sql()}, b AS (SELECT id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM scores GROUP BY id)
SELECT doc_id AS id, top IS NULL OR top < 0.2 OR coalesce(top - second < 0.05, false) AS needs FROM documents LEFT JOIN b ON id = doc_id""")
def needs_judgement(spark: SparkSession, sf: str) -> DataFrame:
    return T.needs_judgement(scores(spark, sf), passages(spark, sf))


@query(f"WITH {_themes_sql()}, c AS (SELECT id FROM scores WHERE theme = 'linking' AND score >= 0.2) SELECT theme, count(*) AS passages, round(avg(score), 6) AS mean_score FROM scores WHERE id IN (SELECT id FROM c) AND theme <> 'linking' GROUP BY theme ORDER BY passages DESC, theme LIMIT 20")
def theme_map(spark: SparkSession, sf: str) -> DataFrame:
    return T.cooccurring(scores(spark, sf), "linking", 0.2).withColumn("mean_score", F.round("mean_score", 6))


@query(f"""WITH {_themes_sql()}, s AS (SELECT * FROM scores WHERE theme = 'being' AND source IN ('src3', 'src1', 'src9') ORDER BY score DESC, id LIMIT 48)
SELECT id, source, list_position(['src3', 'src1', 'src9'], source) AS text_order, round(score, 6) AS score FROM s ORDER BY text_order, id LIMIT 12""")
def thematic_journey(spark: SparkSession, sf: str) -> DataFrame:
    return T.journey(scores(spark, sf), "being", ["src3", "src1", "src9"], "source", 12).select("id", "source", F.col("text_order").cast("int").alias("text_order"), F.round("score", 6).alias("score"))


@query(f"WITH {_themes_sql()} SELECT source, string_agg(level::VARCHAR, ',' ORDER BY level) AS levels FROM (SELECT DISTINCT source, round(score, 2) AS level FROM scores) GROUP BY source")
def score_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = scores(spark, sf).groupBy("source").agg(F.array_sort(F.collect_set(F.round("score", 2))).alias("l"))
    return levels.select("source", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("levels"))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(theme, '{p}') THEN '{c}'" for c, p in THEME_CATEGORIES) + " ELSE 'other' END"


@query(f"SELECT p_partkey, {_CATEGORY.replace('theme', 'lower(p_name)')} AS category FROM part")
def theme_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.theme_category(F.lower("p_name")).alias("category"))


def _intent_sql(column: str) -> str:
    key = rf"regexp_replace(lower(trim({column})), '\s+', ' ', 'g')"
    hits = ", ".join(f"len(list_filter({word_list(words)}, lambda w: contains({key}, w)))" for words in INTENT_KEYWORDS.values())
    return f"SELECT item_id, [{hits}] AS h FROM benchmark"


@query(f"SELECT item_id, CASE WHEN list_max(h) > 0 THEN {word_list(INTENT_KEYWORDS)}[list_position(h, list_max(h))] ELSE 'unknown' END AS intent, round(CASE WHEN list_max(h) > 0 THEN least(0.75::DOUBLE, 0.35::DOUBLE + 0.2::DOUBLE * list_max(h)) ELSE 0::DOUBLE END, 6) AS confidence FROM ({_intent_sql('text')})")
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", X.intent("text").alias("i")).select("item_id", "i.intent", F.round("i.confidence", 6).alias("confidence"))


def _query_theme_sql() -> str:
    hits = ", ".join("(" + " + ".join(rf"regexp_matches(lower(text), '\b{w}\b')::INT" for w in words) + ")" for words in FIXTURE_THEMES.values())
    return f"SELECT item_id, [{hits}] AS h FROM benchmark"


@query(f"SELECT item_id, CASE WHEN list_max(h) > 0 THEN {word_list(FIXTURE_THEMES)}[list_position(h, list_max(h))] END AS theme, round(least(0.7::DOUBLE, 0.3::DOUBLE * list_max(h)), 6) AS confidence FROM ({_query_theme_sql()})")
def query_theme(spark: SparkSession, sf: str) -> DataFrame:
    counted = [F.struct(sum((X.contains_keyword("text", w).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(FIXTURE_THEMES.items())]
    best = table(spark, sf, "benchmark").select("item_id", F.array_max(F.array(*counted)).alias("b"))
    return best.select("item_id", F.when(F.col("b.hits") > 0, F.col("b.name")).alias("theme"), F.round(F.least(F.lit(0.7), 0.3 * F.col("b.hits")), 6).alias("confidence"))


@query(r"SELECT conv_id, turn, regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS k, trim(regexp_replace(regexp_replace(lower(role), '[.''’]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS alias FROM conversations")
def query_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", X.query_key("text").alias("k"), X.alias_key("role").alias("alias"))


@query("SELECT concat_ws(':', source, lang, doc_id // 100, doc_id % 100) AS passage_key, source AS text_id, lang AS book, (doc_id // 100)::INT AS chapter, (doc_id % 100)::INT AS verse FROM documents")
def passage_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = X.passage_key("source", "lang", F.floor(F.col("doc_id") / 100), F.col("doc_id") % 100)
    return table(spark, sf, "documents").select(key.alias("passage_key"), X.key_parts(key).alias("p")).select("passage_key", "p.*")


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter({words_sql('text')}, lambda w: length(w) > 4)) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, word, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, word) AS r FROM c) WHERE r <= 3""")
def shared_term_sample(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.relational import top_n
    from lectern.operators.search import tokens

    words = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(tokens("text"), lambda w: F.length(w) > 4)).alias("word"))
    return top_n(words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), ["doc_id"], [F.desc("n"), F.length("word").desc(), F.col("word")], 3)


@query(r"""SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
lambda s: length(s) > 20 AND regexp_matches(lower(s), '\b(that|with|this)\b'))[1:3]) AS sentence FROM documents""")
def theme_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(X.theme_evidence("text", FIXTURE_THEMES["linking"])).alias("sentence"))


@query()
def speech_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.speech_chunks("text")).alias("at", "chunk"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<sup[^>]*>.*?</sup>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def clean_translations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.clean_translation("html").alias("text"))


@query()
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.footnote_strip("html").alias("text"))


@query()
def strip_damage(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that the old way of stripping and the new one leave different."""
    both = table(spark, sf, "pages").select("page_id", X.clean_translation("html").alias("old"), X.footnote_strip("html").alias("new"))
    return both.where("old <> new")


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g')) AS folded FROM documents")
def folded_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.fold("text").alias("folded"))


@query("""SELECT doc_id, substring(text, 1, 200) AS preview, replace(source, 'src', 'text ') AS label, round(100 * n_chars / 20000.0::DOUBLE, 1) AS percent FROM documents""")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview"), F.replace("source", F.lit("src"), F.lit("text ")).alias("label"), F.round(100 * F.col("n_chars") / 20000, 1).alias("percent"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS density FROM events""")
def field_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("density"))


@query("""SELECT doc_id, CASE WHEN 1 - s >= 0.6 THEN 'addressed' WHEN 1 - s >= 0.3 THEN 'partial' ELSE 'unaddressed' END AS verdict, round(0.75::DOUBLE * s + 0.25::DOUBLE * (1 - s), 6) AS blend, round(least(1, s / (s + 6)), 6) AS saturated FROM (SELECT doc_id, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS s FROM documents)""")
def silence_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.least(F.lit(1.0), F.col("n_chars") / 5000)
    return table(spark, sf, "documents").select("doc_id", S.verdict(s).alias("verdict"), F.round(0.75 * s + 0.25 * (1 - s), 6).alias("blend"), F.round(S.saturated(s), 6).alias("saturated"))
