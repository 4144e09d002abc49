"""Queries of corpus views, libraries, caches, reports and the remaining lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import ml as M
from lectern.operators import relational as R
from lectern.operators import relations as N
from lectern.operators import search as FT
from lectern.operators import themes as T
from lectern.plans.learning import _CENTRES, _labels, _scores_of_labelled
from lectern.plans.registry import query, word_list, words_sql
from lectern.plans.retrieval import _SCORED, _edges, _exact_sql, posts
from lectern.plans.texts import _themes_sql, scores
from lectern.sources.readers import passages, table
from lectern.vocab import INTENT_KEYWORDS

_P = "SELECT doc_id AS id, source AS text_id, lang, text, (1 + doc_id % 7)::INT AS chapter FROM documents"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("text_id"), "lang", "text", (1 + F.col("doc_id") % 7).cast("int").alias("chapter"))


@query(f"WITH p AS ({_P}) SELECT id, chapter, lag(id) OVER (ORDER BY id) AS previous, lead(id) OVER (ORDER BY id) AS next FROM p WHERE text_id = 'src2' AND chapter = 7")
def reading_view(spark: SparkSession, sf: str) -> DataFrame:
    told = C.chapter(_placed(spark, sf), "src2", 99.5, 7)
    return R.neighbours(told, "text_id", ["id"], "id").select("id", "chapter", "previous", "next")


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 1")
def random_passage(spark: SparkSession, sf: str) -> DataFrame:
    return C.random_row(passages(spark, sf).select("doc_id", "source"), "doc_id", 7)


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND d.source IN ('src1', 'src2', 'src3') AND d.doc_id > 10 ORDER BY d.doc_id LIMIT 150")
def unverified_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source in ('src1', 'src2', 'src3')").select("doc_id", "source")
    return R.after(rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti"), "doc_id", 10, 150)


@query("SELECT source, min(doc_id) AS first_match FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 AND contains(lower(text), 'the') GROUP BY source")
def version_probe(spark: SparkSession, sf: str) -> DataFrame:
    first = R.top_n(table(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], 3)
    return first.where(F.contains(F.lower("text"), F.lit("the"))).groupBy("source").agg(F.min("doc_id").alias("first_match"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 0.5::DOUBLE AS density FROM events WHERE event_type = 'purchase'")
def merge_json_field(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k string, density double").alias("m"))
    return meta.withColumn("m", F.col("m").withField("density", F.lit(0.5))).select("event_id", "m.k", "m.density")


@query("""WITH a AS (SELECT o_custkey AS user_id, o_orderstatus AS item, min(o_orderdate) AS saved, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS collection FROM orders GROUP BY 1, 2) SELECT * FROM a""")
def saved_items(spark: SparkSession, sf: str) -> DataFrame:
    """Saved again, an item keeps its time and takes the last collection."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("item")).agg(F.min("o_orderdate").alias("saved"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("collection"))


@query("SELECT conv_id, count(*) AS keys, true AS same FROM conversations GROUP BY conv_id")
def share_links(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "role", F.col("turn").cast("string")))).alias("k"))
    link = keys.withColumn("url", C.share_url(F.col("k")))
    return link.select("conv_id", F.size(C.shared_keys("url")).cast("long").alias("keys"), (C.shared_keys("url") == F.col("k")).alias("same"))


@query("SELECT doc_id, concat(text, chr(10), '— ', source, ' ', lang, chr(10), 'score ', CASE WHEN quality = 1 THEN '1.00' ELSE '0.00' END, ' (manual)') AS citation FROM documents JOIN labels USING (doc_id)")
def citation_export(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.sources.sinks import export_citation

    told = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("kind", F.lit("manual"))
    return told.select("doc_id", export_citation("source", "lang", "text", "quality", "kind").alias("citation"))


@query(f"""WITH {_themes_sql()}, t AS (SELECT id, string_agg(theme, ',' ORDER BY score DESC, theme) AS themes FROM scores WHERE rank <= 5 GROUP BY id)
SELECT doc_id AS id, themes, count(b.item_id) FILTER (trim(b.text) <> trim(d.text)) AS alternatives FROM documents d LEFT JOIN t ON t.id = doc_id LEFT JOIN benchmark b ON b.item_id = doc_id GROUP BY 1, 2""")
def passage_documents(spark: SparkSession, sf: str) -> DataFrame:
    others = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("other").alias("name"), "text")
    whole = C.assembled(passages(spark, sf).select(F.col("doc_id").alias("id"), "text"), scores(spark, sf), others)
    return whole.select("id", F.array_join(F.transform("themes", lambda t: t["theme"]), ",").alias("themes"), F.size("alternatives").cast("long").alias("alternatives"))


@query(f"SELECT doc_id, list_has_all({words_sql('text')}, ['that', 'the']) AS every, list_has_any({words_sql('text')}, ['that', 'und']) AS some FROM documents")
def array_containment(spark: SparkSession, sf: str) -> DataFrame:
    words = FT.tokens("text")
    return table(spark, sf, "documents").select("doc_id", (F.size(F.array_intersect(words, X.strings(["that", "the"]))) == 2).alias("every"), F.arrays_overlap(words, X.strings(["that", "und"])).alias("some"))


@query(f"{_SCORED} SELECT a, b, score FROM q WHERE (a IN (SELECT item_id FROM benchmark) OR b IN (SELECT item_id FROM benchmark)) AND kind <> 'parallel'")
def edges_of_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Edges at either end of some passages: by the flipped view, so both ends are one equality join."""
    wanted = table(spark, sf, "benchmark").select(F.col("item_id").alias("self"))
    touched = R.both_ways(_edges(spark, sf).where("kind <> 'parallel'")).join(wanted, "self", "left_semi")
    return touched.select(F.least("self", "other").alias("a"), F.greatest("self", "other").alias("b"), F.col("strength").alias("score")).distinct()


@query(r"SELECT doc_id, regexp_matches(concat(source, ':', lang, ':', doc_id // 100, ':', doc_id % 100), '^(src1|src2|src3):[^:]+:\d+:\d+$') AS valid FROM documents")
def valid_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = X.passage_key("source", "lang", F.floor(F.col("doc_id") / 100), F.col("doc_id") % 100)
    return table(spark, sf, "documents").select("doc_id", key.rlike(r"^(src1|src2|src3):[^:]+:\d+:\d+$").alias("valid"))


@query("WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, round(greatest(0.1::DOUBLE, 1 - (i - 1) / n::DOUBLE), 6) AS score FROM a")
def page_rank_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    placed = R.numbered(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], "place")
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(size, "source").select("source", "doc_id", F.round(F.greatest(F.lit(0.1), 1 - (F.col("place") - 1) / F.col("n")), 6).alias("score"))


@query("SELECT doc_id, row_number() OVER (ORDER BY item_id ASC NULLS LAST, doc_id) AS place FROM (SELECT d.doc_id, b.item_id FROM documents d LEFT JOIN (SELECT max(item_id) OVER () - item_id AS item_id, item_id AS doc_id FROM benchmark) b USING (doc_id)) ORDER BY place LIMIT 64")
def reranked_order(spark: SparkSession, sf: str) -> DataFrame:
    """A page in an external order, what that order doesn't know behind it."""
    bench = table(spark, sf, "benchmark")
    most = bench.agg(F.max("item_id")).first()[0]
    asked = bench.select(F.col("item_id").alias("doc_id"), (F.lit(most) - F.col("item_id")).alias("at"))
    order = [F.asc_nulls_last("at"), F.col("doc_id")]
    page = table(spark, sf, "documents").select("doc_id").join(asked, "doc_id", "left").orderBy(*order).limit(64)
    return page.select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # the page


@query(f"""{_SCORED}, e AS (SELECT a AS self, b AS other, score AS strength, CASE WHEN kind = 'quotation' THEN 'verbatim' ELSE 'relation' END AS kind, CASE WHEN kind = 'quotation' THEN 0 ELSE 1 END AS fam FROM q UNION ALL SELECT b, a, score, CASE WHEN kind = 'quotation' THEN 'verbatim' ELSE 'relation' END, CASE WHEN kind = 'quotation' THEN 0 ELSE 1 END FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY self, other ORDER BY fam, strength DESC) AS n FROM e) SELECT self, other, kind, strength, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY self, kind ORDER BY strength DESC, other) AS k FROM o WHERE n = 1) WHERE k <= CASE WHEN kind = 'verbatim' THEN 6 ELSE 4 END""")
def related_passages(spark: SparkSession, sf: str) -> DataFrame:
    edges = R.both_ways(_edges(spark, sf).withColumnRenamed("kind", "relation"))
    return N.related([("verbatim", edges.where("relation = 'quotation'"), 6), ("relation", edges.where("relation <> 'quotation'"), 4)])


@query(f"WITH {_themes_sql()} SELECT id, source, rank FROM scores WHERE theme = 'origin' AND rank <= 5 ORDER BY id LIMIT 40")
def theme_browse(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).where("theme = 'origin'").select("id", "source", "rank").orderBy("id").limit(40)


@query(f"SELECT id, round(relevance, 6) AS relevance FROM ({_exact_sql(['that'])}) JOIN documents ON doc_id = id WHERE source = 'src4' AND lang = 'en' ORDER BY relevance DESC, id LIMIT 40")
def in_book_search(spark: SparkSession, sf: str) -> DataFrame:
    book = passages(spark, sf).where("source = 'src4' and lang = 'en'")
    own = FT.index(book, {"A": "text", "C": F.concat_ws(" ", "source", "lang")})
    return FT.exact(own, "that").orderBy(F.desc("relevance"), "id").limit(40).withColumn("relevance", F.round("relevance", 6))


_SUFFIXES = {"comparison": ["across texts", "differences"], "reading": ["full text"], "unknown": ["meaning", "related"]}


@query("WITH s AS (SELECT * FROM (VALUES ('comparison', 'across texts'), ('comparison', 'differences'), ('reading', 'full text'), ('unknown', 'meaning'), ('unknown', 'related')) v(intent, suffix)), i AS (" + f"SELECT item_id, text, CASE WHEN list_max(h) > 0 THEN {word_list(INTENT_KEYWORDS)}[list_position(h, list_max(h))] ELSE 'unknown' END AS intent FROM (SELECT item_id, text, [" + ", ".join(rf"len(list_filter({word_list(w)}, lambda w: contains(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), w)))" for w in INTENT_KEYWORDS.values()) + "] AS h FROM benchmark)) SELECT item_id, concat(substring(text, 1, 40), ' ', suffix) AS suggestion FROM i JOIN s USING (intent)")
def intent_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(i, s) for i, own in _SUFFIXES.items() for s in own], "intent string, suffix string")
    asked = table(spark, sf, "benchmark").select("item_id", "text", X.intent("text")["intent"].alias("intent"))
    return asked.join(F.broadcast(pairs), "intent").select("item_id", F.concat_ws(" ", F.substring("text", 1, 40), "suffix").alias("suggestion"))


@query()
def glossary_segments(spark: SparkSession, sf: str) -> DataFrame:
    cut = C.marked(passages(spark, sf).select("doc_id", "text"), ["of the", "that", "the", "und"])
    return cut.select("doc_id", F.posexplode("segments").alias("at", "s")).select("doc_id", "at", "s.part", "s.term")


@query(rf"SELECT doc_id, len(regexp_extract_all(lower(text), '\b(of the|that|the|und)\b')) AS terms FROM documents")
def glossary_counts(spark: SparkSession, sf: str) -> DataFrame:
    pattern = C.term_pattern(["of the", "that", "the", "und"])
    return passages(spark, sf).select("doc_id", F.regexp_count("text", F.lit(f"(?i){pattern}")).cast("long").alias("terms"))


@query("SELECT d.doc_id, d.lang, b.text AS translation FROM documents d JOIN benchmark b ON b.item_id = d.doc_id WHERE d.lang IN ('en', 'de')")
def parallel_translations(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "documents").where(R.in_list("lang", ["en", "de"])).select("doc_id", "lang")
    return named.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("translation")), "doc_id")


@query("""WITH w AS (SELECT DISTINCT p_brand AS lookup_word FROM part), e AS (SELECT p_brand AS lookup_word, CASE WHEN p_size = 1 THEN '__none__' WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END AS headword, (p_size % 4)::DOUBLE AS priority, CASE WHEN p_size % 2 = 0 THEN p_type END AS strong, p_partkey FROM part)
SELECT lookup_word, p_partkey, row_number() OVER (PARTITION BY lookup_word ORDER BY CASE WHEN headword = lookup_word THEN 0 ELSE 100 END + priority - CASE WHEN strong IS NOT NULL THEN 0.5 ELSE 0 END, headword, p_partkey) AS rank FROM w JOIN e USING (lookup_word) WHERE headword <> '__none__'""")
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.functions.similarity import lexicon_rank

    part = table(spark, sf, "part")
    entries = part.select(F.col("p_brand").alias("lookup_word"), F.when(F.col("p_size") == 1, "__none__").when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("headword"), (F.col("p_size") % 4).cast("double").alias("priority"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("strong"), "p_partkey")
    found = C.lexicon(entries, part.select(F.col("p_brand").alias("lookup_word")).distinct())
    order = Window.partitionBy("lookup_word").orderBy(lexicon_rank(F.col("headword") == F.col("lookup_word"), F.col("priority"), F.col("strong")), "headword", "p_partkey")
    return found.select("lookup_word", "p_partkey", F.row_number().over(order).alias("rank"))


@query(f"""WITH {_themes_sql()}, b AS (SELECT id, count(*) AS themes, max(score) AS top, max(score) FILTER (rank = 2) AS second FROM scores WHERE rank <= 5 GROUP BY id)
SELECT doc_id AS id, coalesce(themes, 0) AS themes, round(top, 6) AS top, top IS NULL OR top < 0.2 OR coalesce(top - second < 0.05, false) AS needs, 0.5::DOUBLE AS density FROM documents LEFT JOIN b ON id = doc_id""")
def theme_indexing(spark: SparkSession, sf: str) -> DataFrame:
    own = scores(spark, sf)
    return C.indexed(own, T.needs_judgement(own, passages(spark, sf))).withColumn("top", F.round("top", 6))


@query(f"""WITH f AS ({_exact_sql(['that'])}), r AS (SELECT id, row_number() OVER (ORDER BY relevance DESC, id) AS place FROM f) SELECT lang AS language, count(*) AS queries, count(*) FILTER (WHERE place <= 20) AS on_page, count(*) FILTER (WHERE place > 20 AND place <= 200) AS behind, round(count(*) FILTER (WHERE place <= 200) / count(*)::DOUBLE, 6) AS recall FROM documents LEFT JOIN r ON id = doc_id GROUP BY lang""")
def recall_tiers(spark: SparkSession, sf: str) -> DataFrame:
    top = FT.exact(posts(spark, sf), "that").orderBy(F.desc("relevance"), "id").limit(200)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")))  # the page, 200 rows
    hits = passages(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("language")).join(placed, "id", "left")
    return C.recall(hits).withColumn("recall", F.round("recall", 6))


@query("""WITH w AS (SELECT c_custkey AS user_id, greatest(0, least(1, c_acctbal / 5000)) AS thematic, (c_custkey % 3) / 2.0::DOUBLE AS linguistic FROM customer)
SELECT user_id, round(CASE WHEN t + l = 0 THEN 0.3 WHEN abs(t + l - 1) <= 0.001 THEN t ELSE t / (t + l) END, 6) AS thematic, round(CASE WHEN t + l = 0 THEN 0.3 WHEN abs(t + l - 1) <= 0.001 THEN l ELSE l / (t + l) END, 6) AS linguistic FROM (SELECT user_id, thematic AS t, linguistic AS l FROM w)""")
def user_weights(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 5000).alias("thematic"), ((F.col("c_custkey") % 3) / 2).alias("linguistic"))
    return C.stored_weights(own, ["thematic", "linguistic"]).select("user_id", F.round("thematic", 6).alias("thematic"), F.round("linguistic", 6).alias("linguistic"))


@query(f"""WITH {_CENTRES}, best AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) AS r FROM pred SEMI JOIN lab USING (id)) WHERE r = 1),
c AS (SELECT coalesce(a.label, b.label) AS label, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.id IS NULL) AS fp, count(*) FILTER (WHERE b.id IS NULL) AS fn FROM lab a FULL JOIN best b ON a.id = b.id AND a.label = b.label GROUP BY 1)
SELECT label, tp + fn AS support, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, 2 * tp / (2 * tp + fp + fn)::DOUBLE >= 0.55 AND tp + fn >= 100 AS reliable FROM c""")
def reliable_labels(spark: SparkSession, sf: str) -> DataFrame:
    truth = _labels(spark, sf)
    best = M.chosen_labels(_scores_of_labelled(spark, sf).withColumn("score", F.round("score", 9)), 2.0, 1, 1)
    return M.reliable(M.confusion(truth, best)).select("label", "support", F.round("f1", 6).alias("f1"), "reliable")


@query(f"""WITH {_CENTRES}, x AS (SELECT (lab.label = pred.label)::INT AS truth, round(score, 9) AS score, unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS cut FROM pred JOIN lab USING (id)), g AS (SELECT cut, count(*) FILTER (WHERE score >= cut AND truth = 1) AS tp, count(*) FILTER (WHERE score >= cut AND truth = 0) AS fp, count(*) FILTER (WHERE score < cut AND truth = 1) AS fn FROM x GROUP BY 1)
SELECT cut, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM g""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    own = _labels(spark, sf).withColumnRenamed("label", "own")
    told = _scores_of_labelled(spark, sf).join(own, "id").select(F.round("score", 9).alias("score"), (F.col("label") == F.col("own")).alias("truth"), F.explode(F.array(*map(F.lit, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)))).alias("cut"))
    said = F.col("score") >= F.col("cut")
    counted = told.groupBy("cut").agg(F.count_if(said & F.col("truth")).alias("tp"), F.count_if(said & ~F.col("truth")).alias("fp"), F.count_if(~said & F.col("truth")).alias("fn"))
    return counted.withColumn("f1", F.round(M.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'en-us' WHEN 1 THEN 'en-gb' WHEN 2 THEN 'de-de' ELSE '' END AS voice,
CASE o_custkey % 3 WHEN 0 THEN 'en-us' WHEN 1 THEN 'de' ELSE '' END AS want, o_orderstatus = 'O' AS loc, o_orderpriority = '1-URGENT' AS dflt FROM orders),
s AS (SELECT *, CASE WHEN want = '' THEN dflt::INT::DOUBLE WHEN voice = want THEN CASE WHEN loc THEN 40 ELSE 20 END + CASE WHEN dflt THEN 5 ELSE 0 END
WHEN voice <> '' AND split_part(voice, '-', 1) = split_part(want, '-', 1) THEN CASE WHEN loc THEN 15 ELSE 8 END + CASE WHEN dflt THEN 2 ELSE 0 END WHEN dflt THEN 0.5 ELSE -1 END AS score FROM v)
SELECT o_custkey, o_orderkey AS best, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM s WHERE score > 0) WHERE n = 1""")
def best_voice(spark: SparkSession, sf: str) -> DataFrame:
    """Of each reader's voices (orders stand in for them) the first of those that fit best; none where nothing fits."""
    tag = F.when(F.col("o_orderkey") % 4 == 0, "en_US").when(F.col("o_orderkey") % 4 == 1, "en-GB").when(F.col("o_orderkey") % 4 == 2, "de-DE").otherwise("")
    want = F.when(F.col("o_custkey") % 3 == 0, "en-us").when(F.col("o_custkey") % 3 == 1, "DE").otherwise("")
    score = C.voice_score(tag, want, F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT")
    voices = table(spark, sf, "orders").select("o_custkey", "o_orderkey", score.alias("score")).where("score > 0")
    return voices.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("score", -F.col("o_orderkey"))).alias("best"), F.max("score").alias("score"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'fresh' ELSE 'cached' END AS origin, coalesce(quality, (n_chars > 1000)::INT) AS value FROM documents LEFT JOIN labels USING (doc_id)")
def read_through(spark: SparkSession, sf: str) -> DataFrame:
    cached = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("value"))
    fresh = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("value"))
    return C.resolved(cached, fresh, ["doc_id"], "value")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'bad' END, lang) AS answer, CASE WHEN quality = 1 THEN 'first' WHEN toxic = 1 THEN 'second' ELSE 'local' END AS source FROM documents LEFT JOIN labels USING (doc_id)")
def judge_chain(spark: SparkSession, sf: str) -> DataFrame:
    told = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    engines = told.select("doc_id", F.when(F.col("quality") == 1, "good").alias("first"), F.when(F.col("toxic") == 1, "bad").alias("second"), F.col("lang").alias("local"))
    return C.first_answer(engines, ["first", "second", "local"]).select("doc_id", "answer", "source")


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE spent > 10000) AS refused FROM (SELECT event_type, sum(value) OVER (PARTITION BY event_type ORDER BY event_id) AS spent FROM events) GROUP BY 1")
def spend_cap(spark: SparkSession, sf: str) -> DataFrame:
    told = C.within_cap(table(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("cost")), "event_id", 10_000, "event_type")
    return told.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if("refused").alias("refused"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def rate_limits(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > 3).alias("limited"))


@query(f"WITH {_themes_sql()} SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM scores WHERE theme = 'sein' AND score >= 0.3 GROUP BY source HAVING count(*) >= 5)")
def theme_absent(spark: SparkSession, sf: str) -> DataFrame:
    there = T.compared(scores(spark, sf).drop("rank"), "sein", "source").select("source").distinct()
    return table(spark, sf, "documents").select("source").distinct().join(there, "source", "left_anti")


@query("SELECT lang AS language, count(*) AS terms, max(n) AS best FROM (SELECT lang, w, count(DISTINCT doc_id) AS n FROM (SELECT lang, doc_id, unnest(" + words_sql("text") + ") AS w FROM documents) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 8) GROUP BY 1")
def language_terms(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("lang", F.explode(F.array_distinct(FT.tokens("text"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    return own.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("terms"), F.max("n").alias("best"))
