"""Queries of filters, joins, aggregations, windows and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import relational as R
from lectern.plans.registry import query
from lectern.sources.readers import table


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount >= 0.05 AND l_quantity < 5 AND l_linestatus <> 'O'")
def filters_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    where = R.conjunction([R.in_list("l_returnflag", ["A", "R"]), R.in_list("l_suppkey", []), F.col("l_discount") >= 0.05, F.col("l_quantity") < 5, F.col("l_linestatus") != "O"])
    return table(spark, sf, "lineitem").where(where).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT doc_id, source, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic = 1 OR l.quality = 0))")
def theme_semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "labels").where("toxic = 1 or quality = 0")
    return table(spark, sf, "documents").join(marked, "doc_id", "left_semi").select("doc_id", "source", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unjudged_passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT d.doc_id, d.source, k.i AS position FROM documents d JOIN (VALUES (17, 0), (3, 1), (99, 2), (0, 4)) k(doc_id, i) ON d.doc_id = k.doc_id")
def passage_by_keys_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return R.in_order(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", [17, 3, 99, -5, 0, 3]).orderBy("position")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42 OR concat(source, ':', doc_id) = 'src7:42'")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.col("doc_id") == 42) | (F.concat_ws(":", "source", F.col("doc_id").cast("string")) == "src7:42")).select("doc_id", "source", "lang", "n_chars")


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' ORDER BY conv_id, turn LIMIT 50 OFFSET 25")
def chapter_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", "role"), ["conv_id", "turn"], 25, 50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 35")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.after(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 35)


@query("""SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS ring_next
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def reader_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return R.neighbours(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")


@query("SELECT conv_id, count(*) AS verses, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def chapter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("verses"), F.max("turn").alias("last_turn"))


@query("""SELECT d.source AS text_id, count(*) AS passages, count(DISTINCT d.lang) AS languages, count(l.doc_id) AS judged, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) - count(l.doc_id) AS unindexed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("has")), "doc_id", "left")
    return both.groupBy(F.col("source").alias("text_id")).agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("lang").alias("languages"), F.count("has").alias("judged"), F.count_if(F.col("toxic") == 1).alias("toxic"), (F.count(F.lit(1)) - F.count("has")).alias("unindexed"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, grouping(r_name, n_name) AS level
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    # orders are counted by customer first, so the large table is reduced before any other join
    by_customer = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(by_customer, "c_custkey", "left")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orders"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def primary_translation_top1(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct(F.col("l_returnflag") == "R", "l_extendedprice", -F.col("l_linenumber")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS passage, p_brand AS theme, max(l_discount) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT o.theme, count(*) AS passages, round(avg(o.score), 6) AS mean_score FROM t c JOIN t o ON c.passage = o.passage AND o.theme <> c.theme WHERE c.theme = (SELECT min(p_brand) FROM part) GROUP BY o.theme ORDER BY passages DESC, o.theme LIMIT 20""")
def theme_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.themes import cooccurring

    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    first = parts.agg(F.min("p_brand")).first()[0]
    themes = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("theme")).agg(F.max("l_discount").alias("score"))
    return cooccurring(themes, first).withColumn("mean_score", F.round("mean_score", 6))


@query("""SELECT p_brand, count(*) AS passages, count(DISTINCT s_nationkey) AS texts, count(DISTINCT concat(s_nationkey, ':', l_suppkey)) AS books FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY p_brand HAVING count(*) >= 150 AND count(DISTINCT s_nationkey) >= 4""")
def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.themes import coverage

    labels = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return coverage(labels, "p_brand", "s_nationkey", F.concat_ws(":", F.col("s_nationkey").cast("string"), F.col("l_suppkey").cast("string")))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE n_chars > 500) AS total FROM documents WHERE n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 20")
def search_window_total(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").where("n_chars > 500").select("doc_id", "n_chars")
    # a total by aggregate: a window without partitions would bring all rows to one task
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(20).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("SELECT source, doc_id, n_chars, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 6")
def topn_per_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_n(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 6)


@query("SELECT source, lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source, lang")
def best_per_book(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("""WITH a AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT source, lang, doc_id, n_chars, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (k > 1)::INT, n_chars DESC, doc_id) AS n FROM a) WHERE n <= 6""")
def diverse_members(spark: SparkSession, sf: str) -> DataFrame:
    return R.diverse(table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars"), "source", "lang", [F.desc("n_chars"), F.col("doc_id")], 6)


@query("""WITH a AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS q FROM documents)
SELECT source, doc_id, n_chars, row_number() OVER (ORDER BY r, q DESC, source) AS position FROM a ORDER BY r, q DESC, source LIMIT 60""")
def interleave_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.interleaved(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 60)


@query("""WITH o AS (SELECT greatest(2, floor(30 * 0.75 / greatest(1, count(DISTINCT source) - 1)))::INT AS each FROM documents)
SELECT source, doc_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents), o WHERE n <= CASE WHEN source = 'src0' THEN 7 ELSE o.each END""")
def crossref_quota_pool(spark: SparkSession, sf: str) -> DataFrame:
    return R.quota_pool(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "src0", [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "rank")


@query("""WITH a AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, 1 FROM conversations GROUP BY 1), asked AS (SELECT conv_id, t AS turn, min(i) AS asked FROM (SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC) AS i FROM a) GROUP BY 1, 2)
SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY asked ASC NULLS LAST, c.turn) - 1 AS new_position FROM conversations c LEFT JOIN asked USING (conv_id, turn)""")
def journey_pack_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("t")).unionByName(rows.select("conv_id").distinct().withColumn("t", F.lit(1).cast("long")))
    asked = ends.select("conv_id", F.col("t").alias("turn"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("t"))).alias("asked"))
    return R.repacked(rows, "conv_id", "turn", "turn", asked).select("conv_id", "turn", F.col("new_position").cast("long").alias("new_position"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), s AS (SELECT l_orderkey FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_orderkey IN (SELECT l_orderkey FROM s) GROUP BY 1, 2""")
def unordered_pairs_shared_theme(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return R.pairs_within(held, "l_orderkey", "l_suppkey", most=6).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH t AS (SELECT l_orderkey AS id, p_brand AS theme, max(l_discount) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT theme, count(*) AS passages, round(avg(score), 6) AS mean_score FROM t GROUP BY theme HAVING count(*) >= 2""")
def shared_themes(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.themes import shared_themes as found

    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    scores = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("theme")).agg(F.max("l_discount").alias("score"))
    return found(scores).withColumn("mean_score", F.round("mean_score", 6))


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE o_totalprice + 1 END AS v FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT CASE WHEN old.k IS NULL THEN 'insert' WHEN new.k IS NULL THEN 'keep' WHEN old.v IS NOT DISTINCT FROM new.v THEN 'same' ELSE 'update' END AS action, count(*) AS n FROM old FULL JOIN new ON old.k = new.k GROUP BY 1""")
def diff_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("v"))
    return R.changes(old, new, ["k"], "v").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH old AS (SELECT l_orderkey, l_linenumber, 'old' AS side FROM lineitem WHERE l_returnflag <> 'N'), new AS (SELECT DISTINCT l_orderkey, l_linenumber, 'new' AS side FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
SELECT * FROM old WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def replace_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    old = rows.where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", F.lit("old").alias("side"))
    new = rows.where("l_shipdate >= timestamp '1998-01-01'").select("l_orderkey", "l_linenumber", F.lit("new").alias("side"))
    return R.replaced(old, new, ["l_orderkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'old' ELSE 'new' END AS side FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    return R.inserted(rows.where("c_acctbal > 0").select("c_custkey", F.lit("old").alias("side")), rows.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("new").alias("side")), ["c_custkey"])


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS strength, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS detected_by FROM orders""")
def upsert_some_columns(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    row = lambda df, v, by: df.select(F.col("o_orderkey").alias("k"), v.alias("strength"), F.lit(by).alias("detected_by"))
    price = F.col("o_totalprice")
    old = row(orders.where("o_orderstatus <> 'P'"), price, "old")
    new = row(orders.where("o_orderstatus <> 'O'"), F.when(F.col("o_orderstatus") == "F", price + 1).otherwise(price), "new")
    return R.merged_columns(old, new, ["k"], ["strength"])


@query("""WITH e AS (SELECT l_orderkey AS s, l_partkey AS t, l_discount AS v FROM lineitem), u AS (SELECT least(s, t) AS low, greatest(s, t) AS high, max(v) AS strength FROM e WHERE s <> t GROUP BY 1, 2) SELECT low, high, strength FROM u""")
def upsert_unordered(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").where("l_orderkey <> l_partkey")
    return e.groupBy(F.least("l_orderkey", "l_partkey").alias("low"), F.greatest("l_orderkey", "l_partkey").alias("high")).agg(F.max("l_discount").alias("strength"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.deleted(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("""SELECT count(*) FILTER (WHERE old <> new) AS applied, count(*) FILTER (WHERE old = new) AS already_correct, count(*) FILTER (WHERE old IS NULL) AS missing FROM (SELECT p.k, p.new, c.c_mktsegment AS old FROM (SELECT c_custkey + 10 AS k, upper(c_mktsegment) AS new FROM customer) p LEFT JOIN customer c ON c.c_custkey = p.k)""")
def corrections_report(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.sources.sinks import corrected

    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("passage_key"), F.col("c_mktsegment").alias("text"))
    patch = customers.select((F.col("passage_key") + 10).alias("passage_key"), F.upper("text").alias("correct"))
    return corrected(customers, patch)[1]


@query("""SELECT c.c_custkey, c.c_name, o.o_orderkey IS NULL AS missing, count(o.o_orderkey) OVER (PARTITION BY c.c_custkey) AS saved FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000""")
def library_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    saved = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = table(spark, sf, "customer").select("c_custkey", "c_name").join(saved, "c_custkey", "left")
    return joined.select("c_custkey", "c_name", F.col("o_orderkey").isNull().alias("missing"), F.count("o_orderkey").over(Window.partitionBy("c_custkey")).alias("saved"))


@query("SELECT vec_id, label, embedding IS NULL OR len(embedding) = 0 AS missing FROM embeddings")
def null_or_empty_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.col("embedding").isNull() | (F.size("embedding") == 0)).alias("missing"))


@query("SELECT label, count(*) AS vectors, count(*) FILTER (WHERE len(embedding) > 0) AS embedded FROM embeddings GROUP BY label")
def embedded_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size("embedding") > 0).alias("embedded"))


@query("""WITH n AS (SELECT conv_id, count(*) AS nodes, string_agg(DISTINCT role, ',' ORDER BY role) AS corpora FROM conversations GROUP BY 1) SELECT conv_id, nodes, corpora FROM n""")
def journey_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("corpora"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS verse_order FROM documents")
def dense_order(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return R.numbered(docs, ["source"], [F.col("lang"), F.col("doc_id")], "verse_order").select("source", "doc_id", F.col("verse_order").cast("long").alias("verse_order"))


@query("""SELECT d.doc_id, coalesce(b.text, d.text) AS shown, b.text IS NOT NULL AS chosen FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def translation_overlay(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    return table(spark, sf, "documents").select("doc_id", "text").join(chosen, "doc_id", "left").select("doc_id", F.coalesce("other", "text").alias("shown"), F.col("other").isNotNull().alias("chosen"))


@query("""SELECT n, CASE WHEN n >= 100 AND total > n THEN total ELSE n END AS reported FROM (SELECT least(100, count(*)) AS n, count(*) AS total FROM documents WHERE lang = 'de')""")
def total_count_rule(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "documents").where("lang = 'de'").agg(F.count(F.lit(1)).alias("total")).withColumn("n", F.least(F.lit(100).cast("long"), F.col("total")))
    return counted.select("n", F.when((F.col("n") >= 100) & (F.col("total") > F.col("n")), F.col("total")).otherwise(F.col("n")).alias("reported"))
