"""Queries that land a table in the form of an outside source and read it back by the source's reader; models and readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import ml as M
from lectern.plans.learning import _CENTRES, _labels, _vectors
from lectern.plans.registry import query
from lectern.sources import readers, sinks
from lectern.sources.readers import table
from lectern.sources.shared import shared_dir


def _landed(df: DataFrame, column: str = "value") -> str:
    """The strings of a column as lines of files in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/lectern-{uuid.uuid4().hex}"
    df.select(F.col(column).alias("value")).write.text(path)
    return path


@query("SELECT conv_id AS chapter, turn AS verse, role AS original, trim(text) AS translation FROM conversations WHERE length(trim(text)) > 0")
def paged_source(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters in pages of three verses, with nested translations."""
    turns = table(spark, sf, "conversations")
    verse = F.struct(F.col("turn").alias("verse_number"), F.col("role").alias("text"), F.array(F.struct(F.lit(1).alias("resource_id"), "text")).alias("translations"))
    pages = turns.groupBy("conv_id", F.floor(F.col("turn") / 3).cast("int").alias("page")).agg(F.collect_list(verse).alias("verses"))
    total = pages.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    told = pages.join(total, "conv_id").select(F.to_json(F.struct(F.col("conv_id").alias("chapter"), "verses", F.struct((F.col("page") + 1).alias("current_page"), F.col("n").alias("total_pages")).alias("pagination"))).alias("value"))
    return readers.paged_verses(spark, _landed(told)).select("chapter", "verse", "original", F.col("translations")[0]["text"].alias("translation"))


@query("""WITH v AS (SELECT item_id, item_id // 10 % 4 AS book, item_id % 10 AS i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark)
SELECT concat('book ', book) AS book, (book - 1)::INT AS position, (i // 5 + 1)::INT AS chapter, (i % 5 + 1)::INT AS verse, text, row_number() OVER (PARTITION BY item_id // 40 ORDER BY item_id)::INT AS verse_order FROM v WHERE book BETWEEN 1 AND 3 AND text <> ''""")
def bulk_source(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes of four nested books of two chapters, a line each, three of the books named by their places; what the last volume lacks is blank."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    last = items.agg(F.max("item_id")).first()[0]
    items = spark.range(((-1 if last is None else last) // 40 + 1) * 40).withColumnRenamed("id", "item_id").join(items, "item_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    chapters = items.groupBy(F.floor(F.col("item_id") / 10).alias("book"), F.floor(F.col("item_id") % 10 / 5).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda v: v["text"]).alias("verses"))
    books = chapters.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "verses"))), lambda c: c["verses"]).alias("chapters"))
    whole = books.groupBy(F.floor(F.col("book") / 4)).agg(F.transform(F.array_sort(F.collect_list(F.struct("book", "chapters"))), lambda b: F.struct(F.lit("x").alias("abbrev"), F.lit("x").alias("name"), b["chapters"].alias("chapters"))).alias("all"))  # 40 verses a volume
    return readers.books(spark, _landed(whole.select(F.to_json("all").alias("value"))), ["book 1", "book 2", "book 3"], offset=1, expected=4, multi_line=False)


@query("SELECT item_id // 10 AS chapter, item_id % 10 + 1 AS verse, text AS original, reverse(text) AS translation FROM benchmark WHERE length(trim(text)) > 0")
def parallel_source(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters with one list of originals and one of translations."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    told = items.groupBy(F.floor(F.col("item_id") / 10).cast("int").alias("chapter")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("v"))
    lines = told.select(F.to_json(F.struct(F.lit("b").alias("book"), "chapter", F.transform("v", lambda v: v["text"]).alias("original"), F.transform("v", lambda v: F.reverse(v["text"])).alias("translation"))).alias("value"))
    read = readers.parallel_verses(spark, _landed(lines.repartition("value")), multi_line=False)
    return read.select(F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), "original", "translation")


@query("SELECT item_id AS number, 1 AS book, text AS original, CASE WHEN item_id % 2 = 0 THEN reverse(text) ELSE '' END AS translation FROM benchmark")
def edition_source(spark: SparkSession, sf: str) -> DataFrame:
    """Two editions by number, the second with gaps, landed as lines of a hundred records at most."""

    def edition(rows: DataFrame) -> DataFrame:
        record = F.struct(F.col("item_id").alias("hadithnumber"), "text", F.struct(F.lit(1).alias("book"), F.col("item_id").alias("hadith")).alias("reference"))
        lines = rows.groupBy(F.floor(F.col("item_id") / 100).alias("part")).agg(F.collect_list(record).alias("hadiths"))
        return readers.edition(spark, _landed(lines.select(F.to_json(F.struct("hadiths")).alias("value"))), multi_line=False)

    items = table(spark, sf, "benchmark")
    both = readers.two_editions(edition(items), edition(items.where("item_id % 2 = 0").withColumn("text", F.reverse("text"))))
    return both.select(F.col("number").cast("long").alias("number"), "book", "original", "translation")


@query("SELECT conv_id::VARCHAR AS name, 1 AS chapter, (turn + 1)::INT AS verse, trim(regexp_replace(regexp_replace(text, '\\\\', '', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(regexp_replace(text, '\\\\', '', 'g'), '\\s+', ' ', 'g')) <> ''")
def marked_up_source(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters as marked-up scripture, verses with a note and a marker."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", r"\\", ""), r"\s+", " ").alias("text"))
    line = F.concat(F.lit("\n\\v "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.replace("text", F.lit("|"), F.lit("¦")), F.lit(r"\f + \ft a note\f*"))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda t: t["line"]), "").alias("verses"))
    told = files.select(F.col("conv_id").cast("string").alias("name"), F.concat(F.lit("\\id X\n\\c 1"), "verses").alias("text"))
    read = readers.usfm_verses(told)
    return read.select("name", "chapter", "verse", F.replace("text", F.lit("¦"), F.lit("|")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND b.text IS NOT NULL THEN b.text WHEN doc_id % 2 = 0 THEN '' ELSE 'own' END AS original, CASE WHEN doc_id % 2 = 0 AND b.text IS NOT NULL THEN 'hebrew' ELSE lang END AS language FROM documents LEFT JOIN benchmark b ON item_id = doc_id")
def attached_originals(spark: SparkSession, sf: str) -> DataFrame:
    """Originals filled in where there is none, with their language."""
    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise("own").alias("original"), F.col("lang").alias("language"))
    return readers.attached(rows, table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("original")), ["doc_id"], language="hebrew")


@query("""SELECT count(*) FILTER (b.text IS NOT NULL AND b.text <> upper(b.text)) AS applied, count(*) FILTER (b.text IS NOT NULL AND b.text = upper(b.text)) AS already_correct, count(*) FILTER (b.text IS NULL) AS missing
FROM (SELECT item_id + 5 AS k FROM benchmark) p LEFT JOIN benchmark b ON b.item_id = p.k""")
def patched_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of a hundred keys at most read and applied: every item's text in capitals, and five keys too many."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("passage_key"), "text")
    shifted = table(spark, sf, "benchmark").select((F.col("item_id") + 5).cast("string").alias("k"), F.floor(F.col("item_id") / 100).alias("part")).join(items.withColumnRenamed("passage_key", "k"), "k", "left")
    whole = shifted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("k", F.coalesce(F.upper("text"), F.lit("none"))))).alias("m"))  # a patch
    return sinks.corrected(items, readers.patches(spark, _landed(whole.select(F.to_json("m").alias("value"))), multi_line=False))[1]


@query(f"WITH {_CENTRES} SELECT label, term, round(weight, 4) AS weight FROM cen")
def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids as they are stored and read back, rounded to four places."""
    return M.saved_model(M.centroids(_vectors(spark, sf), _labels(spark, sf)), f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}")


@query("""WITH a AS (SELECT DISTINCT source AS text_id, lang AS book, concat(lang, ' book') AS alias FROM documents)
SELECT doc_id, text_id || ':' || book || ':' || (1 + doc_id % 50) || ':' || (1 + doc_id % 9) AS passage_key FROM documents d JOIN a ON a.alias = concat(d.lang, ' book') WHERE doc_id % 4 <> 3""")
def resolved_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in several spellings, some of them no citation, against the books that an alias may mean."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    number = F.concat((1 + F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, ":").otherwise("."), (1 + F.col("doc_id") % 9).cast("string"))
    said = F.when(F.col("doc_id") % 4 == 3, F.concat(F.col("lang"), F.lit(" book alone"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("  "), F.upper("lang"), F.lit(". Book "), number)).otherwise(F.concat(F.col("lang"), F.lit(" book "), number))
    aliases = docs.select(F.concat(F.col("lang"), F.lit(" book")).alias("alias"), F.col("source").alias("text_id"), F.col("lang").alias("book")).distinct()
    return readers.citations(docs.select("doc_id", said.alias("q")), "q", aliases).select("doc_id", "passage_key")


@query(r"""SELECT doc_id, regexp_matches(text, '[א-ת]{2}') AS hebrew FROM documents""")
def lexicon_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.lexicon_candidate("text").alias("hebrew"))
