"""Readers of corpus sources: Parquet and JSON with explicit schemas, archives, and marked-up scripture."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("doc_id").alias("verse_order"))


def json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def paged_verses(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, verse, original, translations) of landed pages of a paged source; fails unless every page of a chapter is there.

    Blank translations go; of the others the rendering whose resource comes first is the primary one.
    """
    pages = spark.read.schema(schemas.PAGED_JSON).option("mode", "FAILFAST").json(path)
    walked = pages.groupBy("chapter").agg(F.countDistinct("pagination.current_page").alias("there"), F.max("pagination.total_pages").alias("total"))
    whole = walked.select("chapter", F.when(F.col("there") == F.col("total"), True).otherwise(F.raise_error(F.lit("a page of a chapter is missing"))).cast("boolean").alias("whole"))
    verses = pages.select("chapter", F.explode("verses").alias("v"))
    rendered = F.array_sort(F.filter(F.transform("v.translations", lambda t: F.struct(t["resource_id"].alias("resource"), F.trim(t["text"]).alias("text"))), lambda t: t["text"] != ""))
    told = verses.select("chapter", F.col("v.verse_number").alias("verse"), F.col("v.text").alias("original"), rendered.alias("translations"))
    return told.join(whole.where("whole"), "chapter").drop("whole").where(F.size("translations") > 0)


def books(spark: SparkSession, path: str, names: Sequence[str], offset: int = 0, expected: int | None = None, multi_line: bool = True) -> DataFrame:
    """Nested books of files as verses (book, position, chapter, verse, text, verse_order), named by their place in the file from `offset` on.

    Each file is a volume or, without multi_line, each line of them. Fails unless every volume has `expected` books and every
    book that is named has a chapter. Blank verses go, white space inside verses is single; verse_order runs through all
    books of a volume.
    """
    file = spark.read.text(path, wholetext=multi_line).select(F.monotonically_increasing_id().alias("volume"), F.from_json("value", schemas.BULK_JSON).alias("b"))
    size = expected if expected is not None else offset + len(names)
    checked = file.select("volume", F.when(F.size("b") == size, F.col("b")).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} books, found "), F.size("b").cast("string"))).cast(schemas.BULK_JSON)).alias("b"))
    order = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, book string")
    placed = checked.select("volume", F.posexplode("b").alias("at", "s")).select("volume", (F.col("at") - offset).alias("position"), "s.chapters").join(F.broadcast(order), "position")  # names are an argument
    filled = placed.select("volume", "book", "position", F.when(F.size("chapters") > 0, F.col("chapters")).otherwise(F.raise_error(F.concat(F.lit("no chapters for "), "book")).cast("array<array<string>>")).alias("chapters"))
    chapters = filled.select("volume", "book", "position", F.posexplode("chapters").alias("c", "verses"))
    verses = chapters.select("volume", "book", "position", (F.col("c") + 1).alias("chapter"), F.posexplode("verses").alias("v", "raw"))
    told = verses.select("volume", "book", "position", "chapter", (F.col("v") + 1).alias("verse"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text")).where("text <> ''")
    return told.withColumn("verse_order", F.row_number().over(Window.partitionBy("volume").orderBy("position", "chapter", "verse"))).drop("volume")  # a volume is one row of its file


def parallel_verses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Original and translation side by side by place; verses with either blank go."""
    rows = json_rows(spark, path, schemas.PARALLEL_JSON, multi_line)
    both = rows.select("book", "chapter", F.posexplode(F.arrays_zip("original", "translation")).alias("i", "v"))
    return both.select("book", "chapter", (F.col("i") + 1).alias("verse"), F.col("v.original").alias("original"), F.col("v.translation").alias("translation")).where("length(trim(original)) > 0 and length(trim(translation)) > 0")


def edition(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return json_rows(spark, path, schemas.EDITION_JSON, multi_line).select(F.explode("hadiths").alias("h")).select(F.col("h.hadithnumber").alias("number"), F.col("h.reference.book").alias("book"), F.col("h.text").alias("text"))


def two_editions(original: DataFrame, translation: DataFrame) -> DataFrame:
    """Joined by number; a missing translation is empty."""
    return original.select("number", "book", F.col("text").alias("original")).join(translation.select("number", F.col("text").alias("translation")), "number", "left").withColumn("translation", F.coalesce("translation", F.lit("")))


def attached(passages: DataFrame, originals: DataFrame, keys: Sequence[str], force: bool = False, language: str | None = None) -> DataFrame:
    """Passages with originals where theirs are empty (or, with force, wherever there is one). Never adds a passage.

    With `language`, passages that get an original are of that language from then on.
    """
    new = originals.select(*keys, F.col("original").alias("_new")).where(F.length("_new") > 0)
    gets = F.col("_new").isNotNull() & (F.lit(force) | (F.coalesce("original", F.lit("")) == ""))
    told = passages.join(new, list(keys), "left").withColumn("_gets", gets)
    told = told.withColumn("original", F.when(F.col("_gets"), F.col("_new")).otherwise(F.col("original")))
    if language is not None:
        told = told.withColumn("language", F.when(F.col("_gets"), language).otherwise(F.col("language")))
    return told.select(*passages.columns)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, text) of every file in archives; Spark reads the archives, tasks open them."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if not name.endswith("/"):
                            yield pd.DataFrame({"archive": [archive], "name": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "archive string, name string, text string")


def usfm_verses(files: DataFrame, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(name, chapter, verse, text) of marked-up scripture: lines carry the last chapter and verse; headings are left out."""
    from lectern.functions.text import strip_usfm

    lines = files.select(name_col, F.posexplode(F.split(F.regexp_replace(text_col, r"(\\[cv]\s)", "\n$1"), "\n")).alias("at", "line"))
    heading = F.col("line").rlike(r"^\s*\\(id|h|toc|mt|s|r|d|ms|ide|rem)\d*\b")
    chapter = F.when(F.col("line").rlike(r"^\s*\\c\s"), F.regexp_extract("line", r"\\c\s+(\d+)", 1).cast("int"))
    verse = F.when(F.col("line").rlike(r"^\s*\\v\s"), F.regexp_extract("line", r"\\v\s+(\d+)", 1).cast("int")).when(chapter.isNotNull(), F.lit(0))
    order = Window.partitionBy(name_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.where(~heading).select(name_col, "at", "line", F.last(chapter, ignorenulls=True).over(order).alias("chapter"), F.last(verse, ignorenulls=True).over(order).alias("verse"))
    text = strip_usfm(F.regexp_replace("line", r"^\s*\\[cv]\s+\d+", ""))
    told = placed.where("verse > 0").select(name_col, "chapter", "verse", "at", text.alias("part")).where("part <> ''")
    return told.groupBy(name_col, "chapter", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), " ").alias("text"))


def patches(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(passage_key, correct) from JSON objects of texts by key: each file is one or, without multi_line, each line of them."""
    return spark.read.text(path, wholetext=multi_line).select(F.explode(F.from_json("value", "map<string,string>")).alias("passage_key", "correct"))


# Words before a citation that say which texts it is from.
CORPUS_HINTS = (
    (r"q|qur'?an|quran|sura|surah|chapter", ("quran",)),
    (r"t|talmud|gemara", ("talmud",)),
    (r"ot|old testament", ("ot", "torah")),
    (r"nt|new testament", ("nt",)),
    (r"torah", ("torah", "ot")),
)
#: The text whose books are its chapters: a book's number has to be the chapter that is asked for, and holds one chapter.
NUMBERED, NUMBERED_BOOKS = "quran", 114


def citations(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Citations resolved against (alias, text_id, book): text_id, book, chapter, verse and passage_key for each book that the alias may mean.

    "book chapter:verse", "book chapter.verse", or behind the name of a text "chapter:verse" alone; 80 characters at most.
    Aliases are compared in lower case without dots and apostrophes, other signs as spaces.
    """
    text = F.lower(F.trim(F.col(column)))
    any_hint = "^(?:" + "|".join(f"(?:{p})" for p, _ in CORPUS_HINTS) + r")\b\s*"
    hinted = F.lit(None).cast("array<string>")
    for pattern, texts in reversed(CORPUS_HINTS):
        hinted = F.when(text.rlike(rf"^(?:{pattern})\b"), F.array(*map(F.lit, texts))).otherwise(hinted)
    said = df.where(F.length(F.trim(F.col(column))).between(1, 80)).withColumns({"_rest": F.trim(F.regexp_replace(text, any_hint, "")), "_texts": hinted})
    part = lambda i: F.regexp_extract("_rest", r"^(?:(.+?)[\s:]+)?(\d+)[:.](\d+)$", i)
    read = said.select("*", part(1).alias("_book"), part(2).alias("_chapter"), part(3).try_cast("int").alias("verse"))
    # without a book the chapter is the book, where a text was named
    alone = (F.col("_book") == "") & F.col("_texts").isNotNull() & ~F.contains("_rest", F.lit("."))
    key = F.when(alone, F.col("_chapter")).otherwise(F.trim(F.regexp_replace(F.regexp_replace("_book", "[.'’]", ""), "[^a-z0-9]+", " ")))
    parsed = read.select(*said.columns, key.alias("alias"), F.col("_chapter").try_cast("int").alias("chapter"), "verse").where("alias <> '' and chapter >= 1 and verse >= 1")
    own = parsed.join(aliases, "alias").where(F.col("_texts").isNull() | F.array_contains("_texts", F.col("text_id")))
    numbered = F.col("text_id") == NUMBERED
    other = numbered & F.col("chapter").between(1, NUMBERED_BOOKS) & (F.col("chapter") != F.coalesce(F.col("book").try_cast("int"), F.lit(-1)))
    told = own.where(~other).withColumn("chapter", F.when(numbered, 1).otherwise(F.col("chapter")))
    place = F.concat_ws(":", "text_id", "book", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    return told.withColumn("passage_key", place).drop("_rest", "_texts").dropDuplicates([*df.columns, "passage_key"])
