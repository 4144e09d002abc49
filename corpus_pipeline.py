"""Documents to shards in five stages: quality, near duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table, written
from lectern.llm.decontaminate import cleaned
from lectern.llm.minhash import deduplicated
from lectern.llm.mixing import mixed, tempered
from lectern.llm.quality import selected
from lectern.llm.sharding import balanced_shards

SHARDS = 40
#: Sources weigh their share of rows to this power.
TEMPER = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is a half or more; null, empty and blank texts have none and go.

    Rows are judged by their texts alone: repeated rows, ids that are null or have several texts, and columns of any name stay as
    they are. Null grades and ids of ratings are left out; with fewer than two grades every row stays. An empty table gives none.
    """
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return selected(docs, ratings)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: one with its smallest id.

    Null, empty and blank texts, and rows with a null id, are near nothing and stay. Different texts of one id are judged one by one, so
    only rows with a link go, and all but one of rows that are equal in id and text. Columns may have any names; an empty table gives none.
    """
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly such passages go.

    Every row is cut by its own text, whatever its id; rows without a match, null and empty texts among them, stay as they are.
    Null items match nothing, repeated ones count once. Columns may have any names; an empty table gives none.
    """
    return cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix: sources keep their target weights as long as they have rows.

    A source that is used up leaves, the weights of the others are renormalised, and no row of any source is lost by it. A null
    source is one like others; equal ids, null ones too, follow each other. Columns may have any names; an empty table gives none.
    """
    return mixed(docs, tempered(docs, TEMPER)).orderBy("mix_position").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its place there; equal texts stay together as far as even sizes allow.

    Slots follow the order of docs, the mix, and rows without links are dealt to the shards in turns: the first slots of all shards
    are the beginning of the mix, and each shard goes through all of it. Counts of shards are at most one apart. Null texts have no
    bytes and are linked with nothing; repeated rows are rows of their own, and so are those with null ids. Other columns are left
    out; an empty table gives none.
    """
    return balanced_shards(docs, SHARDS, in_order=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier is fitted, so SQL can't express run(); tests/llm/test_pipeline.py compares it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
