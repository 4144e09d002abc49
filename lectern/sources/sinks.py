"""Writes. There is no table format, so a merge writes the merged rows to a new path and then swaps directories by name."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import changes, inserted, merged, replaced


def rewritten(df: DataFrame, path: str) -> str:
    """Writes df to a new version under path and returns where; the caller's catalog points readers there.

    Readers of the old version aren't disturbed, and a lost executor only repeats a task.
    """
    place = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(place)
    return place


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str, order: Sequence[str] = ()) -> str:
    return rewritten(merged(old, new, keys, order), path)


def replace_groups(old: DataFrame, new: DataFrame, group: Sequence[str], keys: Sequence[str], path: str, order: Sequence[str] = ()) -> str:
    return rewritten(replaced(old, new, group, keys, order), path)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str, order: Sequence[str] = ()) -> str:
    return rewritten(inserted(old, new, keys, order), path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def corrected(texts: DataFrame, patch: DataFrame, key: str = "passage_key", value: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with a patch applied, and one row of how many were applied, already correct, or missing."""
    told = changes(texts, patch.select(key, F.col("correct").alias(value)), [key], value)
    report = told.agg(F.count_if(F.col("action") == "update").alias("applied"), F.count_if(F.col("action") == "same").alias("already_correct"), F.count_if(F.col("action") == "insert").alias("missing"))
    fixed = texts.join(patch.select(key, F.col("correct").alias("_correct")), key, "left").withColumn(value, F.coalesce("_correct", value)).drop("_correct")
    return fixed, report


def export_citation(text_id, reference, text, score, source) -> F.Column:
    """A passage as a citation with where its score comes from."""
    tail = F.when(F.col(score).isNotNull(), F.concat(F.lit("\nscore "), F.format_number(score, 2), F.lit(" ("), F.col(source), F.lit(")"))).otherwise("")
    return F.concat(F.col(text), F.lit("\n— "), F.col(text_id), F.lit(" "), F.col(reference), tail)
