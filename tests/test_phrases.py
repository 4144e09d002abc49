"""Phrases shared with a corpus by seeds, against a scan of every text."""

import random

from pyspark.sql import functions as F

from lectern.functions.text import shared_phrases
from lectern.operators import phrases as P

ONE = "In the  beginning was the word, and the word was with light; the word and more"


def texts():
    rng = random.Random(3)
    words = "in the beginning was word, and with light; more bathe wordy end".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    odd = ["", None, "word", "bathe word, andes", "WAS WITH LIGHT; the", "was\twith light;", "was  with light;", "the word, and", " the word, and", "aİ the word, and"]
    return [(i, t) for i, t in enumerate(made + odd)] + [(3, "was the word, and"), (None, "and the word was")]


def test_seeds_lose_no_phrase(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    stored = P.triples(docs)
    expected = sorted((-1 if i is None else i, shared_phrases(ONE, t)) for i, t in texts() if t and shared_phrases(ONE, t) and i is not None)
    for most in (1000, 2):
        monkeypatch.setattr(P, "FILTERED_IDS", most)
        got = sorted((r["id"], list(r["phrases"])) for r in P.phrases_of(stored, docs, ONE).collect())
        assert got == expected and len(expected) > 10
    assert P.phrases_of(stored, docs, "a b").count() == 0 and P.phrases_of(stored, docs, "").count() == 0
    assert P.triples(docs.limit(0)).count() == 0


def test_only_texts_with_a_seed_are_read(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "so was with light; again").otherwise("other words only here").alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    P.triples(docs).sort("middle").write.parquet(str(tmp_path / "triples"))
    read, stored = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "triples"))
    seeds = P.seeded(stored, ONE)
    assert "In(middle" in seeds._jdf.queryExecution().toString() and seeds.count() == 3
    told = P.phrases_of(stored, read, ONE)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in plan
    assert sorted(r["id"] for r in told.collect()) == [7, 1007, 2007]
