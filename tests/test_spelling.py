"""Runs of words by trigrams against every run of every passage."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import search, spelling


def grams(words):
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def brute(rows, query, least, reach=None):
    asked = re.findall(r"[^\W_]+", query.lower())
    own, reach = grams(asked), reach or len(asked) + 1
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        best = 0.0
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + reach) + 1):
                run = grams(words[a:b])
                best = max(best, len(run & own) / len(run | own))
        if best >= least:
            out[i] = best
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    stems = ["mercy", "forgive", "kingdom", "heaven", "a", "an", "covenant", "naïve", "light"]

    def misspelled():
        w = list(rng.choice(stems))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice("aeimnt")
        if rng.random() < 0.2:
            w.insert(rng.randrange(len(w)), rng.choice("aeimnt "))
        return "".join(w)

    rows = [(k, " ".join(misspelled() for _ in range(rng.randrange(30)))) for k in range(150)] + [(500, None), (501, ""), (502, "mercy " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, docs, search.index(docs, {"A": "text"})


@pytest.mark.parametrize("query", ["mercy", "merce", "forgiv heven", "kingdm of heavn", "covenant", "na", "light a light", "zzzz", "?!"])
@pytest.mark.parametrize("least", [0.6, 0.3])
def test_extents_are_brute_force(spark, corpus, query, least):
    rows, docs, posts = corpus
    got = {r["id"]: r["relevance"] for r in spelling.extents(docs, posts, spelling.trigram_file(posts), query, least).collect()}
    assert got == pytest.approx(brute(rows, query, least) if re.search(r"\w", query) else {})


def test_many_alike_words_and_a_longer_reach(spark, corpus, monkeypatch):
    rows, docs, posts = corpus
    monkeypatch.setattr(spelling, "LISTED_WORDS", 2)
    got = {r["id"]: r["relevance"] for r in spelling.extents(docs, posts, spelling.trigram_file(posts), "merci ligt", 0.5, 5).collect()}
    assert got == pytest.approx(brute(rows, "merci ligt", 0.5, 5)) and got


def test_only_words_with_a_shared_trigram_are_read(spark, corpus, tmp_path):
    _, docs, posts = corpus
    posts.repartitionByRange(4, "term").sortWithinPartitions("term").write.parquet(str(tmp_path / "posts"))
    spelling.trigram_file(posts).sort("gram").write.parquet(str(tmp_path / "grams"))
    stored, file = (spark.read.parquet(str(tmp_path / n)) for n in ("posts", "grams"))
    found = spelling.extents(docs, stored, file, "mercy")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    pushed = re.findall(r"In\(term, \[([^\]]*)\]", plan)
    assert pushed and all(set(g) for g in pushed) and "kingdom" not in pushed[0] and "mercy" in pushed[0]
    assert re.search(r"In\(gram, \[", plan)
    alike = spelling.words_alike(file, "mercy", 0.6).where(F.col("term") == "mercy").first()
    assert alike["similarity"] == 1.0 and len(alike["held"]) == 6
