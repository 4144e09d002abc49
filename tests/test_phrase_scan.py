"""Phrases shared with a corpus by one walk over its texts, against searching each text for every run of words."""

import random
import re

import pytest
from test_phrases import ONE, texts

from lectern.functions.text import shared_phrases
from lectern.operators import phrases as P
from lectern.plans import retrieval


def brute(a, b, limit=8):
    """The longest run of 3 to 8 words at each place that both texts hold, then on behind it."""
    a, b, out, i = a.lower(), b.lower(), {}, 0
    words = re.split(r"\s+", a)
    while i <= len(words) - 3:
        runs = [" ".join(words[i : i + k]) for k in range(3, min(8, len(words) - i) + 1)]
        held = next((k for k, r in enumerate(runs) if r not in b or r not in a), len(runs))
        if held:
            out[runs[held - 1]] = True
        i += max(1, held + 2 if held else 1)
    return sorted(out, key=lambda p: -len(p))[:limit]


@pytest.mark.parametrize("one", [ONE, " in the word", "the word the word the word, and", "", "word", "was\nwith light; and", "İ was the word"])
def test_the_walk_finds_what_a_search_finds(one):
    rng = random.Random(5)
    more = ["".join(rng.choice(["in", "the", "word", "was", " ", " ", "\n", ","]) for _ in range(30)) for _ in range(300)]
    for _, t in [*texts(), *enumerate(more)]:
        assert shared_phrases(one, t or "") == brute(one, t or "")


def test_one_pass_over_all_texts(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    expected = sorted((-1 if i is None else i, brute(ONE, t)) for i, t in texts() if t and brute(ONE, t))
    told = P.phrases_in(docs, ONE)
    assert sorted((-1 if r["id"] is None else r["id"], list(r["phrases"])) for r in told.collect()) == expected
    assert told._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [") == 1
    # no table of the corpus's words is built for one text
    built, shared = [], retrieval.shared
    monkeypatch.setattr(retrieval, "shared", lambda s, d, name, *a, **k: built.append(name) or shared(s, d, name, *a, **k))
    assert retrieval.phrases_in_corpus(spark, "/root/testdata/sf0.001").count() > 0 and built == []


def test_triples_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, " a  b"), (3, "a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in P.triples(docs).collect())
    assert got == sorted([("b", "a", "c", 1), ("c", "b", "a", 1), ("a", "c", "b", 1), ("a", "", "", 2), ("", "a", "b", 2)])
    # distinct structs would be found by comparing all pairs
    assert "named_struct" not in P.triples(docs)._jdf.queryExecution().optimizedPlan().toString()
