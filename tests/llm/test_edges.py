"""Null ids, repeated rows and clashing names: no operator crashes, and each case has its stated result."""

import random

import pytest

from lectern.llm import decontaminate, minhash, mixing, pivots, quality, sharding, suffix_dedup, token_counts, toxicity
from lectern.llm.queries import tokenizer_path

rng = random.Random(4)
LONG = " ".join(rng.choice(["one", "two", "three", "four", "five", "six", "seven"]) + str(rng.randrange(30)) for _ in range(80))
OTHER = " ".join(str(rng.random()) for _ in range(60))
ROWS = [(None, LONG), (None, None), (1, LONG), (1, LONG), (2, OTHER), (3, LONG + " more"), (4, None), (4, None), (5, "")]
CLASHES = "score, shard, slot, rank, key, n, k, b, f, r, h, j, _h, _k, _id, _runs, _rank, off, tag, at, id, text_crc32, component_id, kept, spans, runs, items, n_words, n_tokens, held_out, mix_slot, source".split(", ")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in ROWS], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def by_id(df):
    return sorted(((r["doc_id"], r) for r in df.collect()), key=lambda p: (p[0] is None, p[0] or 0))


def test_repeated_passages(docs):
    got = by_id(suffix_dedup.without_repeats(docs))
    sizes = [(i, r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"])) for i, r in got]
    n = len(LONG.encode())
    # copies of one row don't repeat each other; a row without an id is compared with nothing
    assert sizes == [(1, n, 0), (1, n, 0), (2, len(OTHER.encode()), 0), (3, n + 5, n), (4, 0, 0), (4, 0, 0), (5, 0, 0), (None, n, 0), (None, 0, 0)] or sizes == [(1, n, 0), (1, n, 0), (2, len(OTHER.encode()), 0), (3, n + 5, n), (4, 0, 0), (4, 0, 0), (5, 0, 0), (None, 0, 0), (None, n, 0)]


def test_near_duplicates(docs):
    got = by_id(minhash.near_duplicates(docs))
    assert len(got) == len(ROWS)
    assert [(i, r["component_id"], r["kept"]) for i, r in got if i is not None] == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert all(r["component_id"] is None and r["kept"] is None for i, r in got if i is None)
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "5", "None", "None"]


def test_rows_stay_rows(spark, docs):
    bench = spark.createDataFrame([(1, LONG), (None, OTHER)], "item_id long, text string")
    found = by_id(decontaminate.digest(decontaminate.matches(docs, bench)))
    assert [(i, r["n_items"]) for i, r in found if i is not None] == [(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (4, 0), (5, 0)]
    cleaned = decontaminate.cleaned(docs, bench)
    assert cleaned.columns == docs.columns and sorted(i for i, _ in by_id(cleaned) if i is not None) == [2, 4, 4, 5]
    assert token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).count() == len(ROWS)
    assert mixing.mixed(docs, {"x": 1.0}).count() == len(ROWS)
    shards = sharding.balanced_shards(docs, 3).toPandas()
    assert len(shards) == len(ROWS) and shards.groupby("shard").size().tolist() == [3, 3, 3]


def test_fitted_operators(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, toxic int, grade int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == len(ROWS) and got.where("score is null or held_out is null").count() == 0
    assert quality.grade(docs, labels).count() == len(ROWS)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.5, 0.5], "b"), (None, [1.0, 1.0], "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = pivots.neighbours(vectors, vectors, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(1, 1, 2), (2, 1, 1), (2, 2, 1)]
