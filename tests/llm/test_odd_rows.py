"""One id with two texts, null ids, ties and clashing names: every operator and every stage gives what its docstring says."""

import random

import pytest

import corpus_pipeline
from lectern.llm import decontaminate, minhash, mixing, quality, sharding, suffix_dedup, token_counts, toxicity
from lectern.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
rng = random.Random(6)
A, B = (" ".join(rng.choice(["one", "two", "three", "four", "five"]) + str(rng.randrange(40)) for _ in range(90)) for _ in range(2))
NAMES = "_h, _k, _id, _runs, _gone, h, k, id, runs, n_words, gone, number, name, i, slot, rank, tag, at, bucket, row, m, kept, n, d0".split(", ")
TWO = [(7, A), (7, B), (8, A)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, *["x"] * len(NAMES)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))


@pytest.fixture(scope="module")
def two(spark):
    return frame(spark, [(i, t, "s") for i, t in TWO])


def test_repeats_of_an_id_with_two_texts(two):
    got = sorted((r["doc_id"], r["n_bytes"], sum(s["hi"] - s["lo"] for s in r["spans"])) for r in suffix_dedup.without_repeats(two).collect())
    a, b = len(A), len(B)
    assert got == sorted([(7, a, 0), (7, b, 0), (8, a, a)])


def test_near_duplicates_of_an_id_with_two_texts(spark, two):
    """Each text of an id is judged by itself: two unlike texts both stay, and a link that only one of them has takes effect."""
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(two).collect())
    assert got == [(7, 7, True), (7, 7, True), (8, 7, False)]
    left = minhash.deduplicated(two)
    assert left.columns == two.columns and sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted([(7, A), (7, B)])
    more = two.unionByName(frame(spark, [(3, B + " tail", "s"), (9, None, "s"), (9, A, "s"), (9, "", "s"), (9, "", "s"), (None, A, "s"), (None, None, "s")]))
    got = {(str(r["doc_id"]), str(r["component_id"]), r["n_shingles"] > 0) for r in minhash.near_duplicates(more).collect()}
    assert got == {("7", "7", True), ("7", "3", True), ("8", "7", True), ("3", "3", True), ("9", "7", True), ("9", "9", False), ("None", "None", True), ("None", "None", False)}
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.deduplicated(more).collect())
    assert left == sorted([("3", B + " tail"), ("7", A), ("9", "None"), ("9", ""), ("None", A), ("None", "None")])


@pytest.mark.parametrize("block", [1 << 17, 40], ids=["one block", "several"])
def test_matches_by_row(spark, two, block):
    words = A.split()
    bench = spark.createDataFrame([(1, " ".join(words[5:30])), (2, " ".join(words[60:75])), (1, " ".join(words[5:30])), (None, B), (3, None), (4, B[:3])], "item_id long, text string")
    rows = two.unionByName(frame(two.sparkSession, [(None, A, "s"), (None, A, "s"), (None, None, "s"), (9, "", "s")]))
    got = decontaminate.digest(decontaminate.matches(rows, bench, block_words=block)).collect()
    named = [("1", " ".join(words[5:30])), ("2", " ".join(words[60:75])), ("4", B[:3])]
    expected = sorted((str(i), *decontaminate.brute(t, named)[:2]) for i, t in [*TWO, (None, A), (None, A), (None, None), (9, "")])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in got) == expected
    cleaned = decontaminate.cleaned(rows, bench.where("item_id <> 4"), max_coverage=0.9, block_words=block)
    assert cleaned.columns == rows.columns and cleaned.count() == 7
    assert {r["text"] for r in cleaned.collect() if r["doc_id"] == 7} == {B, " ".join([*words[:5], *words[30:60], *words[75:]]).replace(f"{words[4]} {words[30]}", f"{words[4]}  {words[30]}").replace(f"{words[59]} {words[75]}", f"{words[59]}  {words[75]}")}


def test_rows_of_an_id_are_rows(spark, two):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, toxic int, grade int")
    assert token_counts.token_counts(two, tokenizer_path("piece_bpe_32k.model")).count() == 3
    assert toxicity.toxicity(two, labels).where("score is not null").count() == 3 and quality.grade(two, labels).count() == 3
    mix = mixing.mixed(two, {"s": 1.0})
    assert sorted(r["mix_position"] for r in mix.collect()) == [0, 1, 2] and set(two.columns) <= set(mix.columns)
    assert sharding.balanced_shards(two, 2).count() == 3


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, stage):
    rows = [(None, A, None), (None, None, "s"), (1, None, None), (1, None, None), (2, "", "s"), (3, A, "s"), (3, A, "s"), (4, B, "t"), (4, A, "t"), (5, A + " tail", "s"), (6, B.upper(), None)]
    docs = frame(spark, rows)
    out = stage[1](spark, docs, SF)
    got = out.collect()
    if stage[0] == "sharding":
        assert len(got) == len(rows)
        return
    assert out.columns == docs.columns and all(r["_h"] == "x" for r in got)
    if stage[0] == "mixing sources to target weights" or stage[0] == "benchmark decontamination":
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, *_ in rows)
    if stage[0] == "MinHash near-dedup":
        # what is like A has 3's id, 4's too; B and its capitals are one set, so 4's B stays for 6
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted([("1", "None"), ("2", ""), ("3", A), ("4", B), ("None", A), ("None", "None")])
