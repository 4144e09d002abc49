"""The stages in order, each on all that the one before kept."""

import zlib

import pytest

import corpus_pipeline
from lectern.llm import decontaminate
from lectern.llm.common import table
from test_group_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = columns = table(spark, SF, "documents")
    columns = docs.columns
    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        rows = docs.collect()
        kept.append({r["doc_id"]: r for r in rows})
        assert len(kept[-1]) == len(rows) and set(kept[-1]) <= set(kept[-2])
    quality, near, clean, mix = kept[1:]
    assert all((i in quality) == (q == 1) for i, q in labels.items())
    texts = [r["text"] for r in near.values()]
    assert len(set(texts)) == len(texts)
    assert not any(b in r["text"] for r in clean.values() for b in bench if b)
    assert all(r["text"] == near[i]["text"] for i, r in clean.items() if not any(b in near[i]["text"] for b in bench) and len(r["text"]) == len(near[i]["text"]))
    assert len(mix) >= 0.8 * len(clean)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sizes = [sum(r["shard"] == s for r in out) for s in range(40)]
    assert {r["doc_id"] for r in out} == set(mix) and max(sizes) - min(sizes) <= 1


def matched(text, items, window=10):
    """Maximal runs of words that windows of items hold, by comparing everything."""
    words = [w.decode() for w in decontaminate._WORD.findall(decontaminate._lower(text or ""))]
    hit = set()
    for item in items:
        own = [w.decode() for w in decontaminate._WORD.findall(decontaminate._lower(item or ""))]
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for j in range(len(words) - n + 1) if own else ():
            if tuple(words[j : j + n]) in wanted:
                hit.update(range(j, j + n))
    edges = [i for i in sorted(hit) if i - 1 not in hit]
    return len(words), [(i, next(j for j in range(i, len(words) + 1) if j not in hit)) for i in edges]


def test_run_is_brute_force(spark):
    """The fitted grades apart, all stages from their definitions: which documents come out, with what texts, under what law."""
    docs = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF).collect()}
    ids = sorted(docs)
    _, of = brute_components([docs[i] for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if of[k] == k}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    clean = {}
    for i, text in docs.items():
        n, runs = matched(text, items)
        if sum(b - a for a, b in runs) <= 0.5 * n:
            clean[i] = decontaminate.cut_spans(text, runs)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert dict(zip(out.doc_id, out.text_crc32, strict=True)) == {i: zlib.crc32((t or "").encode()) for i, t in clean.items()}
    assert (out["size"] == [len((clean[i] or "").encode()) + 16 for i in out.doc_id]).all() and set(out.law) == {"rows"}
    sizes = out.groupby("shard").size().reindex(range(40), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and all(sorted(own.slot) == list(range(len(own))) for _, own in out.groupby("shard"))


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_an_empty_table_passes(spark, stage):
    docs = table(spark, SF, "documents").limit(0)
    assert stage[1](spark, docs, SF).count() == 0


def test_small_sources_dont_end_the_mix(spark):
    rows = [(f"s{i % 4}", i) for i in range(400)] + [("hot", i) for i in range(400, 1400)] + [(None, 1400), ("rare", 1401)]
    docs = spark.createDataFrame([(i, f"text {i}", "en", s) for s, i in rows], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1402))
    for k in range(0, 600, 100):  # in the order of the mix, of which the hot source has 8/13 at most
        assert 40 < sum(r["source"] == "hot" for r in got[k : k + 100]) < 75


def test_shards_follow_the_mix(spark, tmp_path):
    rows = [(f"s{i % 4}", i) for i in range(400)] + [("hot", i) for i in range(400, 1400)]
    docs = spark.createDataFrame([(i, f"text {i} " + "x y z " * (i * 7919 % 500), "en", s) for s, i in rows], "doc_id long, text string, lang string, source string")
    mix = corpus_pipeline.mixing(spark, docs, SF)
    at = {r["doc_id"]: k for k, r in enumerate(mix.collect())}
    mix.write.option("maxRecordsPerFile", 130).parquet(f"{tmp_path}/mix")  # scans take the largest of these files first
    for given in (mix, spark.read.parquet(f"{tmp_path}/mix")):
        out = corpus_pipeline.sharding(spark, given, SF).toPandas().sort_values(["shard", "slot"])
        for _, own in out.groupby("shard"):
            # texts differ, so each shard has one row of every 40 of the mix
            assert [at[i] // 40 for i in own.doc_id] == list(range(35)) and list(own.slot) == list(range(35))
        first = out[out.slot < 10]
        assert {at[i] for i in first.doc_id} == set(range(400))
    turned = corpus_pipeline.sharding(spark, docs.orderBy("doc_id"), SF).where("slot = 0").toPandas()
    assert sorted(turned.doc_id) == list(range(40))
