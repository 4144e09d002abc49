"""Queries against their SQL on small corpora with what the given tables at sf0.001 don't have."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import plain

import __spark_entry__ as entry


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over the given tables (name: rows, schema) gives the rows of its SQL; the rows themselves."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = entry.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert plain(got) == plain(con.sql(entry.SQL[name]).df())
        return got

    return check


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(texts):
    """(rows, schema) of (text, lang) with ids from 0, dealt over three sources."""
    return [(i, t, lang, f"src{i % 3}", len(t)) for i, (t, lang) in enumerate(texts)], DOCUMENTS


def test_a_search_that_needs_no_widening_is_ranked_by_place(same):
    texts = [("thing " * (1 + i % 4) + "und der", "en") for i in range(9)] + [("die thing und", "de"), ("die und", "de"), ("nothing here", "en")]
    got = same("search_passages", documents=documents(texts))
    assert len(got) == 10 and set(got["total"]) == {10} and got["via"].isna().all() and "original" in set(got["matched_in"])


WORDS = [(" ".join(["und", "thing", "of", "sein", "stone"][: 2 + i % 4] * (1 + i % 3)) + f" rare{i}", "en") for i in range(16)]


@pytest.fixture
def built(monkeypatch):
    """The names of the tables that queries store."""
    from lectern.plans import corpus, learning, ranked, retrieval, texts, views

    names, real = [], learning.shared
    for m in (corpus, learning, ranked, retrieval, texts, views):
        if hasattr(m, "shared"):
            monkeypatch.setattr(m, "shared", lambda s, d, name, *a, **k: names.append(name) or real(s, d, name, *a, **k))
    return names


@pytest.mark.parametrize("most", [1000, 1])
@pytest.mark.parametrize("repeat", [False, True])
def test_vectors_are_weighed_where_rows_are(same, built, monkeypatch, most, repeat):
    from lectern.operators import ml as M

    monkeypatch.setattr(M, "SENT_TERMS", most)
    monkeypatch.setattr(M.vectors, "__defaults__", (most,))
    rows, schema = documents(WORDS)
    rows += [(40, None, "en", "src1", 0), (41, "", "en", "src1", 0), *([(3, "thing und more thing", "en", "src0", 20), (None, "und sein", "en", "src0", 8), (None, "und", "en", "src0", 3)] if repeat else [])]
    got = same("tfidf", documents=(rows, schema))
    assert len(got) > 20 and built == ["terms"]
    assert len(same("tfidf", documents=([], schema))) == 0


@pytest.mark.parametrize("query", ["threshold_sweep", "reliable_labels"])
def test_only_documents_with_a_label_are_weighed(same, built, query):
    rows = [(i, i % 2, i // 2 % 2) for i in range(16) if i % 5]
    got = same(query, documents=documents(WORDS), labels=(rows, "doc_id long, quality int, toxic int"))
    assert len(got) > 1 and sorted(built) == ["terms", "vectors of labelled"]


def test_written_tables_leave_no_shuffle_files(spark):
    from lectern.sources.shared import written

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, None)
    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in own for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}
    there = files()
    told = written(spark.range(1000).groupBy(F.col("id") % 7).count())
    assert not files() - there and spark.conf.get(conf, None) == before and told.count() == 7


FORMS = [("the tions of ering, eres and thonly thon " * (1 + i % 3) + ("und" if i % 4 == 0 else "with this that is"), "en" if i % 2 else "de") for i in range(12)]


@pytest.mark.parametrize("query,repeat", [("stem_frequency", False), ("stem_frequency", True), ("search_ranked_density", False)])
def test_stems_without_a_stored_index(same, built, monkeypatch, query, repeat):
    from lectern.operators import ranking

    monkeypatch.setattr(ranking, "BATCH_ROWS", 3)
    rows, schema = documents([*FORMS, ("", "en"), ("of the", "fr"), ("tion src1", "en")])
    rows += [(20, None, "en", "src1", 0), *([(1, "thonning tion eres for", "en", "src2", 9)] if repeat else [])]
    # a stored index of all terms is for queries that ask it again, or for ids whose rows have to be brought together
    assert len(same(query, documents=(rows, schema))) > 3
    assert ("stemmed index" in built) == repeat and ("theme scores" in built) == repeat


def test_recommendations_without_a_stored_index(spark, built):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.QUERIES["recommend_candidates"](spark, sf).toPandas()
    assert len(got) and plain(got) == plain(con.sql(entry.SQL["recommend_candidates"]).df())
    assert not {"index", "signals"} & set(built)


def test_common_grams_in_rounds(spark, built):
    from lectern.operators import quotations as Q
    from lectern.plans import retrieval

    rows = [(i, " ".join(f"w{(i % 4) * 3 + j % (5 + i)}" for j in range(4 + 2 * i))) for i in range(14)] + [(20, None), (21, "a b c d e f"), (21, "a b c d e f g"), (22, "A b c d [no] e f"), (None, "a b c d e f")]
    rows += [(100 + i, "one two three four five six seven") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = lambda d: sorted((-1 if r["id"] is None else r["id"], r["at"], r["df"]) for r in d.collect())
    expected = told(Q.shared(Q.postings(docs)))
    parts = Q.common(docs, rounds=3)
    assert len(expected) > 20 and len(parts) == 3 and sorted(sum(map(told, parts), [])) == expected
    assert sum(p.count() for p in Q.common(docs.limit(0), rounds=2)) == 0
    # all postings are neither stored nor shuffled at once
    calls, postings = [], Q.postings
    Q.postings = lambda *a: calls.append(a) or postings(*a)
    try:
        assert retrieval.edges_bidirectional(spark, "/root/testdata/sf0.001").count() > 0 and not calls
    finally:
        Q.postings = postings
