"""Readers, sinks and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.sources import readers, sinks
from lectern.streaming import logs

SF = "/root/testdata/sf0.001"


def test_nested_books(spark, tmp_path):
    (tmp_path / "books.json").write_text(json.dumps([{"abbrev": "x", "name": "X", "chapters": [["skipped"]]}, {"abbrev": "a", "name": "Wrong", "chapters": [["one", " ", "three  words"], ["later"]]}, {"abbrev": "b", "name": "B", "chapters": [["last"]]}]))
    got = readers.books(spark, str(tmp_path / "books.json"), ["A", "B"], offset=1).orderBy("verse_order").collect()
    assert [(r["book"], r["chapter"], r["verse"], r["text"], r["verse_order"], r["position"]) for r in got] == [("A", 1, 1, "one", 1, 0), ("A", 1, 3, "three words", 2, 0), ("A", 2, 1, "later", 3, 0), ("B", 1, 1, "last", 4, 1)]
    with pytest.raises(Exception, match="expected 66 books"):
        readers.books(spark, str(tmp_path / "books.json"), ["A"], expected=66).collect()
    (tmp_path / "empty.json").write_text(json.dumps([{"abbrev": "a", "name": "A", "chapters": []}]))
    with pytest.raises(Exception, match="no chapters for A"):
        readers.books(spark, str(tmp_path / "empty.json"), ["A"]).collect()


def test_pages_of_a_chapter(spark, tmp_path):
    verse = lambda n, *t: {"verse_number": n, "text": f"o{n}", "translations": [{"resource_id": i, "text": x} for i, x in t]}
    page = lambda c, p, n, *v: json.dumps({"chapter": c, "verses": v, "pagination": {"current_page": p, "total_pages": n}})
    (tmp_path / "all.json").write_text("\n".join([page(1, 1, 2, verse(1, (9, "nine"), (2, " two ")), verse(2, (2, " "))), page(1, 2, 2, verse(3, (2, "three"))), page(2, 1, 1, verse(1, (2, "x")))]))
    got = readers.paged_verses(spark, str(tmp_path / "all.json")).orderBy("chapter", "verse").collect()
    assert [(r["chapter"], r["verse"], r["original"], [t["text"] for t in r["translations"]]) for r in got] == [(1, 1, "o1", ["two", "nine"]), (1, 3, "o3", ["three"]), (2, 1, "o1", ["x"])]
    (tmp_path / "some.json").write_text(page(1, 1, 2, verse(1, (2, "x"))))
    with pytest.raises(Exception, match="a page of a chapter is missing"):
        readers.paged_verses(spark, str(tmp_path / "some.json")).collect()


def test_parallel_arrays_and_editions(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"book": "B", "chapter": 1, "original": ["x", "", "z"], "translation": ["a", "b"]}))
    assert [(r["verse"], r["original"], r["translation"]) for r in readers.parallel_verses(spark, str(tmp_path / "p.json")).collect()] == [(1, "x", "a")]
    for name, text in (("o", "orig"), ("t", "tran")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"hadiths": [{"hadithnumber": i, "text": f"{text}{i}", "reference": {"book": 1, "hadith": i}} for i in ((1, 2) if name == "o" else (1,))]}))
    got = readers.two_editions(readers.edition(spark, str(tmp_path / "o.json")), readers.edition(spark, str(tmp_path / "t.json"))).orderBy("number").collect()
    assert [(r["original"], r["translation"]) for r in got] == [("orig1", "tran1"), ("orig2", "")]


def test_archives_of_scripture(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("gen.usfm", "\\id GEN\n\\c 1\n\\s A heading\n\\v 1 In the \\w beginning|strong=\"H1\"\\w*\nand on\n\\v 2 second\\f + \\ft note\\f* verse\n\\c 2\n\\v 1 third")
    got = readers.usfm_verses(readers.zip_entries(spark, str(tmp_path / "*.zip"))).orderBy("chapter", "verse").collect()
    assert [(r["chapter"], r["verse"], r["text"]) for r in got] == [(1, 1, "In the beginning and on"), (1, 2, "second verse"), (2, 1, "third")]


def test_attach_and_correct(spark, tmp_path):
    passages = spark.createDataFrame([("k1", ""), ("k2", "has"), ("k3", None)], "passage_key string, original string")
    new = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k9", "c")], "passage_key string, original string")
    got = {r["passage_key"]: r["original"] for r in readers.attached(passages, new, ["passage_key"]).collect()}
    assert got == {"k1": "a", "k2": "has", "k3": None}
    told = readers.attached(passages.withColumn("language", F.lit("english")), new, ["passage_key"], language="hebrew")
    assert {r["passage_key"]: r["language"] for r in told.collect()} == {"k1": "hebrew", "k2": "english", "k3": "english"}
    (tmp_path / "patch.json").write_text(json.dumps({"k1": "right", "k2": "has", "k7": "gone"}))
    texts = spark.createDataFrame([("k1", "wrong"), ("k2", "has")], "passage_key string, text string")
    fixed, report = sinks.corrected(texts, readers.patches(spark, str(tmp_path / "patch.json")))
    assert {r["passage_key"]: r["text"] for r in fixed.collect()} == {"k1": "right", "k2": "has"}
    assert report.first().asDict() == {"applied": 1, "already_correct": 1, "missing": 1}


def test_citations_resolve_to_every_book_of_an_alias(spark):
    aliases = spark.createDataFrame([("john", "nt", "john"), ("1 kings", "ot", "1kings"), ("john", "apocrypha", "acts-john"), ("an nas", "quran", "114"), ("2", "quran", "2"), ("3", "quran", "3")], "alias string, text_id string, book string")
    asked = ["John 3:16", "1 Kings 2", "1 Kings 2.7", "nothing", "unknown 1:1", None, "nt john 1:1", "quran 2:255", "2:255", "Surah An-Nas 114:3", "an-nas 5:3", "x" * 90 + " 1:1", "john 0:1"]
    got = {(r["q"], r["passage_key"]) for r in readers.citations(spark.createDataFrame([(q,) for q in asked], "q string"), "q", aliases).collect()}
    assert got == {("John 3:16", "nt:john:3:16"), ("John 3:16", "apocrypha:acts-john:3:16"), ("1 Kings 2.7", "ot:1kings:2:7"), ("nt john 1:1", "nt:john:1:1"), ("quran 2:255", "quran:2:1:255"), ("Surah An-Nas 114:3", "quran:114:1:3")}


def test_a_large_group_is_numbered_by_ranges(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"), (F.col("id") * 7919 % 4001).alias("k"))
    got = R.numbered(rows, ["g"], [F.desc("k")], "place", 8).toPandas()
    total = R.running(rows.withColumn("v", F.lit(1.0)), ["g"], [F.desc("k")], "v", "sum", 8).toPandas()
    for part, column in ((got, "place"), (total, "sum")):
        for _, own in part.groupby(part.g.isna()):
            assert own.sort_values("k", ascending=False)[column].tolist() == list(range(1, len(own) + 1))


def test_upsert_writes_a_new_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    place = sinks.upsert(old, new, ["k"], str(tmp_path))
    assert {tuple(r) for r in spark.read.parquet(place).select("k", "v").collect()} == {(1, "a"), (2, "B"), (3, "C")}


def test_runs_are_islands(spark):
    rows = spark.createDataFrame([("p", a, b) for a, b in ((1, 5), (2, 6), (3, 7), (3, 20), (9, 13), (10, 14))], "pair string, a int, b int")
    assert {tuple(r) for r in R.islands(rows, ["pair"], "a", "b").select("a", "b", "steps").collect()} == {(1, 5, 3), (3, 20, 1), (9, 13, 2)}


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.log_stream(spark, str(tmp_path / "in"), 1)
    logs.append_sink(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()

    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(str(tmp_path / "batches" / str(batch)))

    logs.merge_sink(logs.distinct_events(stream, "60 days"), keep, str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(*[str(p) for p in (tmp_path / "batches").iterdir()]).count() == events.count()
    counted = logs.tumbling_counts(stream, "1 hour", "60 days").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("events")).first()[0] == events.count()
    assert spark.table("counts").count() == logs.tumbling_counts(events).count()


def test_postings_refresh(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, term string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "id int, term string")
    assert {tuple(r) for r in logs.refreshed_postings(old, new).collect()} == {(1, "a"), (2, "c"), (2, "d")}


def test_a_run_ends_with_its_budget(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = logs.log_stream(spark, str(tmp_path / "in"), 1)
    report = logs.budgeted_run(stream, lambda rows, batch: seen.append(rows.count()) or True, str(tmp_path / "c"), rows=300)
    assert report["truncated"] and not report["unreachable"] and report["rows"] == sum(seen) and sum(seen) >= 300 > sum(seen[:-1])
    rest = logs.budgeted_run(stream, lambda rows, batch: seen.append(rows.count()) or True, str(tmp_path / "c"))
    assert not rest["truncated"] and sum(seen) == events.count()  # it goes on where the first run ended
    failed = logs.budgeted_run(stream, lambda rows, batch: False, str(tmp_path / "d"), failures=2)
    assert failed["failed"] == 2 and failed["retried"] == 0
    assert failed["unreachable"] and failed["truncated"] and failed["batches"] == 2


def test_a_failed_batch_comes_again_and_none_is_applied_twice(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream, clock = logs.log_stream(spark, str(tmp_path / "in"), 1), [1000.0]
    retries = logs.Retries(spark, f"file://{tmp_path}/retries", wait=60, most=3, now=lambda: clock[0])
    applied, fails = [], {1, 2}

    def apply(rows, number):
        if number in fails:
            return False
        applied.append((number, sorted(r["event_id"] for r in rows.select("event_id").collect())))
        return True

    run = lambda: logs.budgeted_run(stream, apply, str(tmp_path / "c"), retries=retries)
    first = run()
    assert (first["batches"], first["failed"], first["retried"]) == (4, 2, 0) and [n for n, _ in applied] == [0, 3]
    assert run()["batches"] == 0  # nothing new, and what failed isn't due yet
    clock[0] += 61
    fails.discard(1)
    second = run()
    assert (second["retried"], second["recovered"], second["failed"]) == (2, 1, 1)
    clock[0] += 61
    assert run()["retried"] == 0  # after two failures it waits twice as long
    clock[0] += 61
    fails.clear()
    third = run()
    assert (third["retried"], third["recovered"]) == (1, 1) and retries.due() == []
    assert sorted(n for n, _ in applied) == [0, 1, 2, 3]
    seen = sorted(e for _, ids in applied for e in ids)
    assert seen == sorted(r["event_id"] for r in events.select("event_id").collect())
    # a batch that the checkpoint doesn't know of yet isn't applied a second time
    before = len(applied)
    again = logs.budgeted_run(stream, apply, str(tmp_path / "other"), retries=retries)
    assert again["batches"] == 0 and len(applied) == before


def test_a_batch_that_always_fails_is_given_up(spark, tmp_path):
    spark.range(5).select("id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    retries = logs.Retries(spark, f"file://{tmp_path}/retries", most=2)
    runs = [logs.budgeted_run(stream, lambda rows, number: False, str(tmp_path / "c"), retries=retries)["batches"] for _ in range(3)]
    assert runs == [1, 1, 0] and retries.state(0)["attempts"] == 2 and retries.rows(0).count() == 5


ORDERED = [(1, "a", 3, "x"), (1, "b", 7, None), (1, "c", 7, "y"), (2, "d", None, "z"), (2, "e", 1, "z"), (3, "f", 1, "q"), (3, "f", 1, "q"), (None, "n", 1, "m"), (None, "o", 2, "m")]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_the_last_writer_wins(spark, parts):
    """Repeated keys over several partitions: the result is the same however they are dealt."""
    new = spark.createDataFrame(ORDERED, "k int, v string, at int, w string").repartition(parts, "v")
    old = spark.createDataFrame([(1, "old", 0, "o"), (9, "kept", 0, "o")], new.schema)
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    last = [(1, "c", 7, "y"), (2, "e", 1, "z"), (3, "f", 1, "q"), (None, "o", 2, "m")]
    assert got(R.last_written(new, ["k"], ["at"])) == sorted(last, key=str)
    assert got(R.merged(old, new, ["k"], ["at"])) == sorted([*last, (9, "kept", 0, "o")], key=str)
    assert got(R.replaced(old, new, ["k"], ["k"], ["at"])) == sorted([*last, (9, "kept", 0, "o")], key=str)
    first = [(2, "d", None, "z"), (3, "f", 1, "q")]
    assert [r for r in got(R.inserted(old, new, ["k"], ["at"])) if r[0] in (2, 3)] == first
    assert (1, "old", 0, "o") in got(R.inserted(old, new, ["k"], ["at"]))
    told = {r["k"]: (r["v"], r["at"], r["w"]) for r in R.merged_columns(old, new.where("k is not null"), ["k"], ["v"], ["at"]).collect()}
    assert told == {1: ("c", 0, "o"), 2: ("e", 1, "z"), 3: ("f", 1, "q"), 9: ("kept", 0, "o")}
    assert got(R.last_written(new.where("k = 1"), ["k"])) == [(1, "c", 7, "y")]  # without an order the greatest row
    assert got(R.last_written(new.select("k"), ["k"])) == sorted([(1,), (2,), (3,), (None,)], key=str)
