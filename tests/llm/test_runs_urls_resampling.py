"""Periodic runs, URL filters and importance resampling against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import importance, periodic, queries, url_filters
from lectern.llm.common import table
from test_queries import SF, TABLES, plain

CLASHES = "n_words, runs, collapsed, weight, score, rank, uid, host, path, rule, verdict, own, one, n, a, b, id, c0, c1, component, given_text, n_features"


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_url_filters", "op13_importance_resampling"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(db.sql(queries.ORACLE_SQL[name]).df())


# ---------------------------------------------------------------- periodic runs

repetitive = st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6).map(lambda parts: [w for unit, n in parts for w in unit * n])
few = st.lists(st.sampled_from("ab"), max_size=60)


def coded(texts):
    known = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    return np.array([known[w] for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(repetitive, few), min_size=1, max_size=4))
def test_runs_are_brute_force(texts):
    codes, edges = coded(texts)
    expected = [(s + int(at), size, p) for t, at in zip(texts, edges, strict=False) for s, size, p in periodic.brute(t)]
    assert periodic.runs(codes, edges) == expected


def test_runs_of_strings_without_and_with_many_repetitions():
    fib, back = "a", "b"
    while len(fib) < 600:
        fib, back = fib + back, fib
    for text in (list(fib), ["x"] * 500, [str(i) for i in range(500)], list("ab" * 200 + "c" + "ab" * 200)):
        codes, edges = coded([text])
        assert periodic.runs(codes, edges) == periodic.brute(text)


@settings(max_examples=100, deadline=None)
@given(few, st.integers(0, 60))
def test_z_values(words, mid):
    mid = min(mid, len(words))
    codes, _ = coded([words])
    places = [j for j in range(len(words)) if j != mid and mid < len(words) and words[j] == words[mid]]
    got = periodic.z_values(codes.tolist(), codes, mid, places, len(words))
    for j in places:
        k = 0
        while max(j, mid) + k < len(words) and words[j + k] == words[mid + k]:
            k += 1
        assert got[j] == k


def test_collapsed_texts_and_odd_rows(spark):
    unit = "one two three four five six"
    rows = [(1, f"start {unit} {unit} {unit} end"), (1, f"start {unit} {unit} {unit} end"), (None, "a " * 40), (2, None), (3, ""), (4, " \t\n "), (5, "only a few words"), (6, "w\x0bx\x1cy " * 10)]
    docs = spark.createDataFrame([(i, t, *["mine"] * len(CLASHES.split(", "))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES.split(", ")))
    out = periodic.periodic_runs(docs)
    assert [c for c in out.columns if c not in ("n_words", "runs", "collapsed")] == [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    first = (1, 20, [(1, 18, 6)], f"start {unit} end")
    assert got == [first, first, (None, 40, [(0, 40, 1)], "a"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 4, [], "only a few words"), (6, 20, [(0, 20, 2)], "w x\x1cy")]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    told = periodic.digest(out).collect()
    assert (told[0]["n_runs"], told[0]["start"], told[0]["length"], told[0]["period"], told[0]["exponent_milli"]) == (1, 1, 18, 6, 3000)
    assert told[0]["runs_sha256"] == hashlib.sha256(b"1,18,6\n").hexdigest() and told[3]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_planted_tails(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b c"), (10**12, None), (7, "")], "doc_id long, text string"))
    given_texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    changed = 0
    for r in periodic.with_periodic_tails(docs).collect():
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 or (r["doc_id"], r["text"]) in given_texts and not (r["text"] or "").strip():
            assert (r["doc_id"], r["text"]) in given_texts
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t in given_texts if i == r["doc_id"]))
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"].split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed > 5


# ---------------------------------------------------------------- URL filters


def brute_verdicts(pages, rules, links):
    """The same by scanning every rule for every URL and walking the graph."""

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")

    def rule(url):
        host, path = parts(url)
        fits = [(len(h) + len(p), a == "allow", len(h), h + p, a) for h, p, a in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, None)

    near = {}
    for a, b in links:
        if a and b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for i, url in pages:
        seen, todo = {url}, [url]
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        actions = {rule(u)[1] for u in seen if u is not None}
        own = rule(url)
        verdict = own[1] or ("allow" if "allow" in actions else "block" if "block" in actions else "allow")
        out.append((i, *parts(url), own[0], verdict, min(seen) if url is not None else None))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_verdicts_are_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "d.net", "com", "E.org"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y', '/z', '?q=/x', '#x/'])}" for _ in range(60)] + ["no scheme", "", None, "http://", "x://y://a.com/x"]
    pages = [(k, rng.choice(urls)) for k in range(200)] + [(1, urls[0]), (None, urls[1])]
    some = [u for u in urls if u]
    links = [(rng.choice(some), rng.choice(some)) for _ in range(14)] + [("http://hub/", u) for u in some[:6]] + [(None, some[0]), (some[0], None), (some[1], some[1])]
    rules = [("a.com", "/x", "block"), ("b.a.com", "/x/", "allow"), ("com", "/", "allow"), ("d.net", "", "block"), ("e.org", "/x", "block"), ("E.org", "/z", "allow"), ("hub", "/", "block"), ("com", "/x", "block"), ("com", "/x", "allow")]
    frame = spark.createDataFrame([(i, u, *["mine"] * len(CLASHES.split(", "))) for i, u in pages], "page_id long, url string, " + ", ".join(f"{c} string" for c in CLASHES.split(", ")))
    got = url_filters.url_verdicts(frame, spark.createDataFrame([*rules, (None, "/", "block"), ("d.net", "/", "other")], "host string, path string, action string"), spark.createDataFrame(links, "a string, b string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    assert key(map(tuple, got.collect())) == key(brute_verdicts(pages, rules, links))


def test_a_block_reaches_aliases_and_an_allow_precedes(spark):
    pages = spark.createDataFrame([(1, "http://old.net/p"), (2, "http://bad.com/p"), (3, "http://kept.net/p"), (4, "http://lone.net/p"), (5, "http://mixed.net/p")], "page_id long, url string")
    links = spark.createDataFrame([("http://old.net/p", "http://hop.net/p"), ("http://hop.net/p", "http://bad.com/p"), ("http://kept.net/p", "http://bad.com/p"), ("http://mixed.net/p", "http://bad.com/q"), ("http://good.org/", "http://bad.com/q")], "a string, b string")
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("kept.net", "/p", "block"), ("good.org", "/", "allow")], "host string, path string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.url_verdicts(pages, rules, links).collect()}
    assert got == {1: (None, "block"), 2: ("bad.com/", "block"), 3: ("kept.net/p", "block"), 4: (None, "allow"), 5: (None, "allow")}
    empty = url_filters.url_verdicts(pages.limit(0), rules, links)
    assert empty.count() == 0
    assert url_filters.url_verdicts(pages, rules.limit(0), links.limit(0)).where("verdict = 'allow' and rule is null").count() == 5


def test_a_hot_component_and_a_hot_url(spark):
    """A third of all rows have one URL, and thousands of URLs one target."""
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://x.net/hot").otherwise(F.concat(F.lit("http://x.net/"), F.col("id").cast("string"))).alias("url"))
    links = pages.select(F.col("url").alias("a"), F.lit("http://bad.com/").alias("b"))
    got = url_filters.url_verdicts(pages, spark.createDataFrame([("bad.com", "/", "block")], "host string, path string, action string"), links)
    assert got.where("verdict = 'block' and alias_of = 'http://bad.com/'").count() == 6000


def test_no_python_worker(spark):
    """The main path is DataFrame functions only."""
    pages = table(spark, SF, "pages")
    links = url_filters.declared_links(pages).unionByName(url_filters.usual_redirects(pages))
    plan = url_filters.url_verdicts(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, action string"), links)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<link rel="canonical" href="https://b.net/x">', ["https://b.net/x"]),
        ("<LINK HREF='/y' REL='canonical'>", ["http://a.net/y"]),
        ('<meta http-equiv="refresh" content="0; url=//c.net/z">', ["http://c.net/z"]),
        ('<link rel=canonical href=w.html><meta http-equiv=refresh content="5;URL=v">', ["http://a.net/d/w.html", "http://a.net/d/v"]),
        ('<link rel="stylesheet" href="/s.css"><a href="/t">t</a>', []),
        (None, []),
        ("", []),
    ],
)
def test_declared_links(spark, html, expected):
    page = spark.createDataFrame([("http://a.net/d/p?q#f", html), (None, html)], "url string, html string")
    assert [r["b"] for r in url_filters.declared_links(page).collect()] == expected


def test_canonical(spark):
    urls = {
        "http://WWW.A.net/x/": "https://a.net/x",
        "https://m.a.net/x.html?utm_source=f&page=2&ref=z#top": "https://a.net/x?page=2",
        "https://a.net/?b=2&a=1": "https://a.net?a=1&b=2",
        "https://www.com/x": "https://www.com/x",
        "mailto:x": "mailto:x",
    }
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filters.canonical(F.col("url")).alias("c"))
    assert [r["c"] for r in got.collect()] == list(urls.values())


# ---------------------------------------------------------------- importance resampling


def brute_resampled(docs, target, percent, least, longest, buckets, seed):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
        return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own, other = [0] * buckets, [0] * buckets
    for _, t in docs:
        for f in features(t)[1]:
            own[f] += 1
    for t in target:
        for f in features(t)[1]:
            other[f] += 1
    s, t = sum(own), sum(other)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(own, other, strict=True)]
    out = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{i if i is not None else ''}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 100), (3, 40), (2, 0)])
def test_resampling_is_brute_force(spark, longest, percent):
    rng = random.Random(longest)
    vocabulary = ["The", "x-y", "É", "one", "two9", "three", "naïve", "…", "a"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(300)] + [(300, None), (301, ""), (302, "-- ..")]
    target = [" ".join(rng.choice(vocabulary[:4]) for _ in range(30)) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(i, t, *["mine"] * len(CLASHES.split(", "))) for i, t in docs], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES.split(", "))).repartition(7)
    got = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, longest, 97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(docs) and set(rows) == set(brute_resampled(docs, target, percent, 20, longest, 97, 2024))


def test_resampling_of_odd_rows(spark):
    text = " ".join(["word"] * 25)
    rows = [(None, text), (None, text), (1, text), (1, text), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resampled(docs, docs.limit(0).select("text"), 100).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in got if r["doc_id"] in (2, 3))
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert importance.resampled(docs.limit(0), docs.select("text")).count() == 0


def test_feature_counts_are_added_over_partitions(spark):
    texts = spark.range(2000).select(F.concat(F.lit("same w"), (F.col("id") % 5).cast("string")).alias("text")).repartition(33)
    counts = importance.feature_counts(texts, buckets=1000)
    assert counts.sum() == 4000 and counts[zlib.crc32(b"same") % 1000] >= 2000
    assert importance.feature_counts(texts.limit(0), buckets=10).sum() == 0
