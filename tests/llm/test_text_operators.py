"""Toxicity, quality, decontamination, token counts and repeated passages against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, quality, suffix_dedup, token_counts, toxicity
from lectern.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, n_items string, source string"
words = st.lists(st.sampled_from(["a", "b", "c", "d", "É", "x-y"]), max_size=30).map(" ".join)


def frame(spark, texts, start=0):
    """Documents with a column whose name an operator also uses."""
    return spark.createDataFrame([(start + i, t, "mine", "s") for i, t in enumerate(texts)], DOCS)


def test_words_of_texts():
    got, rows = common.split_words(pa.array(["A b C\td", None, "", "  É e "]))
    assert got.to_pylist() == ["a", "b c", "d", "É", "e"] and rows.tolist() == [0, 0, 0, 3, 3]
    assert common.split_words(pa.array(["a-B9 é_ü"]), alnum=True)[0].to_pylist() == ["a", "b9", "é", "ü"]


def test_ranks_are_gapless_with_a_hot_group(spark):
    rows = spark.range(3000).select("id", (F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"), F.lit("p").alias("p"))
    rows = rows.withColumns({"g": F.xxhash64("k"), "h": F.xxhash64(F.lit(1), "id")})
    got = common.ranked(rows, ["p"], "g", "h", "rank").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(3000))
    assert (got.sort_values(["g", "h"])["id"].tolist()) == got["id"].tolist()
    flat = common.ranked_by_hash(rows, ["p"], "h", "rank").toPandas().sort_values("rank")
    assert flat["rank"].tolist() == list(range(3000)) and flat["h"].is_monotonic_increasing


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    nodes = spark.createDataFrame([(x,) for x in [*range(41), *range(100, 130), 200, 300]], "id long")
    got = {r["id"]: r["component"] for r in common.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[200] == 200 and got[300] == 300


# ---------------------------------------------------------------- decontamination


@settings(max_examples=60, deadline=None)
@given(words, st.lists(words, min_size=1, max_size=5))
def test_automaton_is_brute_force(text, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    own = decontaminate.Automaton.of([(n, [w.decode() for w in decontaminate._WORD.findall(decontaminate._lower(t))]) for n, t in named], 4)
    n, runs, found = decontaminate._found(own, pa.array([text]), pa.array(own.vocabulary, pa.large_string()))
    hits = sum(b - a for a, b in runs[0])
    expected = decontaminate.brute(text, named, 4)
    assert (n[0], hits, found[0]) == expected[:3]


def test_decontamination_query_in_blocks(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 12, 25, 10, 1, 0)]
    texts = [None, "", "!!", items[1], f"x {items[2]} y {items[2]}", "a " * 50, " ".join(rng.choice("abcdefgh") for _ in range(4000))] + [items[3]] * 3
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (1, items[1])], "item_id long, text string")
    named = [(str(i), t) for i, t in enumerate(items)]
    for block in (1 << 17, 20):
        got = decontaminate.digest(decontaminate.matches(frame(spark, texts), bench, 10, block_words=block)).toPandas().set_index("doc_id")
        for i, t in enumerate(texts):
            n, hit, names, sha = decontaminate.brute(t, named)
            row = got.loc[i]
            assert (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) == (n, hit, len(names), sha, hit > 0)


@pytest.mark.parametrize("seeds, passes", [(decontaminate.PASS_SEEDS, 1), (150, 3)])
def test_many_blocks_read_documents_once(spark, monkeypatch, seeds, passes):
    """Twenty blocks and more: one pass over documents for all that fit in it, and texts of a block dealt over several tasks."""
    rng = random.Random(8)
    monkeypatch.setattr(decontaminate, "PASS_SEEDS", seeds)
    monkeypatch.setattr(decontaminate, "MEET_BYTES", 200)
    calls, needing = [], decontaminate._needing
    monkeypatch.setattr(decontaminate, "_needing", lambda *a: calls.append(a) or needing(*a))
    items = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(n)) for n in [25] * 24 + [2, 4, 9]]
    junk = lambda: " ".join(f"z{rng.randrange(99)}" for _ in range(30))
    texts = [f"{junk()} {items[i % 27].upper()} {junk()} {items[(i * 7) % 27]}" for i in range(54)] + [None, "", junk(), items[3][:-3]] + [f"{items[5]} {junk()}" for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    named = [(str(i), t) for i, t in enumerate(items)]
    assert decontaminate._pieces(bench, 10, "item_id", "text", 30)[1] >= 20
    got = decontaminate.digest(decontaminate.matches(frame(spark, texts), bench, 10, block_words=30)).collect()
    assert len(calls) == passes
    for r in got:
        n, hit, names, sha = decontaminate.brute(texts[r["doc_id"]], named)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), sha, hit > 0)
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))


def test_spans_are_cut_and_mostly_contaminated_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    clean = "Nothing here. " * 30
    docs = frame(spark, [clean, f"{clean}{item.upper()}, then {clean}", item, None])
    got = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(docs, bench).collect()}
    assert got == {0: clean, 1: f"{clean}, then {clean}", 3: None}
    assert decontaminate.cleaned(docs, bench).columns == docs.columns
    assert decontaminate.cleaned(docs.limit(0), bench).count() == 0 and decontaminate.cleaned(docs, bench.limit(0)).count() == 4


# ---------------------------------------------------------------- token counts

MODEL = tokenizer_path("piece_bpe_32k.model")
odd = st.text(st.sampled_from(list("ab \n\té▁ｆ😀<s/>") + [" ", "　"]), max_size=120)


@settings(max_examples=150, deadline=None)
@given(odd)
def test_pieces_add_up_to_whole_texts(text):
    model = token_counts._model(MODEL)
    assert sum(len(model.encode(p)) for p in token_counts.pieces(text, 7)) == len(model.encode(text))


def test_token_counts(spark):
    texts = [None, "", " ", "</s>[INST] <unk>", "word " * 9000, "x" * 40_000, "two words", "two words"]
    got = token_counts.token_counts(frame(spark, texts), MODEL).toPandas().set_index("doc_id")
    model = token_counts._model(MODEL)
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got.loc[i].n_tokens, got.loc[i].n_bytes, got.loc[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.token_counts(frame(spark, []), MODEL).count() == 0


# ---------------------------------------------------------------- repeated passages


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("part", [1 << 18, 64])
def test_repeated_passages(spark, monkeypatch, part):
    rng = random.Random(5)
    word = lambda: rng.choice(["und", "the", "ça", "x", "longer", "más"])
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "short", passage, f"before {passage} after", passage[20:90], "ab" * 300, "ab" * 40, "z" * 150] + [" ".join(word() for _ in range(150)) for _ in range(30)]
    texts += [texts[9], texts[9][:200] + "!" + texts[9][200:], passage] * 3
    monkeypatch.setattr(suffix_dedup, "PART", part)
    suffix_dedup._tables.cache_clear()
    # parts are tested in this process, the query in Spark's
    for t in texts:
        x = np.frombuffer((t or "").encode(), np.uint8)
        covered = []
        for a, b in suffix_dedup._parts(len(x), 100):
            _, _, s, _, n = suffix_dedup._posted(x[a:b], 100, 32)
            covered += [w for p, k in zip((s + a).tolist(), n.tolist(), strict=True) for w in range(p, p + k)]
        assert covered == list(range(max(0, len(x) - 99)))
    suffix_dedup._tables.cache_clear()
    if part > 1000:
        got = suffix_dedup.without_repeats(frame(spark, texts), 40, 12).toPandas().set_index("doc_id").sort_index()
        for (n, gone, runs, sha), row in zip(brute_repeats(texts, 40), got.itertuples(), strict=True):
            assert (row.n_bytes, sum(s["hi"] - s["lo"] for s in row.spans), len(row.spans), hashlib.sha256(row.kept).hexdigest()) == (n, gone, runs, sha)


def long_texts():
    """Passages that repeat across the parts of long texts, and a common line in ever new company."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") * rng.randint(1, 4)
    body = " ".join(word() for _ in range(80_000))
    passage = " ".join(word() for _ in range(80))
    line = "all rights of this line are reserved by those who wrote it, and by no one else at all"
    cut = suffix_dedup.PART - 50
    texts = [body, body[: cut - 900] + passage + body[cut:], f"{passage} new", " ".join(word() for _ in range(300))]
    return texts + [f"{' '.join(word() for _ in range(40))} {line} {' '.join(word() for _ in range(40))}" for _ in range(40)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_POSTS, 2], ids=["as it is", "hot grams"])
def test_repeats_of_production_length(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_POSTS", hot)
    texts = long_texts()
    assert len(texts[0]) > suffix_dedup.PART
    if hot == 2:
        assert len(suffix_dedup._hot_grams(suffix_dedup._narrow(frame(spark, texts), "doc_id", "text"), 100, 32)) > 0
    got = suffix_dedup.without_repeats(frame(spark, texts)).toPandas().set_index("doc_id").sort_index()
    for (n, gone, runs, sha), row in zip(brute_repeats(texts, 100), got.itertuples(), strict=True):
        assert (row.n_bytes, sum(s["hi"] - s["lo"] for s in row.spans), len(row.spans), hashlib.sha256(row.kept).hexdigest()) == (n, gone, runs, sha)


def test_hot_grams_are_found_however_thinly_they_are_spread(spark, monkeypatch):
    """A passage once in each of many texts is as hot as one in a single text: counts are of tasks, and short by a stated part at most."""
    monkeypatch.setattr(suffix_dedup, "HOT_POSTS", 50)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    passage = " ".join(word() for _ in range(14))
    texts = [f"{' '.join(word() for _ in range(20))} {passage}" for _ in range(80)] + [" ".join([passage] * 80)]
    shared = set(suffix_dedup._grams(np.frombuffer(passage.encode(), np.uint8), 100, 32).tolist())
    for some in (texts[:80], texts[80:]):
        hot = suffix_dedup._hot_grams(suffix_dedup._narrow(frame(spark, some).repartition(16), "doc_id", "text"), 100, 32)
        assert shared & set(hot.tolist()) and len(hot) < 60
    # with few counters: what is more than 2 / COUNTERS of all posts is found
    monkeypatch.setattr(suffix_dedup, "COUNTERS", 64)
    hot = suffix_dedup._hot_grams(suffix_dedup._narrow(frame(spark, texts[:80]).repartition(16), "doc_id", "text"), 100, 32)
    assert len(hot) <= 64


@given(st.lists(st.lists(st.integers(0, 12), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_counts_are_short_by_a_stated_part(tasks, most):
    counts, total = {}, 0
    for values in tasks:
        own = suffix_dedup._Frequent(most)
        for i in range(0, len(values), 3):
            own.add(np.array(values[i : i + 3], np.uint64))
        own.settle()
        assert len(own.values) <= most and own.total == len(values)
        total += own.total
        for v, n in zip(own.values.tolist(), own.counts.tolist(), strict=True):
            counts[v] = counts.get(v, 0) + n
    for v in range(13):
        true = sum(values.count(v) for values in tasks)
        assert true - total // most <= counts.get(v, 0) <= true


def test_no_documents_have_no_repeats(spark):
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.without_repeats(frame(spark, [None, ""])).select("n_bytes").collect() == [(0,), (0,)]


# ---------------------------------------------------------------- fitted operators


def corpus(n, seed):
    rng = random.Random(seed)
    good = ["".join(rng.choice("bdlmnr") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rows = []
    for i in range(n):
        text, toxic = [rng.choice(good) for _ in range(rng.randint(20, 120))], i % 4 == 0
        if toxic:
            for _ in range(max(1, len(text) // 25)):
                text.insert(rng.randrange(len(text)), "grok" + rng.choice(["ix", "um", "elo", "ant"]))
        junk = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in text) if junk else " ".join(text).capitalize() + ".", int(toxic), 0 if junk else 1))
    return rows


def test_toxicity_of_held_out_documents(spark):
    rows = corpus(900, 1) + [(5000, None, 0, 1), (5001, "", 0, 1), (5002, "lalo " * 40_000, 0, 1), (5003, "lalo " * 2000 + "grokix " * 200, 1, 1)]
    docs = spark.createDataFrame([(i, t, "held") for i, t, *_ in rows], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows] + [(1, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    truth = {i: x for i, _, x, _ in rows}
    held = got[got.held_out & (got.index < 5000)]
    right = sum(int(r.predicted == truth[i]) for i, r in held.iterrows()) / len(held)
    assert right > 0.95 and got.score.between(0, 1).all() and len(got) == len(rows)
    assert (got.predicted == (got.score >= 0.7)).all() and got.loc[5000].score == got.loc[5001].score and got.loc[5003].predicted == 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.iterrows())
    one = toxicity.toxicity(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert [r[0] for r in one] == [0.5]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_no_counted_string_is_lost(spark):
    keys = np.arange(300_000, dtype=np.int64) * 1_000_003
    values = spark.range(300_000).selectExpr("id * 1000003 AS k", "1L AS n", "cast(id % 1000 + 1 AS double) AS value")
    known, value = toxicity._table(values, 300_000)
    there, got = toxicity._looked_up(keys.astype(np.uint64), known, value)
    assert there.all() and (got == np.arange(300_000) % 1000 + 1).all()
    assert not toxicity._looked_up((keys + 1).astype(np.uint64), known, value)[0].any()


def strings_of(text):
    """Six-byte strings of each word: four zeros and a start before it, an end behind."""
    for word in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split():
        b = bytes(4) + b"\x01" + word.encode() + b"\x02"
        yield from (b[i : i + 6] for i in range(len(b) - 5))


def brute_kneser_ney(rows, d=0.75):
    """The difference of log-probabilities of each string, and of unseen bytes by context, from definitions."""
    n = [Counter(k for text, toxic in rows if toxic == c for k in strings_of(text)) for c in (0, 1)]
    seen = set(n[0]) | set(n[1])
    four = Counter(k[2:] for k in seen)
    two = Counter(k[2:] for k in four)

    def shared(k, counts, lower):
        kin = [counts[x] for x in counts if x[:-1] == k[:-1]]
        return (max(counts[k] - d, 0) + sum(min(d, x) for x in kin) * lower) / sum(kin)

    def own(k, c, p):
        kin = [n[c][x] for x in seen if x[:-1] == k[:-1]]
        total = sum(kin)
        return max(n[c][k] - d, 0) / total + sum(min(d, x) for x in kin) / total * p if total else p

    whole = n[0] + n[1]
    strings = {}
    for k in seen:
        p = shared(k, whole, shared(k[2:], four, shared(k[4:], two, 1 / 256)))
        strings[k] = math.log(own(k, 1, p) / own(k, 0, p))
    rest = lambda h, c: (lambda kin: sum(min(d, x) for x in kin) / sum(kin) if sum(kin) else 1.0)([n[c][x] for x in seen if x[:-1] == h])
    return strings, {h: math.log(rest(h, 1) / rest(h, 0)) for h in {k[:-1] for k in seen}}


def test_kneser_ney_is_brute_force(spark):
    rows = [("The grok said no", 1), ("the gro said yes yes", 0), ("a groks' tail, the tail", 1), ("", 0), ("said the tale", 0)]
    train = spark.createDataFrame([(t, x, i % 2) for i, (t, x) in enumerate(rows)], "text string, toxic long, half long")
    grams = toxicity.counts(train).select("k", (F.col("a0") + F.col("b0")).alias("n0"), (F.col("a1") + F.col("b1")).alias("n1"))
    model = toxicity.fit(grams)
    for table, expected, size in zip((model.strings, model.unseen), brute_kneser_ney(rows), (6, 5), strict=True):
        got = {r["k"].to_bytes(size, "big"): r["value"] for r in table.collect()}
        assert set(got) == set(expected) and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_large_models_score_alike(spark):
    rows = corpus(200, 3) + [(5000, None, 0, 1), (5001, " ", 0, 1), (5002, "lalo " * 3000 + "grokix " * 20, 1, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows], "doc_id long, toxic int")
    told = [sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 4)) for r in toxicity.toxicity(docs, labels, most=m).collect()) for m in (toxicity.MODEL_STRINGS, 10)]
    assert told[0] == told[1] and len(told[0]) == len(rows) + 3


def brute_features(diffs):
    """Means of a text's differences around the ring, from definitions."""
    n, out = len(diffs), [sum(diffs) / len(diffs) if diffs else 0.0]
    for m in toxicity.MARGINS:
        over = [max(d - m, 0.0) for d in diffs]
        out.append(math.sqrt(sum(over) / n) if n else 0.0)
        out += [math.log1p(max((sum(over[(i + j) % n] for j in range(w)) for i in range(n)), default=0.0)) for w in toxicity.WINDOWS]
    return out


def test_toxicity_features_are_brute_force():
    rng = random.Random(5)
    texts = [[rng.randint(-400_000, 400_000) / toxicity.SCALE for _ in range(n)] for n in (0, 1, 3, 8, 9, 0, 64, 200, 700, 0)]
    flat, rows = np.array([d for t in texts for d in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = np.column_stack(toxicity._features(flat, rows, len(texts)))
    assert got.shape[1] == len(toxicity._FEATURES) and np.allclose(got, [brute_features(t) for t in texts], rtol=0, atol=1e-9)
    assert not np.column_stack(toxicity._features(flat[:0], rows[:0], 2)).any()


def test_toxicity_scores_are_brute_force(spark):
    """Every step from definitions: both models, words, features, calibration, score."""
    rng = random.Random(8)
    good, bad = ["lalo", "mebi", "dori", "nule"], ["grok", "gru"]
    rows = [(i, " ".join(rng.choice(good + bad * (i % 3 == 0)) for _ in range(rng.randint(3, 12))), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "Grok! lalo-unseen")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    fold = {i: zlib.crc32(str(i).encode()) % 3 for i, *_ in rows}

    def described(text, model):
        strings, unseen = model
        value = lambda k: round((strings.get(k) if k in strings else unseen.get(k[:-1], 0.0)) * toxicity.SCALE) / toxicity.SCALE
        words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text or "").split()
        return brute_features([sum(map(value, strings_of(w))) for w in words])

    half, whole = (brute_kneser_ney([(t, x) for i, t, x in rows if fold[i] in kept]) for kept in ((0,), (0, 2)))
    measured = [(described(t, half), x) for i, t, x in rows if fold[i] == 2]
    beta = toxicity._logistic(np.array([f for f, _ in measured]), np.array([x for _, x in measured]))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    for i, text in [(i, t) for i, t, _ in rows] + [(900, None), (901, "Grok! lalo-unseen")]:
        z = float(np.dot(described(text, whole), beta[:-1]) + beta[-1])
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-6


def test_repeating_a_text_leaves_its_score_alone(spark):
    rows = corpus(400, 4)
    again = [(10_000 + 10 * i + k, " ".join([t] * n)) for i, t, *_ in rows[:40] for k, n in ((0, 1), (1, 4), (2, 30))] + [(20_000, "lalo"), (20_001, "lalo " * 900)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + again, "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows], "doc_id long, toxic int")
    for most in (toxicity.MODEL_STRINGS, 10):
        got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, most=most).collect()}
        assert all(abs(got[10_000 + 10 * i] - got[10_000 + 10 * i + k]) < 1e-9 for i in range(40) for k in (1, 2))
        assert abs(got[20_000] - got[20_001]) < 1e-9


def test_both_ways_of_scoring_are_equal(spark):
    rows = corpus(300, 6)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(3, rows[4][1]), (None, rows[5][1]), (7000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows], "doc_id long, toxic int")
    told = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.toxicity(docs, labels, most=m).collect()) for m in (toxicity.MODEL_STRINGS, 10)]
    assert len(told[0]) == len(rows) + 3 and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12 for a, b in zip(*told, strict=True))


def test_quality_grades(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(7000, None, "x"), (7001, " \n", "x")], "doc_id long, text string, tail_prob string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i % 2] + [(2, None)], "doc_id long, grade int")
    got = quality.grade(docs, labels).toPandas().set_index("doc_id")
    truth = {i: q for i, _, _, q in rows}
    rest = [i for i in truth if not i % 2]
    assert sum((got.loc[i].tail_prob >= 0.5) == (truth[i] == 1) for i in rest) / len(rest) > 0.95
    assert got.loc[7000].tail_prob == 0 and got.loc[7001].tail_prob == 0 and len(got) == len(rows) + 2
    assert quality.selected(docs, labels).columns == docs.columns
    assert quality.grade(docs, labels.where("grade = 1")).where("tail_prob < 1").count() == 0


def brute_grades(s, theta, grades):
    """Probabilities of the grades, the expected grade and the tails, from the definition."""
    below = [1 / (1 + math.exp(s - t)) for t in theta]
    p = [hi - lo for hi, lo in zip([*below, 1.0], [0.0, *below], strict=True)]
    return p, sum(g * x for g, x in zip(grades, p, strict=True)), [sum(p[i:]) for i in range(len(p))]


def test_grades_are_brute_force(spark):
    rows = corpus(200, 5)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q + 2 * (i % 3 == 0)) for i, _, _, q in rows], "doc_id long, grade int")
    w, theta, grades = quality.fit(docs, labels, "doc_id", "text")
    got = quality.grade(docs, labels, at_least=2).toPandas().set_index("doc_id")
    for i, text, *_ in rows:
        words = text.split()
        h = lambda values, n: (common.hashed(pa.array(values)) % np.uint64(n)).astype(int)
        s = (w[h([quality._shape(x) for x in words], quality.SHAPES)] + w[h(words, quality.WORDS) + quality.SHAPES]).sum() / len(words)
        s += w[quality.SHAPES + quality.WORDS] * sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        p, expected, tails = brute_grades(s, theta, grades)
        assert abs(got.loc[i].expected_grade - expected) < 1e-9 and abs(got.loc[i].tail_prob - tails[grades.index(2)]) < 1e-9


def test_gradients_are_differences():
    rng = np.random.default_rng(1)
    n, features = 30, 6
    sparse = np.repeat(np.arange(n), 3), rng.integers(0, features, 3 * n), rng.random(3 * n)
    y, w, theta, ridge = rng.integers(0, 3, n), rng.normal(size=features), np.array([-0.4, 0.7]), 0.01

    def loss(w, theta):
        s = [sum(w[c] * v for r, c, v in zip(*sparse, strict=True) if r == i) for i in range(n)]
        return -sum(math.log(brute_grades(s[i], theta, [0, 1, 2])[0][y[i]]) for i in range(n)) / n + ridge / 2 * (w @ w)

    by_weight, by_threshold = quality._gradients(w, theta, y, sparse, ridge)
    for j in range(features):
        step = np.eye(features)[j] * 1e-6
        assert abs((loss(w + step, theta) - loss(w - step, theta)) / 2e-6 - by_weight[j]) < 1e-7
    for j in range(2):
        step = np.eye(2)[j] * 1e-6
        assert abs((loss(w, theta + step) - loss(w, theta - step)) / 2e-6 - by_threshold[j]) < 1e-7


def test_thresholds_of_three_grades_are_ordered(spark):
    texts = [("fine words here again. " * 5, 2), ("mixed WORDS here. " * 5, 1), ("BAD!! WORDS!! " * 5, 0)]
    rows = [(i, texts[i % 3][0] + f" tail{i}", texts[i % 3][1]) for i in range(150)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int")
    w, theta, grades = quality.fit(docs, labels, "doc_id", "text")
    assert grades == [0, 1, 2] and theta[0] <= theta[1]
    got = quality.grade(docs, labels, at_least=1).toPandas().set_index("doc_id")
    assert all(got.loc[i].grade_decided == g for i, _, g in rows) and got.expected_grade.between(0, 2).all()
