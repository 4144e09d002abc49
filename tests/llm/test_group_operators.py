"""Mixing, chats, shards, near duplicates and neighbours against brute force or their law."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat, minhash, mixing, pivots, sharding

# ---------------------------------------------------------------- mixing


def test_mix_of_documents(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None), "x") for i in range(600)] + [(9999, "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, in_mix string")
    weights = {"hot": 0.5, "b": 0.3, None: 0.2}
    got = mixing.mixed(docs, weights, block_rows=2).toPandas()
    assert len(got) == 601 and got.in_mix.dtype == bool
    assert got[got.source == "none"].mix_slot.isna().all()
    told = got[got.mix_slot.notna()]
    assert told.mix_position.is_unique
    mix = got[got.in_mix].sort_values("mix_position")
    assert mix.mix_position.tolist() == list(range(len(mix)))
    for s, w in weights.items():
        own = (mix.source.isna() if s is None else mix.source == s).to_numpy()
        blocks = np.concatenate([[0], np.cumsum(own)])[::2] / 2
        assert (np.abs(blocks - w * np.arange(len(blocks))) < 1.01).all()
    assert mixing.mixed(docs.limit(0), weights).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.001, 10), st.integers(0, 60)), min_size=1, max_size=8), st.integers(1, 100))
def test_schedule_keeps_the_weights_given(sources, stride):
    plan = mixing.Schedule({f"{i}": w for i, (w, _) in enumerate(sources)}, {f"{i}": n for i, (_, n) in enumerate(sources)})
    whole = plan.replay(0, plan.total, [0] * len(sources))
    parts = [plan.replay(a, b, np.frombuffer(served, np.int64).tolist()) for a, b, served in plan.starts(stride)]
    assert [i for part in parts for i in part] == whole
    w, n = (np.array(x, float) for x in zip(*sources))
    served, low = np.zeros(len(sources)), 0.0
    for slot, i in enumerate(whole, 1):
        served[i] += 1
        high = (n / w).max()
        for _ in range(80):  # the virtual time at which so many blocks are due in all
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(w * mid, n).sum() < slot else (low, mid)
        assert (np.abs(served - np.minimum(w * high, n)) < 1 + 1e-6).all()
    assert (served == n).all()


def test_error_of_weights_doesnt_grow():
    rows = {"a": 199_001, "b": 150_007, None: 50_003, "rare": 97}
    weights = {s: n**0.9 for s, n in rows.items()}
    plan = mixing.Schedule(weights, rows)
    slots = np.array(plan.replay(0, plan.kept_until(rows), [0] * 4))
    assert len(slots) > 30_000
    for i, s in enumerate(plan.names):
        served = np.cumsum(slots == i)
        assert np.abs(served - weights[s] / sum(weights.values()) * np.arange(1, len(slots) + 1)).max() < 1 + 1e-6


def test_many_sources_are_mixed(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2500}") for i in range(3000)], "doc_id long, source string")
    got = mixing.mixed(docs, mixing.tempered(docs)).toPandas()
    assert sorted(got.mix_position) == list(range(3000))


# ---------------------------------------------------------------- chats

said = st.lists(st.sampled_from(["a", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "/", "\n", "s>", "é", "\0", "[", "n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\nrole[INST]", "back\\slash", ""]), said), max_size=6))
def test_template_reads_back(turns):
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat._restored(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not re.search(r"</?s>|\[/?INST\]", chat.escape(t))


def test_branches_of_a_tree(spark):
    rows = [("c", 1, None, "user", "q", 0.0), ("c", 2, 1, "assistant", "bad", 0.1), ("c", 3, 1, "assistant", "good", 0.9), ("c", 4, 3, "user", "more", 0.9), ("c", 5, 4, "assistant", None, 0.9), ("c", 6, 3, "user", "x", 0.2)]
    rows += [("d", 1, 77, "user", "parent is gone", 0.0), ("loop", 1, 2, "user", "a", 0.0), ("loop", 2, 1, "user", "b", 0.0), (None, 1, None, "user", "no conv", 0.0), (None, 2, 1, "assistant", "answer", 0.5), (None, 3, 1, "assistant", "less", 0.1)]
    rows += [("long", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 0.0) for i in range(37)]
    messages = spark.createDataFrame([(*r, 1) for r in rows + rows[:2]], "conv string, node long, parent long, role string, text string, score double, formatted int")
    got = {(r["conv"], r["rank"]): r for r in chat.conversations(messages, 2).collect()}
    assert [t["text"] for t in got["c", 1]["turns"]] == ["q", "good", "more", ""] and [t["text"] for t in got["c", 2]["turns"]] == ["q", "good", "x"]
    assert [t["text"] for t in got["long", 1]["turns"]] == [f"t{i}" for i in range(37)]
    assert [t["text"] for t in got[None, 1]["turns"]] == ["no conv", "answer"] and [t["text"] for t in got[None, 2]["turns"]] == ["no conv", "less"]
    assert set(got) == {("c", 1), ("c", 2), ("d", 1), ("long", 1), (None, 1), (None, 2)}
    assert chat.conversations(messages.limit(0)).count() == 0


def test_chains_by_turn(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one"), (1, 2, "assistant", "two"), (2, None, None, None), (None, 2, "assistant", "b"), (None, 1, "user", "a"), (None, 3, "user", None)]
    got = {r["conv"]: r for r in chat.read_back(chat.conversations(chat.chains(spark.createDataFrame(rows, "conv long, turn long, role string, text string")))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 6 and got[2]["n_turns"] == 1
    assert (got[None]["n_turns"], got[None]["loss_chars"]) == (3, 1) and got[None]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nuser\n\n").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\none\nassistant\ntwo\nassistant\ntwo\n").hexdigest()


def test_the_plan_of_long_conversations_stays_small(spark, capsys):
    def told(turns):
        rows = [(i, i - 1 if i else None, f"t{i}") for i in range(turns)]
        messages = spark.createDataFrame(rows, "node long, parent long, text string").selectExpr("1L as conv", "*", "'user' as role", "0.0 as score")
        chats = chat.conversations(messages)
        capsys.readouterr()
        chats.explain()
        plan = capsys.readouterr().out
        assert [t["text"] for t in chats.first()["turns"]] == [r[2] for r in rows]
        return plan.count("Join"), plan.count("Exchange")

    assert told(300) == told(2)


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize("n, shards", [(0, 4), (3, 5), (1000, 40)])
def test_shards_are_even_and_keep_groups(spark, n, shards):
    text = lambda i: None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"pair {i // 4}" if i % 4 < 2 else f"own {i}")
    docs = spark.createDataFrame([(i, text(i), "s") for i in range(n)] + ([(1, text(1), "s")] if n else []), "doc_id long, text string, shard string")
    got = sharding.balanced_shards(docs, shards).toPandas()
    rows = n + (n > 0)
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert len(got) == rows and sizes.max() - sizes.min() <= 1 and set(got.law) <= {"rows"}
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    for r in got.itertuples():
        t = (text(r.doc_id) or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
    if n == 1000:
        spans = got.assign(t=[text(i) for i in got.doc_id]).dropna(subset=["t"]).groupby("t").agg(rows=("shard", "size"), shards=("shard", "nunique"))
        cut = spans[(spans["rows"] <= 25) & (spans.shards > 1)]
        assert len(cut) <= 2 and spans.loc["hot"].shards <= spans.loc["hot"]["rows"] / (rows / shards) + 2


def test_propagation_lowers_cut_groups(spark):
    from lectern.llm.sharding import _propagated, capacities

    linked = spark.range(2100).selectExpr("id AS uid", "xxhash64(id div 7) AS g", "xxhash64('shard', id) AS h")
    cut = []
    for rounds in (0, 24):
        got = _propagated(linked, capacities(2400, 40), rounds).toPandas()
        cut.append(int((got.groupby("g").shard.nunique() - 1).sum()))
        assert len(got) == 2100 and got.groupby("shard").size().max() <= 60
    assert cut[1] < cut[0] / 2


@pytest.mark.parametrize("room", [[3, 0, 5, 1], [0, 0], [1], [7, 6, 7]])
def test_room_is_dealt_in_turns(spark, room):
    dealt = [r["shard"] for r in sorted(sharding._dealt(spark, room).collect(), key=lambda r: r["_rank"])]
    assert [dealt.count(t) for t in range(len(room))] == room
    ranks = sorted(r["_rank"] for r in sharding._dealt(spark, room).collect())
    assert ranks == list(range(sum(room)))
    for k in range(len(dealt) + 1):  # a prefix has each shard's part of it, within one row of each turn
        assert all(abs(dealt[:k].count(t) - k * c / sum(room)) < 2 for t, c in enumerate(room) if sum(room))


def test_linked_rows_keep_the_order_too(spark):
    docs = spark.createDataFrame([(1000 - i, "same" if i % 10 == 0 else f"own {i}") for i in range(300)], "doc_id long, text string")
    got = sharding.balanced_shards(docs, 7, in_order=True).toPandas().sort_values(["shard", "slot"])
    sizes = got.groupby("shard").size()
    assert len(got) == 300 and sizes.max() - sizes.min() <= 1 and got[(1000 - got.doc_id) % 10 == 0].shard.nunique() == 1
    assert all(list(own.doc_id) == sorted(own.doc_id, reverse=True) for _, own in got.groupby("shard"))


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = list(range(len(sets)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(150)]

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = f"e{rng.random()}"
        return out

    texts = [" ".join(edited(base, rng.randint(0, 9))) for _ in range(120)]  # one large group of more or less near copies
    texts += [" ".join(rng.choice(base) for _ in range(rng.randint(3, 60))) for _ in range(80)]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b c d", "a b c d"] + [texts[0].upper()] * 20
    texts += ["long " + " ".join(str(rng.random()) for _ in range(20_000))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(docs).toPandas().set_index("doc_id").sort_index()
    sizes, found = brute_components(texts)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == found
    assert (got.kept == (got.index == got.component_id)).all()
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(found))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1600] = x[7]  # many equal vectors
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(5000, None, "s"), (5001, [0.0] * 16, "s"), (5002, [float("nan")] + [1.0] * 15, "s"), (5003, [1.0, None] + [1.0] * 14, "s"), (5004, [1.0], "s"), (5005, [float("inf")] * 16, "s"), (None, [1.0] * 16, "s")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    asked = vectors.where("vec_id % 20 = 0 or vec_id = 7")
    got = pivots.neighbours(vectors, asked, 10).toPandas()
    y = x.astype(np.float64)
    score = y @ y.T
    hit = total = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and q not in set(own.vec_id) and own.vec_id.is_unique
        assert np.allclose(own.score, score[q, own.vec_id])
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(own.itertuples(), list(own.itertuples())[1:], strict=False))
        s = score[q].copy()
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:10]
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 10
    assert got.query_id.nunique() == 151 and hit / total >= 0.9
    assert got[got.query_id == 7].sort_values("rank").vec_id.tolist() == list(range(1000, 1010))
    few = pivots.neighbours(vectors.where("vec_id < 5"), vectors.where("vec_id < 2"), 20).toPandas()
    assert len(few) == 8
    assert pivots.neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [None, 0.3], ids=["one cloud", "clusters"])
def test_neighbours_of_many_vectors(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50_000, 24)) if spread is None else rng.normal(size=(200, 24))[rng.integers(0, 200, 50_000)] + spread * rng.normal(size=(50_000, 24))
    x = x.astype(np.float32)
    pandas = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()})
    vectors = spark.createDataFrame(pandas, "vec_id long, embedding array<float>").repartition(4)
    got = pivots.neighbours(vectors, vectors.where("vec_id % 500 = 0"), 20).toPandas()
    y = x.astype(np.float64)
    hit = 0
    for q, own in got.groupby("query_id"):
        score = y @ y[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
        assert np.allclose(own.sort_values("rank").score, score[own.sort_values("rank").vec_id])
    assert len(got) == 2000 and hit / 2000 >= 0.9
