"""Benchmark decontamination: training tokens stream through a generalised suffix automaton of the test items.

Items go in blocks of a bounded number of words, each block one automaton. A single block is sent to all tasks. Of several, hashes of their
windows are sent, and one pass over the documents tells which blocks a text needs; only texts that need any go on, to tasks that have
their blocks. A match is a run of `window` words of an item, or a whole item that is shorter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checked_broadcast, discard, hashed, mixed, slices, split_words, unused, word_codes, written

#: Words of items in one automaton, so a broadcast is some 30 MB at most.
BLOCK_WORDS = 1 << 17
#: Hashes of windows that one pass over the documents looks for, of 12 bytes each.
PASS_SEEDS = 1 << 22
#: Bytes of texts that meet one automaton in one task.
MEET_BYTES = 64 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    vocabulary: list[str]
    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    items: list[str] = field(default_factory=list)
    whole: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    holders: dict[int, tuple[int, ...]] = field(default_factory=dict)
    shortest: int = 0

    def _state(self, step: dict[int, int], size: int, link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the longest suffix of p's strings with c; q keeps its longer strings."""
        twin = self._state(dict(self.step[q]), self.size[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new, p = self._state({}, self.size[last] + 1, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    @classmethod
    def of(cls, items: list[tuple[str, list[str]]], window: int) -> Automaton:
        vocabulary = sorted({w for _, words in items for w in words})
        number, own = {w: i for i, w in enumerate(vocabulary)}, cls(vocabulary, window)
        coded = []
        for name, words in items:
            if words:
                last, ids = 0, [number[w] for w in words]
                for c in ids:
                    last = own._extend(last, c)
                coded.append(ids)
                own.items.append(name)
        holders: dict[int, set[int]] = {}
        for i, ids in enumerate(coded):
            state = 0
            for c in ids:
                state = own.step[state][c]
                s = state
                while own.size[s] >= window and i not in holders.setdefault(s, set()):
                    holders[s].add(i)
                    s = own.link[s]
            if len(ids) < window:
                own.whole.setdefault(state, []).append((len(ids), i))
        # of the states above a match, only the one that holds its last `window` words is asked for
        own.holders = {s: tuple(v) for s, v in holders.items() if own.size[own.link[s]] < window}
        own.shortest = min((min(len(ids), window) for ids in coded), default=0)
        return own

    def scan(self, ids: list[int], at: int, marks: np.ndarray, found: set[int]) -> None:
        """Follows a run of known words that begins at `at`; adds to marks (+1 where a matched stretch begins, -1 after it) and found."""
        step, link, size, whole, window = self.step, self.link, self.size, self.whole, self.window
        state = length = 0
        for i, c in enumerate(ids):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(c)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            if length >= window:
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                marks[at + i - window + 1] += 1
                marks[at + i + 1] -= 1
                found.update(self.holders[s])
            if whole:
                s, most = state, length
                while s > 0:
                    for n, item in whole.get(s, ()):
                        if n <= most:
                            marks[at + i - n + 1] += 1
                            marks[at + i + 1] -= 1
                            found.add(item)
                    s = link[s]
                    most = size[s]


def _found(own: Automaton, texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Per text: its number of words, the maximal matched runs of words, and the items found."""
    words, rows = split_words(texts, alnum=True)
    n = len(texts)
    start = np.searchsorted(rows, np.arange(n + 1))
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    names: list[list[str]] = [[] for _ in range(n)]
    if len(words) and own.shortest:
        codes, distinct = word_codes(words)
        known = pc.fill_null(pc.index_in(distinct, vocabulary), -1).to_numpy(zero_copy_only=False)
        ids = known[codes]
        ok = ids >= 0
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (rows[1:] != rows[:-1])
        lo = np.flatnonzero(first)
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (rows[1:] != rows[:-1])
        hi = np.flatnonzero(last) + 1
        long = hi - lo >= own.shortest
        marks, found = np.zeros(len(ids) + 1, np.int32), {}
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            own.scan(ids[a:b].tolist(), a, marks, found.setdefault(int(rows[a]), set()))
        hit = np.cumsum(marks[:-1]) > 0
        edge = hit.copy()
        edge[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
        end = hit.copy()
        end[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
        for a, b in zip(np.flatnonzero(edge).tolist(), (np.flatnonzero(end) + 1).tolist(), strict=True):
            r = int(rows[a])
            runs[r].append((a - int(start[r]), b - int(start[r])))
        for r, got in found.items():
            names[r] = sorted({own.items[i] for i in got})
    return np.diff(start), runs, names


#: Windows of an item that stay in one block; longer items are cut, with the words that both parts need in each.
PIECE_WINDOWS = 4096


def _lower(text: str) -> bytes:
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def _pieces(items: DataFrame, window: int, item_id: str, text_col: str, block_words: int) -> tuple[DataFrame, int]:
    """A written table (item, words, block) of distinct items, the long ones in parts, and the number of blocks.

    Every window of an item is in one of its parts, so a block holds about block_words words whatever the items are.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(text_col, upper, lower), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    own = items.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).where("item is not null and size(words) > 0")
    step = min(PIECE_WINDOWS, max(1, block_words - window + 1))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    cut = own.distinct().select("item", "words", F.explode(starts).alias("start"))
    cut = cut.select("item", F.slice("words", F.col("start") + 1, F.lit(step + window - 1)).alias("words")).distinct()
    cut = written(cut)
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    return cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))), n


def _passing(docs: DataFrame, block: list[tuple[str, list[str]]], window: int) -> DataFrame:
    """docs (its columns, and text) with n_words, runs and items instead of the text, by one automaton, which is sent to tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton.of(block, window))
    kept = [c for c in docs.columns if c != "text"]
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        vocabulary = pa.array(own.vocabulary, pa.large_string())
        for batch in batches:
            for part in slices(batch, "text"):
                n, runs, names = _found(own, part.column("text"), vocabulary)
                spans = pa.array([[{"lo": a, "hi": b} for a, b in r] for r in runs], span)
                found = [pa.array(n, pa.int64()), spans, pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found], names=[*kept, "n_words", "runs", "items"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(scan, ", ".join([*kinds, "n_words long, runs array<struct<lo:int,hi:int>>, items array<string>"]))


def _run_hashes(words: pa.Array, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one row, and the row of each."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, distinct = word_codes(words)
    each = mixed(hashed(distinct))[codes]
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total = mixed(total) + each[i : i + size]
    own = rows[n - 1 :] == rows[:size]
    return mixed(total)[own], rows[:size][own]


def _seeds(pieces: DataFrame, window: int) -> DataFrame:
    """A written table (seed, n, block): hashes of the windows of each block, and of its items of n words, where those are fewer."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, blocks = batch.column("words"), batch.column("block").to_numpy(zero_copy_only=False)
            words, rows = pc.list_flatten(lists).cast(pa.large_string()), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            runs = np.minimum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), window)
            for n in np.unique(runs).tolist():
                own = runs[rows] == n
                seed, row = _run_hashes(words.filter(pa.array(own)), rows[own], n)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), n, np.int32)), pa.array(blocks[row].astype(np.int32))], names=["seed", "n", "block"])

    return written(pieces.select("words", "block").mapInArrow(hashes, "seed long, n int, block int").distinct())


def _needing(docs: DataFrame, seeds: DataFrame, every: bool) -> DataFrame:
    """Rows (id, h, n_words, text, blocks) of docs that hold seeds, which are sent to tasks; with `every`, also the others, without their texts."""
    rows = seeds.toPandas()  # about PASS_SEEDS
    table = {}
    for n, own in rows.groupby("n"):
        v = own["seed"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(v, kind="stable")
        table[int(n)] = v[order], own["block"].to_numpy(np.int32)[order]
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                words, row = split_words(part.column("text"), alnum=True)
                needs = [np.zeros((0, 2), np.int64)]
                for n, (seed, block) in known.items():
                    v, at = _run_hashes(words, row, n)
                    lo, hi = np.searchsorted(seed, v), np.searchsorted(seed, v, "right")
                    met = hi > lo
                    lo, hi, at = lo[met], hi[met], at[met]
                    each = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum()) if len(lo) else lo
                    needs.append(np.unique(np.stack([np.repeat(at, hi - lo), block[each].astype(np.int64)], 1), axis=0))
                need = np.unique(np.concatenate(needs), axis=0)
                offsets = np.searchsorted(need[:, 0], np.arange(part.num_rows + 1))
                any_ = np.diff(offsets) > 0
                text = pc.if_else(pa.array(any_), part.column("text"), pa.scalar(None, part.column("text").type))
                blocks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(need[:, 1], pa.int32()))
                count = pa.array(np.bincount(row, minlength=part.num_rows).astype(np.int64))
                out = pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), count, text, blocks], names=["id", "h", "n_words", "text", "blocks"])
                yield out if every else out.filter(pa.array(any_))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(look, f"id {kind}, h long, n_words long, text string, blocks array<int>")


def _met(texts: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(id, h, runs, items) for each of texts (id, h, text, block) in which its block finds any.

    The texts of a block are dealt over tasks by MEET_BYTES, so a passage that many documents hold doesn't gather them in one.
    """
    sizes = texts.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = written(sizes.select("block", F.ceil(F.col("bytes") / MEET_BYTES).cast("int").alias("parts")))
    sizes = checked_broadcast(sizes)
    left = texts.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id", "h"), F.col("parts").cast("long")))
    right = pieces.join(sizes, "block").select("item", "words", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    kind = texts.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def find(docs: pa.Table, items: pa.Table) -> pa.Table:
        rows = sorted(zip(items.column("item").to_pylist(), items.column("words").to_pylist(), strict=True))
        own = Automaton.of(rows, window)
        vocabulary = pa.array(own.vocabulary, pa.large_string())
        out = []
        for batch in docs.to_batches():
            for part in slices(batch, "text"):
                _, runs, names = _found(own, part.column("text"), vocabulary)
                spans = pa.array([[{"lo": a, "hi": b} for a, b in r] for r in runs], span)
                out.append(pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), spans, pa.array(names, pa.list_(pa.string()))], names=["id", "h", "runs", "items"]))
        schema = pa.schema([docs.schema.field("id"), docs.schema.field("h"), pa.field("runs", span), pa.field("items", pa.list_(pa.string()))])
        return pa.Table.from_batches(out, None if out else schema)

    left = left.select("id", "h", "text", "block", "part").groupBy("block", "part")
    met = left.cogroup(right.groupBy("block", "part")).applyInArrow(find, f"id {kind}, h long, runs array<struct<lo:int,hi:int>>, items array<string>")
    return met.where(F.size("runs") > 0)


def _matched(docs: DataFrame, items: DataFrame, window: int, id_col: str, item_id: str, text_col: str, block_words: int) -> DataFrame:
    """Rows (id, h, n_words, runs, items), one for each document; h is a hash of the text, so equal (id, h) have equal runs."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    pieces, blocks = _pieces(items, window, item_id, text_col, block_words)
    if blocks == 1:
        rows = pieces.select("item", "words").orderBy("item", "words").collect()  # about block_words
        return _passing(keyed, [(r["item"], r["words"]) for r in rows], window)
    pieces = written(pieces)
    seeds = _seeds(pieces, window)
    passes = max(1, -(-seeds.count() // PASS_SEEDS))
    dealt = seeds.withColumn("pass", F.pmod(F.xxhash64("seed"), F.lit(passes)))
    # the first pass keeps a row of every document, further ones only of documents that need more blocks
    seen = [written(_needing(keyed, dealt.where(F.col("pass") == i), i == 0)) for i in range(passes)]
    first = seen[0].select("id", "h", "n_words")
    texts = None
    for s in seen:
        need = s.where(F.size("blocks") > 0).select("id", "h", "text", F.explode("blocks").alias("block"))
        texts = need if texts is None else texts.unionByName(need)
    # rows of one id and text need the same blocks, and get the same finds
    texts = written(texts.dropDuplicates(["id", "h", "block"]))
    lists = lambda c: F.flatten(F.collect_list(c))
    found = _met(texts, pieces, window).groupBy("id", "h").agg(lists("runs").alias("runs"), lists("items").alias("items"))
    found = written(found.select(F.col("id").alias("i"), F.col("h").alias("g"), _united(F.array_sort("runs")).alias("runs"), F.array_sort(F.array_distinct("items")).alias("items")))
    discard(texts, seeds, pieces)
    both = first.join(checked_broadcast(found, 100_000), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<lo:int,hi:int>>"))
    return both.select("id", "h", "n_words", runs.alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _united(spans: Column) -> Column:
    """Sorted runs without overlaps: those that touch become one."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        united = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (r["lo"] <= last["hi"]), united).otherwise(F.concat(done, F.array(r)))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(spans, F.array().cast("array<struct<lo:int,hi:int>>"), add))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: id, n_words, runs (maximal matched runs of words, as lo and hi), items (ids of the items found, sorted as strings).

    Null and empty texts have no words and no runs. Items without an id or words match nothing; repeated items count once.
    Rows stay rows: ids may repeat, with equal or other texts, or be null. Other columns are left out; an empty
    table gives no rows. Results don't depend on block_words, the words of items in one automaton. docs are read once for every PASS_SEEDS windows of items.
    """
    return _matched(docs, items, window, id_col, item_id, text_col, block_words).drop("h").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """matches() as counts: n_words, n_hit, n_items, items_sha256 and contaminated; runs and items go."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": hit > 0}).drop("runs", "items")


def cut_spans(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """The text without the words of the runs and what stands between them."""
    if not text or not runs:
        return text
    raw, spans = text.encode(), [m.span() for m in _WORD.finditer(_lower(text))]
    out, at = [], 0
    for lo, hi in runs:
        out.append(raw[at : spans[lo][0]])
        at = spans[hi - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def cleaned(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, with its columns, without matched spans; documents of which more than max_coverage matches go altogether.

    Documents without a match stay as they are, null and empty texts among them. n_chars follows the text where there is such
    a column. Rows are judged by their own texts: ids may repeat or be null, and columns may have any names. An empty
    table of documents or of items changes nothing.
    """
    names = docs.columns
    ident, text_hash, runs, words = unused(names, "id", "h", "runs", "n_words")
    found = _matched(docs, items, window, id_col, item_id, text_col, block_words).where(F.size("runs") > 0)
    found = found.dropDuplicates(["id", "h"]).select(F.col("id").alias(ident), F.col("h").alias(text_hash), F.col("runs").alias(runs), F.col("n_words").alias(words))
    found = checked_broadcast(written(found), 100_000)  # runs are some hundred bytes
    covered = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (F.xxhash64(text_col) == F.col(text_hash))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [cut_spans(t, [(r["lo"], r["hi"]) for r in own]) for t, own in zip(part.column(text_col).to_pylist(), part.column(runs).to_pylist(), strict=True)]
                own = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(own, names=names)

    whole = docs.join(found, same, "left_anti")
    part = found.where(covered <= max_coverage * F.col(words))
    dirty = docs.join(part, same).select(*(F.col(f"`{c}`") for c in names), runs).mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        dirty = dirty.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(dirty)


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, list[str], str]:
    """n_words, n_hit, items and items_sha256 of one document, by comparing everything; for tests."""
    words = [w.decode() for w in _WORD.findall(_lower(text or ""))]
    hit, names = set(), set()
    for name, item in items:
        own = [w.decode() for w in _WORD.findall(_lower(item or ""))]
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    found = sorted(names)
    return len(words), len(hit), found, hashlib.sha256(",".join(found).encode()).hexdigest()
