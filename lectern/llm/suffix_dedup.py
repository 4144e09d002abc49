"""Repeated passages by bucket-pointer refinement: bytes go that a string of `length` bytes covers which also starts earlier.

Suffixes are sorted no further than `length` bytes, bucket by bucket. Initial buckets hold the positions of one q-gram:
of each window of `length` bytes only its least q-gram is posted, so equal windows meet in a bucket at the same distance
from it. A bucket is refined by identifiers of what stands at other offsets: first of the whole stretch whose windows
share the posted q-gram, which settles all copies of a stretch at once; then, for the first of each kind in buckets that
split, of the bytes that STEP neighbouring windows have in common; and last of single windows. An identifier is a
64-bit hash that depends on the bytes only, so refining is sorting in Spark on (bucket, identifier), buckets left
with one member are done with, and each round uses the identifiers of the one before. Members are equal in two or three
independent identifiers. Copies within one slice are settled before the shuffle, and those of strings that a task meets
often before they leave the task. A first count of q-grams finds the hot ones, whose buckets would be too large for a
task: their members are dealt by the whole stretch, and all kinds of it go on to the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import discard, joined_back, mixed, slices, written

LENGTH, GRAM = 100, 32
#: Neighbouring windows that one identifier of the second round stands for; a power of two.
STEP = 8
#: Window starts that are handled together: long texts go in parts.
PART = 1 << 18
#: A q-gram that is posted more often than this is hot, or, where that is more, than 2 / COUNTERS of all posts.
HOT_POSTS = 10_000
#: q-grams that a task counts at once; so counts are short by posts / COUNTERS at most, and fewer than COUNTERS q-grams are hot.
COUNTERS = 1 << 17
#: Strings that a task remembers because it has met them before; when there are more it starts anew.
REMEMBERED = 200_000

_POWER = 0x9E3779B97F4A7C15
_SALT = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd number and of its inverse."""
    n = PART + 4096
    with np.errstate(over="ignore"):
        up, down = np.full(n, _POWER, np.uint64), np.full(n, pow(_POWER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
    return np.random.default_rng(11).integers(0, np.iinfo(np.uint64).max, 256, dtype=np.uint64, endpoint=True), up, down


class _Hashes:
    """Hashes of any stretch of some bytes, from sums of byte numbers times powers."""

    def __init__(self, x: np.ndarray):
        byte, self.up, down = _tables()
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(byte[x] * down[: len(x)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.up[lo])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    size = 1
    n = len(v) - width + 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def _places(h: _Hashes, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams, and where the least one of each window stands."""
    lo = np.arange(size - gram + 1)
    v = h.of(lo, lo + gram)
    at = np.uint64(24)
    key = _least((v >> at << at) | lo.astype(np.uint64), length - gram + 1)
    return v, (key & np.uint64((1 << 24) - 1)).astype(np.int64)


def _grams(x: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The q-grams that are posted."""
    v, p = _places(_Hashes(x), len(x), length, gram)
    return v[p[np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))]]


def _posted(x: np.ndarray, length: int, gram: int):
    """Stretches of windows that share their least q-gram: hashes of gram and stretch, first window, place of the gram in it, windows."""
    h = _Hashes(x)
    v, p = _places(h, len(x), length, gram)
    s = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    e = np.append(s[1:], len(x) - length + 1)
    p = p[s]
    whole = mixed(h.of(s, e - 1 + length) + _SALT * ((p - s) * 1024 + (e - s)).astype(np.uint64))
    return v[p], whole, s, p - s, e - s


def _parts(n: int, length: int):
    """Where the parts of n bytes begin, and the bytes that their windows take."""
    for a in range(0, max(0, n - length + 1), PART):
        yield a, min(n, a + PART + length - 1)


def _rows(part: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """id, tag, bytes and row of each text, by id and tag."""
    ids, tags, texts = (part.column(c) for c in ("id", "tag", "text"))
    order = np.lexsort((tags.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)))
    for i in order.tolist():
        t = texts[i].as_buffer() if texts[i].is_valid else None
        x = np.frombuffer(t, np.uint8) if t is not None and t.size else np.zeros(0, np.uint8)
        yield ids[i].as_py(), tags[i].as_py(), x, i


def _named(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One number for each text."""
    return mixed(ids.astype(np.int64).view(np.uint64) * _SALT + tags.astype(np.int64).view(np.uint64))


def _marks(*keys: np.ndarray) -> np.ndarray:
    mark = keys[0].copy()
    for k in keys[1:]:
        mark = mixed(mark + _SALT) + k
    return mark


def _settled(name: np.ndarray, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether a row before, of another place, has the same mark; rows are in order of texts, then of `at`."""
    _, index, inverse = np.unique(mark, return_index=True, return_inverse=True)
    first = index[inverse]
    return (first != np.arange(len(mark))) & ((name[first] != name) | (at[first] != at))


class _Met:
    """The earliest place, as far as this task knows, of marks that it has met before. It forgets rather than grow, and what is forgotten is only sent again."""

    def __init__(self):
        self.seen = np.zeros(1 << 24, bool)
        self.first: dict[int, tuple[int, int, int]] = {}

    def settled(self, mark: np.ndarray, ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether an earlier place is known; the places of this call are noted."""
        slot = (mark >> np.uint64(40)).astype(np.int64)
        again = np.flatnonzero(self.seen[slot])
        self.seen[slot] = True
        out = np.zeros(len(mark), bool)
        if len(self.first) > REMEMBERED:
            self.first.clear()
            self.seen[:] = False
        for i in again.tolist():
            own, key = (int(ids[i]), int(tags[i]), int(at[i])), int(mark[i])
            known = self.first.get(key)
            if known is None or own < known:
                self.first[key] = own
            elif known < own:
                out[i] = True
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Frequent:
    """Misra and Gries's counts of values: when there are more than `most`, all go down by the one that makes the rest fit.

    That takes as much from more than `most` counts at once, so no count, nor a sum of counts of several tasks, is short by more
    than the values added / most, however they are spread.
    """

    def __init__(self, most: int):
        self.most, self.total = most, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        self.total += len(values)
        if self.size >= self.most:
            self.settle()

    def settle(self) -> None:
        weights = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        values, place = np.unique(np.concatenate([self.values, *self.held]), return_inverse=True)
        counts = np.bincount(place, weights, len(values)).astype(np.int64)
        if len(values) > self.most:
            at = len(values) - self.most - 1
            counts = counts - np.partition(counts, at)[at]
            values, counts = values[counts > 0], counts[counts > 0]
        self.values, self.counts, self.held, self.size = values, counts, [], 0


def _counted(length: int, gram: int, most: int):
    """A task's counts of the q-grams that it posts, and its number of posts, of no gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Frequent(most)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, _, x, _ in _rows(part):
                    for a, b in _parts(len(x), length):
                        own.add(_grams(x[a:b], length, gram))
        own.settle()
        for a in range(0, len(own.values), 1 << 16):
            yield pa.RecordBatch.from_arrays([_signed(own.values[a : a + (1 << 16)]), pa.array(own.counts[a : a + (1 << 16)])], names=["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([own.total], pa.int64())], names=["gram", "n"])

    return count


def _stretches(length: int, gram: int, hot: np.ndarray):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            for part in slices(batch, "text"):
                got: list[list[np.ndarray]] = [[] for _ in range(7)]
                for name, tag, x, _ in _rows(part):
                    for a, b in _parts(len(x), length):
                        v, whole, s, p, n = _posted(x[a:b], length, gram)
                        for out, y in zip(got, (v, whole, np.full(len(s), name), np.full(len(s), tag), s + a, p, n), strict=True):
                            out.append(y)
                if got[0]:
                    v, whole, name, tag, s, p, n = map(np.concatenate, got)
                    text, mark = _named(name, tag), _marks(v, whole)
                    known = _settled(text, s, mark)
                    known[~known] = met.settled(mark[~known], name[~known], tag[~known], s[~known])
                    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
                    many = hot[at] == v if len(hot) else np.zeros(len(v), bool)
                    # kinds of a hot gram go to tasks of their own; what an earlier row settles is only passed on, spread over all tasks
                    v = np.where(known, mixed(text + s.astype(np.uint64)), np.where(many, mark, v))
                    facts = (p << 13) | (n << 2) | (many << 1) | known
                    yield pa.RecordBatch.from_arrays([_signed(v), _signed(whole), pa.array(name), pa.array(tag.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(facts.astype(np.int32))], names=["bucket", "whole", "id", "tag", "at", "facts"])

    return post


def _windows(length: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, told = _Met(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                open_ = part.column("open")
                got: list[list[np.ndarray]] = [[] for _ in range(6)]
                for name, tag, x, i in _rows(part):
                    own = open_[i].values
                    at, facts = (own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "facts"))
                    order = np.argsort(at)
                    at, facts = at[order], facts[order]
                    for a, b in _parts(len(x), length):
                        here = (at >= a) & (at < a + PART)
                        if not here.any():
                            continue
                        h = _Hashes(x[a:b])
                        s, p, n = at[here] - a, facts[here] >> 13, (facts[here] >> 2) & 2047
                        t = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        gram = np.repeat(s + p, n)
                        group = (gram - t) // STEP
                        core = gram - group * STEP
                        got[0].append(mixed(h.of(core, core + length - STEP + 1) + _SALT * group.astype(np.uint64)))
                        got[1].append(h.of(t, t + length))
                        got[2].append(np.full(len(t), name))
                        got[3].append(np.full(len(t), tag))
                        got[4].append(t + a)
                        got[5].append(gram + a)
                if not got[0]:
                    continue
                core, window, name, tag, t, gram = map(np.concatenate, got)
                text = _named(name, tag)
                edge = np.flatnonzero(np.concatenate([[True], (core[1:] != core[:-1]) | (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (t[1:] != t[:-1] + 1)]))
                ends = np.append(edge[1:], len(t))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(window + (np.arange(len(t)) - np.repeat(edge, ends - edge)).astype(np.uint64)))])
                size = ends - edge
                core, name, tag, t, text = core[edge], name[edge], tag[edge], t[edge], text[edge]
                mark = _marks(core, sums[ends] - sums[edge], size.astype(np.uint64))
                known = _settled(text, t, mark)
                known[~known] = met.settled(mark[~known], name[~known], tag[~known], t[~known])
                # several kinds of one bucket here: all are open, so only the first has to meet those of other tasks
                place, n = np.unique(core[~known], return_counts=True)
                often = place[n > 1]
                spread = np.isin(core, often)
                if len(told) > REMEMBERED:
                    told.clear()
                for i in np.flatnonzero(spread & ~known).tolist():
                    if int(core[i]) not in told:
                        told.add(int(core[i]))
                        spread[i] = False
                sure = np.isin(core, often)
                offsets = np.concatenate([[0], np.cumsum(np.where(known, 0, size))]).astype(np.int32)
                kept = window[np.repeat(~known, size)]
                bucket = np.where(known | spread, mixed(text + t.astype(np.uint64)), core)
                yield pa.RecordBatch.from_arrays(
                    [_signed(bucket), _signed(core), pa.array(name), pa.array(tag.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(np.where(known, size, 0).astype(np.int32)), pa.array(sure | known), pa.ListArray.from_arrays(pa.array(offsets), _signed(kept))],
                    names=["bucket", "core", "id", "tag", "at", "known", "open", "windows"],
                )

    return split


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text as bytes); the tag tells texts of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def _hot_grams(narrow: DataFrame, length: int, gram: int) -> np.ndarray:
    """All q-grams of more than `often` posts, and none of less than half as many, sorted.

    `often` is HOT_POSTS, or 2 / COUNTERS of all posts where that is more: then counts are short by half of it at most, and
    fewer than COUNTERS of them can be above the other half.
    """
    counted = narrow.mapInArrow(_counted(length, gram, COUNTERS), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = written(counted.where(F.col("gram").isNull() | (F.col("n") > HOT_POSTS // 2)))
    total = counted.where("gram is null").agg(F.sum("n")).first()[0] or 0
    least = max(HOT_POSTS, 2 * total // COUNTERS) - total // COUNTERS
    rows = counted.where(F.col("gram").isNotNull() & (F.col("n") > least)).select("gram").toPandas()
    discard(counted)
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, spans): per text with any, the byte spans (lo, hi) that earlier strings repeat; they may overlap."""
    if not gram <= length <= 1024:
        raise ValueError("length must be between gram and 1024")
    narrow = _narrow(docs, id_col, text_col).where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(_hot_grams(narrow, length, gram))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _stretches(length, gram, hot.value)(batches)

    posts = narrow.mapInArrow(post, "bucket long, whole long, id long, tag int, at int, facts int").repartition("bucket")
    kind, bucket = Window.partitionBy("bucket", "whole"), Window.partitionBy("bucket")
    told = posts.withColumn("nth", F.rank().over(kind.orderBy("id", "tag", "at")))
    told = told.withColumn("split", (F.min("whole").over(bucket) != F.max("whole").over(bucket)) | (F.col("facts").bitwiseAND(2) == 2))
    known = (F.col("facts").bitwiseAND(1) == 1) | (F.col("nth") > 1)
    told = written(told.where(known | F.col("split")).select("id", "tag", "at", "facts", known.alias("repeats")))
    number = F.shiftright("facts", 2).bitwiseAND(2047)
    span = lambda lo, hi: ("id", "tag", lo.alias("lo"), hi.alias("hi"))
    first = told.where("repeats").select(*span(F.col("at"), F.col("at") + number + (length - 1)))

    opened = told.where("not repeats").groupBy("id", "tag").agg(F.collect_set(F.struct("at", "facts")).alias("open"))
    finer = narrow.join(opened, ["id", "tag"]).select("id", "tag", "text", "open")
    finer = finer.mapInArrow(_windows(length), "bucket long, core long, id long, tag int, at int, known int, open boolean, windows array<long>")
    finer = finer.repartition("bucket").withColumn("n", F.count(F.lit(1)).over(bucket)).where("open or n > 1")
    finer = written(finer.drop("n", "bucket", "open"))
    second = finer.where("known > 0").select(*span(F.col("at"), F.col("at") + F.col("known") + (length - 1)))
    single = finer.where("known = 0").select("core", "id", "tag", "at", F.posexplode("windows").alias("i", "window"))
    single = single.select("core", "window", "id", "tag", (F.col("at") + F.col("i")).alias("at"))
    place = F.struct("id", "tag", "at")
    least = single.groupBy("core", "window").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    third = joined_back(single, written(least), ["core", "window"]).where(place > F.col("least")).select(*span(F.col("at"), F.col("at") + length))
    return first.union(second).union(third).groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, spans (maximal removed byte runs lo, hi) and kept (the remaining bytes, binary).

    Texts count as UTF-8 bytes, null as empty; texts shorter than `length` stay whole. A string repeats if it starts earlier: in a
    document of smaller id, or earlier in the same one. Removed bytes may cut characters, so kept is binary. Ids are
    integers. Rows of one id with the same text are one document, and don't repeat each other; different texts of one id are
    documents of their own, in an order by hash. A row with a null id stays whole and others aren't compared with it. Other
    columns are left out; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, gram, id_col, text_col)
    texts = _narrow(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, removed, kept = [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    sizes.append(len(text))
                    if not own.is_valid:
                        removed.append([])
                        kept.append(text)
                        continue
                    lo, hi = (own.values.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi"))
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    runs = list(zip(lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist(), strict=True))
                    out, at = [], 0
                    for a, b in runs:
                        out.append(text[at:a])
                        at = b
                    out.append(text[at:])
                    removed.append([{"lo": a, "hi": b} for a, b in runs])
                    kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return texts.join(spans, ["id", "tag"], "left").mapInArrow(cut, "id long, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept binary").withColumnRenamed("id", id_col)
