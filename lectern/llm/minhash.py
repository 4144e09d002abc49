"""MinHash near-duplicates by b-bit signatures.

Documents with equal shingle sets are one class. Classes that share a band of minima are candidates; their packed low bits
give a collision-corrected similarity that drops hopeless candidates, and full sets confirm the rest. In a band's bucket
every class is compared with the bucket's leader, so large groups of near copies make pairs in proportion to their
size. Classes of one bucket that these links leave apart are compared with one another, in blocks, unless what they
share with the leader rules a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import HOT_ROWS, SMALL_ROWS, checked_broadcast, components, hashed, joined_back, mixed, slices, split_words, unused, word_codes, written

SHINGLE = 5
#: Bands of ROWS minima: two sets of similarity 0.75 share none with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum; 128 of them make two packed words of 64 bits for each of the BITS.
BITS = 4
#: Candidates go on when their corrected estimate is this near the threshold: five standard errors of 128 minima.
SLACK = 0.2
#: Places of the map of what a class has beyond its leader; members of a bucket that one task compares with as many others.
MAP_BITS, BLOCK = 1024, 4096
#: Bytes of the sets of hot leaders that may be sent to every executor.
BROADCAST_BYTES = 64 << 20

_K = BANDS * ROWS
_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(1, 1 << 63, _K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _K, dtype=np.uint64)
_BAND = (_rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _shingles(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles: of all its words, if fewer than SHINGLE; empty without words."""
    words, rows = split_words(texts)
    codes, distinct = word_codes(words)
    h = hashed(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
    start = np.searchsorted(rows, np.arange(len(texts) + 1))
    rolled = np.zeros(len(h), np.uint64)
    if len(h) >= SHINGLE:
        acc = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            acc = acc * _TURN + h[j : len(h) - SHINGLE + 1 + j]
        rolled[: len(acc)] = mixed(acc)
    out = []
    for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(rolled[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            acc = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                acc = acc * _TURN + h[j]
            out.append(mixed(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minima(s: np.ndarray) -> np.ndarray:
    out = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(out, (_MULTIPLY[:, None] * s[None, i : i + 1024] + _ADD[:, None]).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(s: np.ndarray) -> list[np.uint64]:
    return [mixed(s).sum(), mixed(s * _TURN + np.uint64(len(s))).sum()]


def _described(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray | None], list[np.ndarray | None], np.ndarray]:
    """Per set its size, the keys of its bands, its packed bits and a 128-bit digest of the whole set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    digest = np.zeros((len(sets), 2), np.uint64)
    bands, bits = [], []
    for i, s in enumerate(sets):
        if not len(s):
            bands.append(None)
            bits.append(None)
            continue
        with np.errstate(over="ignore"):
            digest[i] = _digest(s)
            low = _minima(s)
            top = mixed(low >> np.uint64(16))
            bands.append(_signed(mixed((top.reshape(BANDS, ROWS) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))))
        packed = [np.packbits(((top >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for j in range(BITS)]
        bits.append(np.concatenate(packed))
    return sizes, bands, bits, digest


def signatures(source: DataFrame) -> DataFrame:
    """Per row (id, text): id, n_shingles, d0 and d1 (digest of the set), bands and bits (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, bands, bits, digest = _described(_shingles(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(_signed(digest[:, 0].copy())), pa.array(_signed(digest[:, 1].copy())), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "n_shingles", "d0", "d1", "bands", "bits"])

    return source.select("id", "text").mapInArrow(sign, "id long, n_shingles long, d0 long, d1 long, bands array<long>, bits array<long>")


def estimate(a: str, b: str):
    """Similarity from two columns of packed bits: the share of minima whose bits agree, less what agrees by chance."""
    words = _K // 64
    differ = None
    for w in range(words):
        parts = [F.element_at(a, j * words + w + 1).bitwiseXOR(F.element_at(b, j * words + w + 1)) for j in range(BITS)]
        any_bit = parts[0]
        for p in parts[1:]:
            any_bit = any_bit.bitwiseOR(p)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    chance = 2.0**-BITS
    return ((_K - differ) / F.lit(float(_K)) - chance) / (1 - chance)


def _sets(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the set of each of the ids of a table of unique ids and their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = pa.array([_signed(s) for s in _shingles(part.column("text"))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), sets], names=["id", "s"])

    wanted = source.join(checked_broadcast(ids), "id", "left_semi")
    return wanted.mapInArrow(make, "id long, s array<long>").where(F.size("s") > 0)


def _compared(pairs: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table with what their full sets share (i), whether that links them, and a map of b's shingles that a lacks."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = written(_sets(source, ids))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    first = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    # the set of a leader with many members is sent to them, if all such sets are small enough
    hot = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select("a").join(first, "a"))
    size = hot.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sa") * 8).alias("bytes")).first()
    if size["n"] and size["bytes"] <= BROADCAST_BYTES:
        few = F.broadcast(hot)
        both = both.join(few, "a").unionByName(both.join(few.select("a"), "a", "left_anti").join(first, "a"))
    else:
        both = both.join(first, "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked, maps = [], [], []
            for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (sa, sb))
                own = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y
                i = len(y) - int(own.sum())
                shared.append(i)
                linked.append(100 * i >= percent * (len(x) + len(y) - i))
                bits = np.zeros(MAP_BITS, np.uint8)
                bits[(y[own] % np.uint64(MAP_BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).view(np.int64))
            columns = [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()), pa.array(maps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "i", "linked", "map"])

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, i long, linked boolean, map array<long>")


def _possible(percent: int):
    """Whether rows x and y of one bucket can be similar enough, by what each shares with the bucket's leader.

    They share no more than the lesser of those counts and, beyond the leader, no more than the one's own shingles less
    those whose place in its map is empty in the other's. Rows that weren't compared with the leader aren't ruled out.
    """
    width = MAP_BITS // 64
    lacks = lambda p, q: sum((F.bit_count(F.element_at(p, w).bitwiseAND(F.bitwise_not(F.element_at(q, w)))) for w in range(1, width + 1)), F.lit(0))
    beyond = F.least(F.col("na") - F.col("ia") - lacks("ma", "mb"), F.col("nb") - F.col("ib") - lacks("mb", "ma"))
    most = F.least(F.col("ia"), F.col("ib")) + beyond
    return F.coalesce(most * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - most), F.lit(True))


def _apart(members: DataFrame, percent: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of a written table (key, blocks, id, component, n, bits, i, map) of one key and different components that may be similar enough.

    A key's members are dealt over its blocks and every two blocks meet by themselves, so a large bucket is many tasks.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(z: str, row: str, column: str) -> DataFrame:
        facts = (("component", "c"), ("n", "n"), ("bits", "b"), ("i", "i"), ("map", "m"))
        own = dealt.select("key", "blocks", F.col("block").alias(row), F.col("id").alias(z), *(F.col(c).alias(t + z) for c, t in facts))
        return own.withColumn(column, every).drop("blocks")

    close = F.least("na", "nb") * 100 >= F.lit(percent) * F.greatest("na", "nb")
    may = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close & (estimate("ba", "bb") >= similarity - SLACK) & _possible(percent)
    right = side("b", "q", "p").withColumnsRenamed({"key": "k", "p": "r", "q": "s"})
    return side("a", "p", "q").join(right, (F.col("key") == F.col("k")) & (F.col("p") == F.col("r")) & (F.col("q") == F.col("s")) & may).select("a", "b").distinct()


def _classed(signed: DataFrame, source: DataFrame, similarity: float) -> DataFrame:
    """(id, component): the smallest id that each id of a written table of signatures reaches over links; ids with an empty set are left out.

    source: (id, text) with unique ids, none of them null.
    """
    percent = round(similarity * 100)
    filled = signed.where("n_shingles > 0")
    alike = ["d0", "d1", "n_shingles"]
    # exact classes: the smallest id stands for all with the same set
    classes = written(filled.groupBy(*alike).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    member = written(joined_back(filled.select("id", *alike), classes, alike).select("id", "rep"))
    reps = member.where("id = rep").select("id")
    facts = written(filled.join(reps, "id", "left_semi").select("id", F.col("n_shingles").alias("n"), "bands", "bits"))

    # buckets of a band; the leader is the member with the most company in all its bands
    posted = facts.where("n > 1").select("id", F.explode("bands").alias("key"))
    shared = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("m", F.col("n")))
    posts = written(joined_back(posted, shared, ["key"]))
    company = posts.groupBy("id").agg(F.sum("m").alias("all"))
    most = F.max(F.struct("all", (-F.col("id")).alias("id")))
    leaders = posts.select("key", "id", "m").join(company, "id").groupBy("key").agg(most.alias("l"), F.first("m").alias("n"))
    posts = written(joined_back(posts.select("key", "id"), written(leaders.select("key", (-F.col("l.id")).alias("leader"), "n")), ["key"]))
    star = written(posts.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    led = star.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    a = written(facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")).join(led, "a"))
    b = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    close = F.least("na", "nb") * 100 >= F.lit(percent) * F.greatest("na", "nb")
    first = joined_back(star, a, ["a"]).join(checked_broadcast(b, SMALL_ROWS), "b").where(close & (estimate("ba", "bb") >= similarity - SLACK)).select("a", "b")
    told = written(_compared(written(first), source, percent))
    links = told.where("linked").select("a", "b")
    joined = written(components(reps, links))

    # what the stars left apart: classes of buckets with several components
    placed = posts.join(checked_broadcast(joined, SMALL_ROWS), "id")
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    several = several.where("x < y").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    apart = joined_back(placed, written(several), ["key"]).join(checked_broadcast(facts.select("id", "n", "bits"), SMALL_ROWS), "id")
    led = checked_broadcast(told.select(F.col("a").alias("leader"), F.col("b").alias("id"), "i", "map"), SMALL_ROWS)
    apart = apart.join(led, ["leader", "id"], "left")
    own = F.col("id") == F.col("leader")
    nothing = F.array_repeat(F.lit(0).cast("long"), MAP_BITS // 64)
    apart = apart.withColumns({"i": F.when(own, F.col("n")).otherwise(F.col("i")), "map": F.when(own, nothing).otherwise(F.col("map"))})
    rest = _apart(written(apart.drop("leader")), percent, similarity)
    done = told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(done, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        late = written(_compared(rest, source, percent).where("linked").select("a", "b"))
        if not late.isEmpty():
            stars = joined.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            joined = components(reps, stars.unionByName(late))

    placed = written(joined.join(classes.select("rep", "n"), F.col("id") == F.col("rep")).select("rep", "component", "n"))
    return joined_back(member, placed, ["rep"]).select("id", "component")


def _judged(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with a number of their own in `_row`, and (row, id, n_shingles, component_id, first) of each.

    Every row is a node of its own, so texts of one id are judged one by one. component_id is the smallest id of a component; first
    tells the row of it that has that id and, of several such rows, the least number. Equal rows without words have one first.
    """
    (number,) = unused(docs.columns, "_row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()))
    named = rows.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(named.select(F.col("row").alias("id"), "text")))
    known = written(signed.select(F.col("id").alias("row"), "n_shingles").join(named.select("row", "id", F.xxhash64("text").alias("h")), "row"))
    node = named.where("id is not null").select(F.col("row").alias("id"), "text")
    able = signed.join(known.where("id is not null").select(F.col("row").alias("id")), "id", "left_semi")
    classed = _classed(written(able), node, similarity).withColumnsRenamed({"id": "row", "component": "c"})
    told = written(known.join(classed, "row", "left"))
    facts = [F.min(F.struct("id", "row")).alias("f"), F.count(F.lit(1)).alias("n")]
    linked = told.where("c is not null")
    linked = joined_back(linked, written(linked.groupBy("c").agg(*facts)), ["c"])
    # rows without words have no links: those that are equal in id and text are one
    alone = told.where("c is null and id is not null").drop("c")
    alone = joined_back(alone, written(alone.groupBy("id", "h").agg(*facts)), ["id", "h"])
    columns = ["row", "id", "n_shingles", F.col("f.id").alias("component_id"), (F.col("row") == F.col("f.row")).alias("first")]
    lone = told.where("id is null").select("row", "id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("first"))
    return rows, linked.select(*columns).unionByName(alone.select(*columns)).unionByName(lone)


def _unique(docs: DataFrame, id_col: str) -> bool:
    return docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id).

    Texts are lower-cased (A-Z) and split at ASCII white space; the set holds the distinct shingles of five words, or
    the whole sequence of fewer. Null, empty and blank texts have an empty set and no links. Ids are integers and may repeat: every
    row is judged by its own text, so different texts of one id may be in different components. A row with a null id has no
    links, and null component_id and kept. Other columns are left out; an empty table gives no rows.
    """
    if _unique(docs, id_col):
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        signed = written(signatures(source))
        classed = _classed(signed.where("id is not null"), source.where("id is not null"), similarity)
        out = signed.select("id", "n_shingles").join(classed, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    else:
        out = _judged(docs, similarity, id_col, text_col)[1].select("id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, that stand for their group: one with the smallest id of each group.

    Only rows with a link go, and all but one of the rows that are equal in id and text. Different texts of one id are judged one
    by one; rows with a null id have no links and all stay. Columns may have any names; an empty table gives no rows.
    """
    (ident,) = unused(docs.columns, "gone")
    if _unique(docs, id_col):
        told = near_duplicates(docs, similarity, id_col, text_col)
        gone = checked_broadcast(written(told.where("not kept").select(F.col(id_col).alias(ident))))
        return docs.join(gone, docs[id_col] == gone[ident], "left_anti")
    rows, told = _judged(docs, similarity, id_col, text_col)
    gone = checked_broadcast(written(told.where("not first").select(F.col("row").alias(ident))))
    return rows.join(gone, rows[rows.columns[-1]] == gone[ident], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
