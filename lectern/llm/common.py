"""Pieces that several operators share: Arrow text helpers, joins and ranks without hot tasks, components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.shared import discard, together, written

#: Bytes of text that one vectorised step holds at once.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = _LOWER.copy()
for _b in range(128):
    if not (48 <= _b <= 57 or 97 <= _ALNUM[_b] <= 122):
        _ALNUM[_b] = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- tables


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a few numbers each that may be sent to every executor (some 50 MB at most).
BROADCAST_ROWS = 2_000_000


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is small enough; else Spark shuffles it as usual."""
    return F.broadcast(small) if small.count() <= limit else small


#: A key of more rows than this is joined without a shuffle of its rows.
HOT_ROWS = 1000
#: Facts of so few rows in all (some 20 MB at most) are sent whole.
SMALL_ROWS = 200_000


def joined_back(rows: DataFrame, facts: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """rows joined with facts, a written table with one row for each key `on` and the number of the key's rows in `count`.

    Facts of keys with more than HOT_ROWS rows are few against the rows, so they are counted and broadcast and their rows stay
    where they are, however many one key has; the rest is joined as usual. The column `count` goes.
    """
    if facts.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(facts.drop(count)), on)
    hot = facts.where(F.col(count) > HOT_ROWS).drop(count)
    n = hot.count()
    if not 0 < n <= BROADCAST_ROWS:
        return rows.join(facts.drop(count), on)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(*on), on, "left_anti").join(facts.where(F.col(count) <= HOT_ROWS).drop(count), on)
    return rows.join(hot, on).unionByName(cold)


# ---------------------------------------------------------------- Arrow text


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of a batch whose texts hold about `limit` bytes at most; one longer text is a part by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start, len(sizes) - start)


def _mapped(texts: pa.Array, by: np.ndarray) -> pa.Array:
    """Each byte of the texts replaced through a table of 256 entries (bytes of 128 and more stay)."""
    texts = pa.array(texts.fill_null(""), pa.large_string()) if not pa.types.is_large_string(texts.type) else texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((off - off[0]).tobytes()), pa.py_buffer(by[raw].tobytes()))


def split_words(texts: pa.Array, lower: bool = True, alnum: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and the row of each.

    Words are runs without ASCII white space; with `alnum`, runs of ASCII digits, letters and non-ASCII characters.
    `lower` lower-cases A-Z only.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    if alnum or lower:
        texts = _mapped(texts, _ALNUM if alnum else _LOWER)
    lists = pc.ascii_split_whitespace(texts)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)


def hashed(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as an index into the distinct words of this slice."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """rows is sorted: where each of n rows begins, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


# ---------------------------------------------------------------- ranks


def ranked(df: DataFrame, within: list[str], group: str, item: str, out: str, extra: list[str] | None = None, bins: int = 256, fine: int = 64) -> DataFrame:
    """Adds `out`: the gapless rank from 0 within `within`, ordered by (group, item, extra).

    `group` and `item` are longs spread over their whole range (hashes). Ranks are counted by ranges of `group`, then of
    `item`, so neither a large `within` nor a large `group` meets in one task; only sizes of ranges go through the
    small windows.
    """
    # one key for all of `within`: plain equality then lets the join use the partitioning of the window
    k, b, f, r, off, n, m = unused([*df.columns, out], "k", "b", "f", "r", "off", "n", "m")
    at = df.withColumns(
        {
            k: F.xxhash64(*within),
            b: F.shiftright(F.col(group), 64 - (bins.bit_length() - 1)),
            f: F.shiftright(F.col(item), 64 - (fine.bit_length() - 1)),
        }
    )
    sizes = at.groupBy(k, b, group, f).agg(F.count(F.lit(1)).alias(n))
    coarse = sizes.groupBy(k, b).agg(F.sum(n).alias(m))
    before = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(k, b, F.coalesce(F.sum(m).over(before), F.lit(0)).alias(m))
    inner = Window.partitionBy(k, b).orderBy(group, f).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(n, F.coalesce(F.sum(n).over(inner), F.lit(0))).join(coarse, [k, b])
    offsets = sizes.select(k, b, group, f, (F.col(m) + F.col(n)).alias(off))
    own = Window.partitionBy(k, b, group, f).orderBy(item, *(extra or []))
    numbered = at.withColumn(r, F.row_number().over(own) - 1).join(offsets, [k, b, group, f])
    return numbered.withColumn(out, (F.col(off) + F.col(r)).cast("long")).select(*df.columns, out)


def ranked_by_hash(df: DataFrame, within: list[str], item: str, out: str, extra: list[str] | None = None, bins: int = 1024) -> DataFrame:
    """Adds `out`: the gapless rank from 0 within `within`, ordered by (item, extra); `item` is a hash over all longs.

    Rows are counted by ranges of the hash, so a large `within` is dealt over `bins` tasks; the order doesn't depend on bins.
    """
    k, b, r, off, n = unused([*df.columns, out], "k", "b", "r", "off", "n")
    at = df.withColumns({k: F.xxhash64(*within), b: F.shiftright(F.col(item), 64 - (bins.bit_length() - 1))})
    sizes = at.groupBy(k, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(k, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    own = at.withColumn(r, F.row_number().over(Window.partitionBy(k, b).orderBy(item, *(extra or []))) - 1)
    return own.join(sizes, [k, b]).withColumn(out, (F.col(off) + F.col(r)).cast("long")).select(*df.columns, out)


# ---------------------------------------------------------------- components


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node reaches over links (a, b), by alternating large-star and small-star steps.

    Each step replaces links by links to the smallest neighbour, so chains halve. Minima are aggregated before the shuffle, and
    the links of a hub stay where they are (joined_back), so no neighbourhood is gathered in one task. Ends when every
    node that isn't a root has one link, to a root.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = written(links)
    while True:
        ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if open_.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = written(least.select("a", F.least("a", "m").alias("m"), "n"))
        large = joined_back(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        own = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = joined_back(large, low, ["a"]).select(own.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = written(small)
        discard(links, least, large, low)
        links = after
    found = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
