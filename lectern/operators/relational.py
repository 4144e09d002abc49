"""Ranking, limiting, pairing and merging: the relational shapes that the analyses share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.shared import written


def conjunction(conditions: Sequence[Column | None]) -> Column:
    """All given conditions; missing ones don't filter."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def in_list(column: str, values: Sequence | None) -> Column | None:
    """An empty list doesn't filter."""
    return F.col(column).isin(list(values)) if values else None


def in_order(df: DataFrame, key: str, keys: Sequence, position: str = "position") -> DataFrame:
    """Rows of the given keys with each key's place in the request; keys without a row vanish."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], f"{key} {df.schema[key].dataType.simpleString()}, {position} int")
    return df.join(F.broadcast(wanted), key)  # the request is an argument, so its size is bounded


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The next rows behind a key."""
    return df.where(F.col(key) > last).orderBy(key).limit(limit)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", floor: int = 1) -> DataFrame:
    """The first n rows of each group, which needs `floor` rows; order ends with a unique key."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if floor > 1:
        big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= floor).drop("_size")
        ranked = ranked.join(big, list(by), "left_semi")
    return ranked.where(F.col(rank) <= n)


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[Column], bins: int) -> DataFrame:
    """A written table of df dealt by ranges of (by, order), with the number of a row's range in `_range`."""
    spark = df.sparkSession
    n = bins or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, bins: int = 0) -> DataFrame:
    """Adds `out`, from 1 in each group in order, which ends with a unique key.

    Rows are dealt by ranges of group and order and numbered within ranges, so a large group is numbered by many tasks;
    only the ranges' sizes are added up in one place.
    """
    placed = _placed(df, by, order, bins)
    size = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = size.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = placed.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_r"))
    return own.join(offsets, same).select(*(c for c in df.columns if c != out), (F.col(out) + F.col("_before")).alias(out))


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str, bins: int = 0) -> DataFrame:
    """Adds `out`: the sum of value in each group up to the row, in order, which ends with a unique key; dealt as numbered() does."""
    placed = _placed(df, by, order, bins)
    total = placed.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = placed.withColumn(out, F.sum(value).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_range") == F.col("_r"))
    return own.join(offsets, same).select(*(c for c in df.columns if c != out), (F.col(out) + F.col("_before")).alias(out))


def interleaved(df: DataFrame, by: str, order: Sequence[Column], size: int, position: str = "position") -> DataFrame:
    """Rows dealt in rounds, one of each group a round, larger groups first; `size` rows."""
    queue = df.groupBy(by).agg(F.count(F.lit(1)).alias("_queue"))
    numbered = df.withColumn("_round", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_round") <= size)
    dealt = numbered.join(queue, by).orderBy("_round", F.desc("_queue"), by).limit(size)
    return dealt.withColumn(position, F.row_number().over(Window.orderBy("_round", F.desc("_queue"), by))).drop("_round", "_queue")  # at most `size` rows


def quota_pool(df: DataFrame, text: str, own: str, order: Sequence[Column], size: int = 30, share: float = 0.75, least: int = 2) -> DataFrame:
    """Candidates with quotas: other texts share most of the pool, each at least `least`; the own text gets the rest."""
    others = df.where(F.col(text) != own).select(text).distinct().count()
    each = max(least, int(size * share / max(1, others)))
    quota = F.when(F.col(text) == own, int(size * (1 - share))).otherwise(each)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(text).orderBy(*order))).where(F.col("rank") <= quota)


def diverse(df: DataFrame, by: str, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Up to `limit` rows of each `by`: the best of every `group` first, then the best of the rest."""
    first = df.withColumn("_in", F.row_number().over(Window.partitionBy(by, group).orderBy(*order)))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy((F.col("_in") > 1).cast("int"), *order))).where(F.col("rank") <= limit).drop("_in")


def both_ways(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Each edge from either end, self-edges left out."""
    real = edges.where(F.col(source) != F.col(target))
    rest = [c for c in edges.columns if c not in (source, target)]
    return real.select(F.col(source).alias("self"), F.col(target).alias("other"), *rest).unionByName(real.select(F.col(target).alias("self"), F.col(source).alias("other"), *rest))


def pairs_within(df: DataFrame, key: str, item: str, values: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Unordered pairs of items that share a key; with `most`, keys of more items are left out before anything is paired."""
    if most is not None:
        df = df.join(df.groupBy(key).agg(F.countDistinct(item).alias("_n")).where(F.col("_n").between(2, most)).select(key), key, "left_semi")
    a = df.select(key, F.col(item).alias("a"), *(F.col(v).alias(f"{v}_a") for v in values))
    b = df.select(F.col(key).alias("_k"), F.col(item).alias("b"), *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("a") < F.col("b"))).drop("_k")


def islands(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Runs of rows whose a and b rise together by one: by, a and b of the first, and the rows of the run."""
    diagonal = df.withColumn("_d", F.col(a) - F.col(b))
    numbered = diagonal.withColumn("_g", F.col(a) - F.row_number().over(Window.partitionBy(*by, "_d").orderBy(a)))
    return numbered.groupBy(*by, "_d", "_g").agg(F.min(a).alias(a), F.min(b).alias(b), F.count(F.lit(1)).alias("steps")).drop("_d", "_g")


def last_written(new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), first: bool = False) -> DataFrame:
    """One whole row for each key: the last in the order of some columns (with `first` the first), nulls before all.

    Rows that the order doesn't tell apart, and all rows without an order, are ordered by their other columns, so the result
    doesn't depend on partitions. Rows are compared before the shuffle, so a repeated key is one row a partition.
    """
    rest = [c for c in new.columns if c not in keys]
    pick = F.min if first else F.max
    rank = [*order, *(c for c in rest if c not in order)]
    if not rank:
        return new.select(*keys).distinct()
    one = new.groupBy(*keys).agg(pick(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rank)))).alias("_row"))
    back = {c: F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(rank)}
    return one.select(*(F.col(c) if c in keys else back[c] for c in new.columns))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert: the last of the new rows of each key, and old rows of other keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(last_written(new, keys, order).select(*old.columns))


def merged_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert that changes only `update` columns of rows that are there; of repeated new rows the last counts."""
    fresh = last_written(new, keys, order)
    renamed = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in fresh.columns if c not in keys), F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(renamed, list(keys), "full_outer")
    pick = lambda c: F.when(F.col("_new") & (F.lit(c in update) | F.col("_old").isNull()), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, group: Sequence[str], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """All old rows of the groups that new has go; of new rows the last of each key comes."""
    return old.join(new.select(*group).distinct(), list(group), "left_anti").unionByName(last_written(new, keys, order).select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Insert-ignore: old rows, and the first of the new rows of each other key."""
    return old.unionByName(last_written(new, keys, order, first=True).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def deleted(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What an upsert would do to each key: insert, update, same or keep."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("update")
    return a.join(b, list(keys), "full_outer").withColumn("action", action).drop("_old", "_new")


def repacked(df: DataFrame, by: str, item: str, position: str, asked: DataFrame) -> DataFrame:
    """Positions from 0: asked items first in the order asked (once each), the others behind in their old order."""
    first = asked.groupBy(by, item).agg(F.min("asked").alias("asked"))
    order = [F.asc_nulls_last("asked"), F.col(position), F.col(item)]
    placed = numbered(df.join(first, [by, item], "left"), [by], order, "new_position")
    return placed.withColumn("new_position", F.col("new_position") - 1).drop("asked")


def neighbours(df: DataFrame, by: str, order: Sequence[str], item: str) -> DataFrame:
    """The item before and behind, in order, and on the ring."""
    line = Window.partitionBy(by).orderBy(*order)
    whole = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"previous": F.lag(item).over(line), "next": F.lead(item).over(line), "ring_next": F.coalesce(F.lead(item).over(line), F.first(item).over(whole))})
