"""Sharding by balanced label propagation, with DataFrame operations only.

Linked documents (here: those of one group, such as equal texts) start in shards in the order of their groups. In each
round a group's counts by shard are its members' votes: members move to the group's largest shard that has room, and
quotas let in no more than that room. A move never lowers the number of links inside shards, so rounds end. Documents
without links then fill every shard to its exact capacity: by hash, or dealt in turns where rows come in an order that counts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import discard, joined_back, ranked, ranked_by_hash, written

ROUNDS = 24


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (t < rows % shards) for t in range(shards)]


def _propagated(linked: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """linked (uid, g, h) with its shard; a shard holds no more rows than its capacity."""
    shards, n = len(capacity), linked.count()
    start = ranked(linked.withColumn("_all", F.lit(0)), ["_all"], "g", "h", "_rank", ["uid"]).drop("_all")
    # contiguous parts of the order, as even as capacities are, so none exceeds its own
    small, more = divmod(n, shards)
    cut = more * (small + 1)
    place = F.when(F.col("_rank") < cut, F.col("_rank") / (small + 1)).otherwise((F.col("_rank") - cut) / max(small, 1) + more)
    labelled = written(start.withColumn("shard", F.floor(place).cast("int")).drop("_rank"))
    for _ in range(rounds):
        votes = written(labelled.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n")))
        held = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        room = [c - held.get(t, 0) for t, c in enumerate(capacity)]
        free = F.array(*map(F.lit, room))
        best = votes.where(F.element_at(free, F.col("shard") + 1) > 0).groupBy("g").agg(F.max(F.struct("n", (-F.col("shard")).alias("t"))).alias("b")).select("g", (-F.col("b.t")).alias("to"), F.col("b.n").alias("most"))
        wish = votes.join(best, "g").where((F.col("to") != F.col("shard")) & ((F.col("most") > F.col("n")) | ((F.col("most") == F.col("n")) & (F.col("to") < F.col("shard"))))).select("g", "shard", "to", "n")
        wish = written(wish)
        if wish.isEmpty():
            break
        asking = ranked(joined_back(labelled, wish, ["g", "shard"]), ["to"], "g", "h", "_rank", ["uid"])
        moved = asking.where(F.col("_rank") < F.element_at(free, F.col("to") + 1)).select("uid", "to")
        after = written(labelled.join(moved, "uid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
        discard(labelled, votes, wish)
        labelled = after
    return labelled


def _standing(docs: DataFrame) -> tuple[Column, Column]:
    """The file that a row is read from and where its split begins; empty and -1 for rows that are not just read."""
    file, block = F.input_file_name(), F.expr("input_file_block_start()")
    try:
        docs.select(file, block)
    except AnalysisException:  # made of several tables
        return F.lit(""), F.lit(-1).cast("long")
    return file, block


def _spread(facts: DataFrame, rows: int) -> DataFrame:
    """facts with h, the place of each row by file, split and partition, spread over all longs.

    Scans deal splits to partitions by size, so rows of a file stand in order in a split only; uid ascends there, gapless.
    """
    facts = facts.withColumn("part", F.shiftright("uid", 33))
    parts = facts.groupBy("file", "block", "part").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.length("file"), "file", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("off"))  # a row for each split
    at = F.col("uid") + F.col("off") - rows // 2
    return facts.join(F.broadcast(parts), ["file", "block", "part"]).withColumn("h", at * ((2**63 - 1) // (rows // 2 + 1))).drop("file", "block", "part", "off")


def _dealt(spark: SparkSession, room: list[int]) -> DataFrame:
    """(_rank, shard): as many ranks as there is room, dealt in turns; a shard has at most one of a turn, and its room is spread evenly over all.

    Each turn goes round in an order of its own, so no source that comes every so many rows meets the same shard.
    """
    turns = max(1, *room)
    shares = spark.range(turns).withColumn("room", F.array(*(F.lit(c).cast("long") for c in room)))
    before = f"aggregate(room, 0L, (s, c) -> s + id * c div {turns})"
    takers = f"filter(sequence(0, {len(room) - 1}), t -> (id + 1) * room[t] div {turns} > id * room[t] div {turns})"
    dealt = shares.selectExpr(f"{before} as before", f"array_sort(transform({takers}, t -> struct(xxhash64(id, t) as o, t as shard))) as takers")
    return dealt.select("before", F.posexplode("takers").alias("pos", "taker")).select((F.col("before") + F.col("pos")).alias("_rank"), "taker.shard")


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", group: str | None = None, rounds: int = ROUNDS, in_order: bool = False) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text and 16), text_crc32, law ('rows'), shard, slot (from 0 in its shard) and grown_shard (null).

    Counts of shards are at most one apart. Rows whose texts are equal, or whose column `group` is, are linked; null texts and
    groups link nothing, a null text has no bytes and crc32 0. Repeated rows are rows of their own. Other columns
    are left out; an empty table gives no rows.

    With in_order the rows' own order counts, that of files by name and of rows in them where docs is just read, else that of
    partitions: slots follow it in every shard, and rows without links are dealt in turns, so each shard goes through all of it.
    """
    g = F.xxhash64(F.col(group)) if group else F.xxhash64(F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    file, block = _standing(docs) if in_order else (None, None)
    facts = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), F.when(F.col(group or text_col).isNotNull(), g).alias("g"), *([file.alias("file"), block.alias("block")] if in_order else []))
    facts = written(facts.withColumn("uid", F.monotonically_increasing_id()).withColumn("h", F.xxhash64(F.lit("shard"), "id")))
    rows = facts.count()
    if in_order:
        read, facts = facts, written(_spread(facts, rows))
        discard(read)
    capacity = capacities(rows, shards)
    many = written(facts.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    linked = _propagated(joined_back(facts, many, ["g"]).select("uid", "g", "h"), capacity, rounds)
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    room = [c - held.get(t, 0) for t, c in enumerate(capacity)]
    ends = list(accumulate(room))
    alone = ranked_by_hash(facts.join(linked, "uid", "left_anti").select("uid", "h").withColumn("_all", F.lit(0)), ["_all"], "h", "_rank", ["uid"])
    if in_order:
        # as many rows as alone; Spark takes them for a few, as their number isn't known before they are dealt
        alone = alone.join(_dealt(docs.sparkSession, room).hint("merge"), "_rank").select("uid", "shard")
    else:
        alone = alone.select("uid", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_rank"))).alias("shard"))
    placed = facts.join(linked.select("uid", "shard").unionByName(alone), "uid")
    out = ranked_by_hash(placed, ["shard"], "h", "slot", ["uid"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
