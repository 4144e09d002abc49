"""Structured Streaming over the search log: an append sink, event-time counts, and upkeep of the postings."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern import schemas
from lectern.sources.files import Folder
from lectern.sources.segments import Segments


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.LOGS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as far as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type; the same plan serves batch and stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    counted = source.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    counted = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def append_sink(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The log as Parquet. Without `every` what is there now is handled, and the query ends."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def merge_sink(changed: DataFrame, apply, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to apply(rows, batch_id), such as an upsert of postings or a repair of passages.

    A batch may come again after a failure, so apply must be idempotent: replacing rows of the changed ids is.
    """
    writer = changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Retries:
    """The rows of batches that failed, in a folder, until they work: each with its attempts and when it is due again.

    A batch is known by its number. What it holds is written once, before its state, and its state is one small file, so a batch
    that comes again after a crash finds what was done: one that worked isn't applied a second time.
    """

    def __init__(self, spark: SparkSession, path: str, wait: float = 0.0, most: int = 5, now: Callable[[], float] = time.time):
        self.spark, self.path, self.wait, self.most, self.now = spark, path.rstrip("/"), wait, most, now
        self._folder = Folder(spark, path)

    def state(self, number: int) -> dict:
        return self._folder.read(f"state/{number:012d}.json") or {"attempts": 0, "done": False, "due": 0.0}

    def known(self) -> dict[int, dict]:
        return {int(n.removesuffix(".json")): self.state(int(n.removesuffix(".json"))) for n in self._folder.names("state") if n.endswith(".json") and not n.startswith(".")}

    def due(self) -> list[int]:
        """Numbers of the batches that failed, may be tried again, and are due, the oldest first."""
        return [k for k, s in sorted(self.known().items()) if not s["done"] and s["attempts"] < self.most and s["due"] <= self.now()]

    def rows(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/{number:012d}")

    def succeeded(self, number: int) -> None:
        self._folder.write(f"state/{number:012d}.json", self.state(number) | {"done": True}, overwrite=True)
        self._folder.delete(f"rows/{number:012d}")

    def failed(self, number: int, rows: DataFrame | None = None) -> None:
        """Notes a failure; each makes the wait until the next attempt twice as long. rows: what the batch holds, when it fails for the first time."""
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/{number:012d}")
        attempts = self.state(number)["attempts"] + 1
        self._folder.write(f"state/{number:012d}.json", {"attempts": attempts, "done": False, "due": self.now() + self.wait * 2 ** (attempts - 1)}, overwrite=True)


def budgeted_run(changed: DataFrame, apply, checkpoint: str, seconds: float = 900, rows: int = 30_000, failures: int = 5, retries: Retries | None = None) -> dict:
    """Handles what there is in micro-batches until time or rows are used up or apply(rows, batch_id) fails so often in a row; reports what was done.

    apply says whether its batch worked; an exception ends the run, and the batch comes again. What earlier runs failed at and is due comes first. A batch that
    fails is kept with its rows (retries, beside the checkpoint by default) and the stream goes on, so its rows come again in a later run; one that worked
    isn't applied again. The run stops between batches, so the next one goes on where it ended.
    """
    report = {"batches": 0, "rows": 0, "failed": 0, "retried": 0, "recovered": 0, "truncated": False, "unreachable": False}
    state = {"row": 0, "end": time.monotonic() + seconds}
    kept = retries or Retries(changed.sparkSession, f"{checkpoint.rstrip('/')}-retries")
    spent = lambda: report["unreachable"] or report["rows"] >= rows or time.monotonic() > state["end"]

    def tried(batch: DataFrame, number: int, again: bool) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)  # counted, applied, and kept if it fails: read once
        try:
            report["rows"] += held.count()
            done = bool(apply(held, number))
            if done:
                kept.succeeded(number)
            else:
                kept.failed(number, None if again else held)
        finally:
            held.unpersist()
        report["batches"] += 1
        report["retried"] += again
        report["recovered"] += again and done
        report["failed"] += not done
        state["row"] = 0 if done else state["row"] + 1
        report["unreachable"] = state["row"] >= failures

    for number in kept.due():
        if spent():
            report["truncated"] = True
            return report
        tried(kept.rows(number), number, True)

    def step(batch: DataFrame, number: int) -> None:
        before = kept.state(number)
        if before["done"] or before["attempts"]:
            return  # applied, or kept for later, before the checkpoint knew of it
        if spent():
            report["truncated"] = True
            raise _BudgetSpent
        tried(batch, number, False)

    query = merge_sink(changed, step, checkpoint)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not report["truncated"]:
            raise
    return report


class _BudgetSpent(Exception):
    pass


def refreshed_postings(posts: DataFrame, changed: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Postings with those of changed passages replaced."""
    return posts.join(changed.select(*ids).distinct(), list(ids), "left_anti").unionByName(changed)


def index_sink(changed: DataFrame, index: Segments, build: Callable[[DataFrame], DataFrame], checkpoint: str, ids: str = "id", name: str = "index", every: str | None = None) -> StreamingQuery:
    """Keeps a versioned index up with changed passages: each micro-batch replaces the rows of its ids by what build makes of them.

    A passage without words leaves the index. A micro-batch that comes again changes nothing, as the index knows its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            index.replace(build(held), held.select(F.col(ids).alias(index.key)), (name, number))
        finally:
            held.unpersist()

    return merge_sink(changed, apply, checkpoint, every)
