"""Mixing sources to target weights by Pfair scheduling.

A source of weight w has had w * v blocks by virtual time v, until it has no more; slot T(v) is the sum over all sources, so that
a source that is used up leaves and the others' weights are renormalised. Block j (from 0) is released in slot floor(T(j / w))
and due by slot ceil(T((j + 1) / w)). Earliest deadline first then serves one block a slot, and at every slot each source has had
its share within less than a block. Weights are taken as they are, as exact integer ratios. What a source has been served tells
how the schedule goes on, so the driver notes that every STRIDE slots, and tasks replay the slots in between.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ranked_by_hash, unused

#: Slots that one task replays at a time, at least.
STRIDE = 1 << 16


def _by_name(source: str | None) -> tuple[bool, str]:
    return source is not None, source or ""


class Schedule:
    """Sources of positive weight in `names`, each with a number of blocks; `total` slots hold them all."""

    def __init__(self, weights: Mapping[str | None, float], blocks: Mapping[str | None, int]):
        self.names = sorted((s for s, w in weights.items() if w and w > 0), key=_by_name)
        exact = [Fraction(weights[s]) for s in self.names]
        scale = lcm(*(w.denominator for w in exact))
        self.weight = [int(w * scale) for w in exact]
        self.blocks = [blocks.get(s, 0) for s in self.names]
        self.total = sum(self.blocks)
        # in the order in which sources are used up: when, the blocks of those that are, and the weight of the others
        order = sorted(range(len(self.names)), key=lambda i: self.blocks[i] / self.weight[i])
        self.ends = [self.blocks[i] / self.weight[i] for i in order]
        self.gone = list(accumulate((self.blocks[i] for i in order), initial=0))
        self.left = list(accumulate((-self.weight[i] for i in order), initial=sum(self.weight)))

    def window(self, i: int, j: int) -> tuple[int, int]:
        """The slots in which block j of source i is released, and by which it is due."""
        w = self.weight[i]
        a, b = bisect_right(self.ends, j / w), bisect_right(self.ends, (j + 1) / w)
        return self.gone[a] + j * self.left[a] // w, self.gone[b] - (-(j + 1) * self.left[b] // w)

    def replay(self, start: int, stop: int, served: list[int]) -> list[int]:
        """The source that each slot serves, earliest deadline first among released blocks; `served`, the blocks that each has had before, is brought up to date."""
        waiting = [(*self.window(i, n), i) for i, n in enumerate(served) if n < self.blocks[i]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int]] = []
        out = []
        for slot in range(start, stop):
            while waiting and (waiting[0][0] <= slot or not ready):
                _, due, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, i))
            _, i = heapq.heappop(ready)
            out.append(i)
            served[i] += 1
            if served[i] < self.blocks[i]:
                heapq.heappush(waiting, (*self.window(i, served[i]), i))
        return out

    def starts(self, stride: int = STRIDE) -> Iterator[tuple[int, int, bytes]]:
        """Slots from and to, and what each source has been served before, for the whole schedule."""
        stride, served = max(stride, 64 * len(self.names)), [0] * len(self.names)
        for start in range(0, self.total, stride):
            stop = min(start + stride, self.total)
            yield start, stop, np.array(served, np.int64).tobytes()
            if stop < self.total:
                self.replay(start, stop, served)

    def kept_until(self, full: Mapping[str | None, int]) -> int:
        """The first slot that a source with so many full blocks can't fill any more at its weight."""
        return min((full.get(s, 0) * self.left[0] // w for s, w in zip(self.names, self.weight)), default=0)


def tempered(docs: DataFrame, power: float = 0.9, source_col: str = "source") -> dict[str | None, float]:
    """Target weights: each source's share of rows to a power, which evens out sources a little."""
    rows = docs.groupBy(source_col).count().collect()  # a row for each source
    return {r[0]: r[1] ** power for r in rows}


def mixed(docs: DataFrame, weights: Mapping[str | None, float], block_rows: int = 1, id_col: str = "doc_id", source_col: str = "source", stride: int = STRIDE) -> DataFrame:
    """The rows of docs with mix_block (number of the row's block in its source), mix_slot, mix_position and in_mix.

    Sources are read in an order by hash of the id. Sorting by mix_position interleaves them: at every slot each source that has
    blocks left is served by weight within less than a block; one that is used up leaves, and the others' weights are renormalised.
    in_mix holds until the first slot that a source can't fill any more: so far these are the weights given. Rows of sources
    without a positive weight stay, with null slots and in_mix false; a null source is a source like others. Equal ids of one
    source follow each other. Columns of docs named like an added one are replaced; an empty table gives no rows.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(source_col).count().collect()}  # a row for each source
    plan = Schedule(weights, {s: -(-n // block_rows) for s, n in counts.items()})
    end = plan.kept_until({s: n // block_rows for s, n in counts.items()})

    added = ["mix_block", "mix_slot", "mix_position", "in_mix"]
    kept = docs.drop(*added)
    hash_, rank, name, number, source, block, slot = unused([*kept.columns, *added], "h", "rank", "name", "number", "i", "j", "slot")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before = np.frombuffer(row["served"], np.int64)
                own = np.array(plan.replay(row["start"], row["stop"], before.tolist()), np.int64)
                order = np.argsort(own, kind="stable")
                n = np.bincount(own, minlength=len(before))
                at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - before, n)
                yield pa.RecordBatch.from_arrays([pa.array(own[order].astype(np.int32)), pa.array(at), pa.array(row["start"] + order)], names=[source, block, slot])

    spark = docs.sparkSession
    placed = spark.createDataFrame(list(plan.starts(stride)), "start long, stop long, served binary").mapInArrow(slots, f"{source} int, {block} long, {slot} long")
    numbered = ranked_by_hash(kept.withColumn(hash_, F.xxhash64(F.lit("mix"), id_col)), [source_col], hash_, rank, [id_col])
    numbers = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(plan.names)], f"{name} string, {number} int"))
    known = numbered.join(numbers, F.col(source_col).eqNullSafe(F.col(name)), "left").withColumn("mix_block", F.floor(F.col(rank) / block_rows))
    known = known.join(placed, (F.col(number) == F.col(source)) & (F.col("mix_block") == F.col(block)), "left").withColumn("mix_slot", F.col(slot))
    position = F.col("mix_slot") * block_rows + F.col(rank) % block_rows
    in_mix = F.coalesce(F.col("mix_slot") < end, F.lit(False))
    return known.withColumns({"mix_position": position, "in_mix": in_mix}).select(*kept.columns, *added)
