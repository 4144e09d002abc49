"""Chat formatting of reply trees.

Messages point to their parents. Iterative self-joins double the pointers, which gives each leaf its depth and the sum of
scores on its path; the best leaves of each conversation are chosen, and the same pointers, from the longest down,
enumerate their paths. Each path becomes one conversation under a template whose control strings are escaped in texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import discard, together, written

#: Control strings: a turn of the assistant stands between the first two, any other between the next two, after its role.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.DOTALL)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """Backslashes double, and one goes after the first character of a control string, so none is left whole."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def _restored(text: str) -> str:
    """escape() undone: what follows a backslash is a backslash, or the rest of a control string."""
    return text.replace("\\\\", "\0\0").replace("\\", "").replace("\0\0", "\\") if "\0" not in text else _slow_restored(text)


def _slow_restored(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans (in code points) that are under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        if role == ASSISTANT:
            before, body, after = OPEN, escape(text), CLOSE
            spans.append((at + len(before), at + len(before) + len(body)))
        else:
            before, body, after = f"{ASK}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), ASKED
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns, read back from formatted()'s string."""
    return [(ASSISTANT, _restored(m[1])) if m[1] is not None else (unescape(m[2]), _restored(m[3])) for m in _TURN.finditer(text)]


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers over 1, 2, 4, ... parents (conv, node, to), and per node whose path ends at a root (conv, node, depth, total).

    A parent that isn't there makes a root. Nodes on cycles, or that lead to one, have no root and are left out.
    """
    keys = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    columns = ["conv", "node", "to", "depth", "total"]
    state = written(nodes.join(keys, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("there"), F.col("parent")).alias("to"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")))
    states, left = [state], max(1, math.ceil(math.log2(max(2, state.count()))) + 1)
    while left and not (active := states[-1].where("to is not null")).isEmpty():
        # nodes that have met their root only answer; so rounds handle the nodes that are deeper than they reach
        told = states[-1] if len(states) == 1 else together(*states[:-1]).where("to is null").unionByName(states[-1])
        up = told.select("conv", F.col("node").alias("to"), F.col("to").alias("next"), F.col("depth").alias("d"), F.col("total").alias("s"))
        step = active.join(up, ["conv", "to"]).select("conv", "node", F.col("next").alias("to"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"))
        states.append(written(step.select(*columns)))
        left -= 1
    levels = [t.where("to is not null").select("conv", "node", "to") for t in states[:-1]]
    return levels, together(*states).where("to is null").select("conv", "node", "depth", "total")


def _few(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few conversations, so that a task holds no more as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def conversations(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Each chosen path as conv, leaf, rank (from 1), score (mean on the path), turns (array of role and text), formatted and mask.

    messages: conv, node (unique in conv), parent (null for a root), role, text, score. Branches rank by the mean score of their
    path, then depth, the deeper first, then the smaller leaf. Null roles and texts are empty, null scores 0; rows
    with a null conv are one conversation, rows with a null node are left out; of rows with one conv and node the least stays, by parent (null first), role, text and
    score. Other columns are left out; an empty table gives no rows. A path is one row, so it has to fit in one task.
    """
    kept = messages.where("node is not null")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    # a struct equals another of null, so joins on it keep the conversation without an id
    rows = kept.select(F.struct("conv").alias("conv"), "node", "parent", empty("role"), empty("text"), F.col("score").cast("double").alias("score"))
    least = rows.groupBy("conv", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    nodes = written(least.select("conv", "node", "m.*"))
    levels, reach = jumps(nodes.select("conv", "node", "parent", "score"))
    leaves = reach.join(nodes.select("conv", F.col("parent").alias("node")).where("node is not null").distinct(), ["conv", "node"], "left_anti")
    leaves = leaves.withColumn("mean", F.col("total") / F.col("depth"))
    order = Window.partitionBy("conv").orderBy(F.desc("mean"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)
    steps = chosen.select("conv", F.col("node").alias("leaf"), "rank", F.col("mean").alias("score"), "node", F.lit(0).alias("up"))
    # each level is written: one plan of all would have a join for each, and the driver plans what is left of it anew after every stage
    used = []
    for k in range(len(levels) - 1, -1, -1):
        jump = steps.join(levels[k], ["conv", "node"], "left")
        both = F.when(F.col("to").isNull(), F.array(F.struct("node", "up"))).otherwise(F.array(F.struct("node", "up"), F.struct(F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
        steps = written(jump.select("conv", "leaf", "rank", "score", F.explode(both).alias("s")).select("conv", "leaf", "rank", "score", "s.node", "s.up"))
        discard(*used)
        used = [steps]
    if levels:
        discard(reach)
    told = steps.join(nodes.select("conv", "node", "role", "text"), ["conv", "node"])
    whole = told.groupBy("conv", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    whole = whole.withColumns({"conv": F.col("conv.conv"), "turns": F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))})

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for part in _few(batches):
            done = [formatted([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
            mask = pa.array([[{"lo": a, "hi": b} for a, b in spans] for _, spans in done], span)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t, _ in done], pa.string()), mask], names=[*part.schema.names, "formatted", "mask"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return whole.mapInArrow(put, f"{kinds}, formatted string, mask array<struct<lo:bigint,hi:bigint>>")


def read_back(chats: DataFrame) -> DataFrame:
    """Per formatted conversation: conv, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the string and its mask.

    Rows stay rows, repeated ones too; other columns are left out; an empty table gives no rows. formatted and mask are never null,
    as conversations() makes them; empty texts and roles are turns like others.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = parsed(text)
                loss = "".join(_restored(text[m["lo"] : m["hi"]]) for m in mask)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, sha, chars, loss_sha, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv"].dataType.simpleString()
    return chats.select("conv", "formatted", "mask").mapInArrow(read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) as messages that each reply to the one before, by turn, then role and text.

    Null turns, roles and texts come first; rows with a null conv are one conversation. Repeated
    rows are turns of their own; other columns are left out; an empty table gives no rows.
    """
    by = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(by).cast("long")).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
