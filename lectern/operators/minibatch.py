"""Logistic models of several labels, trained together by mini-batches of adaptive gradient steps.

Samples are dealt into batches by a hash of their ids and stored by batch, so a step reads its own batch only. Every task adds up the
gradients of its samples into one matrix, matrices are added as a tree, and the driver holds the weights: as many numbers as labels
times components. Batches come in another order each epoch. Training ends when the loss on held-out samples no longer falls.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import discard, written

_TINY, _STEADY = 1e-9, 1e-8


@dataclass
class Trained:
    """weights: a row a label, the last column its bias. losses and held_losses: by epoch."""

    weights: np.ndarray
    positive: np.ndarray
    losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)

    def scores(self, vector: Column) -> list[Column]:
        """Each label's probability, as columns."""
        out = []
        for w in self.weights.tolist():
            given = F.array(*map(F.lit, w[:-1]))
            z = F.aggregate(F.zip_with(vector, given, lambda a, b: a * b), F.lit(w[-1]), lambda a, b: a + b)
            out.append(1 / (1 + F.exp(-z)))
        return out


def positive_weights(samples: DataFrame, size: int) -> np.ndarray:
    """By label, how many negatives there are for each positive, 1 at least; 1 for a label without positives."""
    counted = samples.select(F.posexplode("labels").alias("i", "y")).groupBy("i").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    out = np.ones(size)
    for r in counted.collect():  # a row a label
        out[r["i"]] = max(1.0, (r["n"] - r["p"]) / r["p"]) if r["p"] else 1.0
    return out


def gradients(vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Sums over some samples: errors times components (and 1 for the bias), the weighted loss, and the weights that were counted."""
    whole = np.hstack([vectors, np.ones((len(vectors), 1))])
    p = 1 / (1 + np.exp(-np.clip(whole @ weights.T, -500, 500)))
    w = np.where(labels > 0, positive, 1.0)
    loss = -w * (labels * np.log(p + _TINY) + (1 - labels) * np.log(1 - p + _TINY))
    return ((p - labels) * w).T @ whole, float(loss.sum()), float(w.sum())


def _summed(samples: DataFrame, weights: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float, float, int]:
    """gradients() of all samples, and how many there are."""
    shape = weights.shape
    sent = samples.sparkSession.sparkContext.broadcast((weights, positive))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights_size + 3)
        own, rare = sent.value
        for batch in batches:
            n = batch.num_rows
            if n:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("vector", "labels"))
                g, loss, seen = gradients(x, y, own, rare)
                total += np.concatenate([g.ravel(), [loss, seen, n]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    weights_size = weights.size
    parts = samples.select("vector", "labels").mapInArrow(add, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"], np.float64))
    total = parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(weights.size + 3)
    sent.destroy()
    return total[: weights.size].reshape(shape), float(total[-3]), float(total[-2]), int(total[-1])


def stepped(weights: np.ndarray, memory: np.ndarray, gradient: np.ndarray, size: int, rate: float, l2: float) -> None:
    """One adaptive step in place: the mean gradient, with a pull to zero for all but the bias, by the root of the squares so far."""
    g = gradient / size
    g[:, :-1] += l2 * weights[:, :-1]
    memory += g * g
    weights -= rate * g / (np.sqrt(memory) + _STEADY)


def turn(epoch: int, batches: int) -> list[int]:
    """The order of the batches in an epoch."""
    return sorted(range(batches), key=lambda b: hashlib.md5(f"{epoch}:{b}".encode()).hexdigest())


def trained(samples: DataFrame, held: DataFrame, size: int, length: int, batches: int = 16, epochs: int = 12, rate: float = 0.35, l2: float = 1e-5, patience: int = 2) -> Trained:
    """A model of `size` labels over vectors of `length` components, from samples (id, vector, labels) and held-out ones.

    Labels are 1 or 0. Samples with a null or another length, or with a null, infinite or missing component, take no part; repeated ones count as often as they
    come. The weights with the least loss on held-out samples are kept; without such samples all epochs run. Without samples weights are zero.
    """
    able = lambda df: df.where((F.size("vector") == length) & (F.size("labels") == size) & F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < math.inf)) & F.forall("labels", lambda v: v.isNotNull()))
    plain = lambda df: able(df).select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("labels").cast("array<double>").alias("labels"))
    own = written(plain(samples).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), by=["batch"])
    apart = written(plain(held))
    model = Trained(np.zeros((size, length + 1)), positive_weights(own, size))
    weights, memory, best = model.weights.copy(), np.zeros_like(model.weights), math.inf
    even = np.ones(size)
    for epoch in range(epochs):
        lost = seen = 0.0
        for b in turn(epoch, batches):
            g, loss, weight, n = _summed(own.where(F.col("batch") == b), weights, model.positive)
            if n:
                stepped(weights, memory, g, n, rate, l2)
                lost, seen = lost + loss, seen + weight
        model.losses.append(lost / max(1.0, seen))
        _, loss, weight, n = _summed(apart, weights, even)
        if not n:
            model.weights = weights.copy()
            continue
        model.held_losses.append(loss / weight)
        if model.held_losses[-1] < best - 1e-9:
            best, model.weights = model.held_losses[-1], weights.copy()
        elif len(model.held_losses) - 1 - int(np.argmin(model.held_losses)) >= patience:
            break
    discard(own, apart)
    return model


def one_hot(label: Column, labels: Sequence[str]) -> Column:
    """A label as an array with 1 at its place in labels."""
    return F.array(*((label.cast("string") == c).cast("double") for c in labels))
