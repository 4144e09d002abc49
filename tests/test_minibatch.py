"""Mini-batch training on Spark against the same steps in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import minibatch as B

SIZE, LENGTH, BATCHES = 3, 5, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, LENGTH))
    y = (x @ rng.normal(size=(LENGTH, SIZE)) + np.array([-1.5, 0.0, 0.5]) > 0).astype(float)
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, labels array<double>").repartition(5)
    return frame.where("id % 5 <> 0"), frame.where("id % 5 = 0")


def plain(spark, own, held, epochs, patience=2):
    """The steps as they are described, sample by sample."""
    rows = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(BATCHES))).collect()
    labels = np.array([r["labels"] for r in rows])
    rare = np.maximum(1.0, (1 - labels).sum(0) / labels.sum(0))
    w, memory, losses, told, best, kept = np.zeros((SIZE, LENGTH + 1)), np.zeros((SIZE, LENGTH + 1)), [], [], np.inf, None
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for epoch in range(epochs):
        lost = seen = 0.0
        for b in B.turn(epoch, BATCHES):
            part, g = [r for r in rows if r["b"] == b], np.zeros_like(w)
            for r in part:
                v = np.array([*r["vector"], 1.0])
                for t in range(SIZE):
                    p, y = sigmoid(w[t] @ v), r["labels"][t]
                    weight = rare[t] if y else 1.0
                    lost -= weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
                    seen += weight
                    g[t] += (p - y) * weight * v
            g /= len(part)
            g[:, :-1] += 1e-5 * w[:, :-1]
            memory += g**2
            w = w - 0.35 * g / (np.sqrt(memory) + 1e-8)
        losses.append(lost / seen)
        apart = [(np.array([*r["vector"], 1.0]), np.array(r["labels"])) for r in held.collect()]
        told.append(float(np.mean([-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) for v, y in apart for p in [sigmoid(w @ v)]])))
        if told[-1] < best:
            best, kept = told[-1], w.copy()
        elif epoch - int(np.argmin(told)) >= patience:
            break
    return kept, losses, told


def test_steps_are_those_of_numpy(spark, data):
    own, held = data
    got = B.trained(own, held, SIZE, LENGTH, BATCHES, epochs=3)
    weights, losses, told = plain(spark, own, held, 3)
    assert np.allclose(got.weights, weights, atol=1e-9) and np.allclose(got.losses, losses) and np.allclose(got.held_losses, told)
    assert got.losses[-1] < got.losses[0] and got.held_losses[-1] < got.held_losses[0]
    one = B.trained(own.coalesce(1), held.coalesce(1), SIZE, LENGTH, BATCHES, epochs=3)
    assert np.allclose(one.weights, got.weights, atol=1e-6)  # however samples are dealt over tasks
    scored = held.select("labels", F.array(*got.scores(F.col("vector"))).alias("p")).collect()
    right = np.mean([(np.array(r["p"]) >= 0.5) == (np.array(r["labels"]) == 1) for r in scored])
    assert right > 0.85


def test_training_ends_when_the_held_out_loss_rises(spark, data):
    own, held = data
    turned = held.withColumn("labels", F.transform("labels", lambda y: 1 - y))
    got = B.trained(own, turned, SIZE, LENGTH, 2, epochs=9, patience=1)
    assert len(got.held_losses) == 2 < 9
    assert np.argmin(got.held_losses) == 0


def test_odd_samples_take_no_part(spark, data):
    own, held = data
    odd = [(1000, None, [1.0, 0.0, 0.0]), (1001, [1.0] * 4, [1.0, 0.0, 0.0]), (1002, [1.0, None, 1.0, 1.0, 1.0], [1.0, 0.0, 0.0]), (1003, [float("nan")] * 5, [1.0, 0.0, 0.0]), (1004, [1.0] * 5, None), (None, [0.0] * 5, [0.0, 0.0, 0.0])]
    more = spark.createDataFrame(odd[:5], own.schema)
    a = B.trained(own.unionByName(more), held, SIZE, LENGTH, 2, epochs=1)
    b = B.trained(own, held, SIZE, LENGTH, 2, epochs=1)
    assert np.allclose(a.weights, b.weights)
    none = B.trained(own.limit(0), held.limit(0), SIZE, LENGTH, 2, epochs=1)
    assert not none.weights.any() and none.held_losses == []
    assert B.positive_weights(spark.createDataFrame(odd[5:], own.schema), SIZE).tolist() == [1.0, 1.0, 1.0]


def test_the_query_scores_held_out_rows_only(spark):
    from lectern.operators import ml
    from lectern.plans.ranked import theme_model_held_out

    sf = "/root/testdata/sf0.001"
    got = theme_model_held_out(spark, sf).collect()
    apart = ml.held_out(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id").where("held_out").collect()
    assert {r["id"] for r in got} == {r["vec_id"] for r in apart} and 0 < len(got) < 250
    # the fixture's labels have nothing to do with its vectors, so only the form of the scores is held here
    scores = [[r[f"score_{c}"] for c in "012"] for r in got]
    assert all(0 <= x <= 1 for s in scores for x in s) and all(r["best"] in "012" and r[f"score_{r['best']}"] == max(s) for r, s in zip(got, scores, strict=True))
