"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted, with that order, in the inverted files of its
POSTED nearest pivots; a query asks the files of its own nearest ones, ranks what it meets there by the footrule
distance of the two truncated orders, and reranks what is near enough by the inner product. So what moves are postings
and the queries that ask for them, never all pairs; large files and popular pivots are dealt over several tasks.

How many pivots there are, how many files a query asks and how near is near enough is measured: for PROBES queries,
chosen by hash, the true neighbours are found by comparing with every vector, and the index is made so that it meets
COVER of them, and keeps COVER of those. A query that meets fewer than k vectors is answered by comparing with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import written

#: Pivots: ROOT times the root of the number of vectors at first, within these bounds, drawn from at most SAMPLE vectors.
ROOT, LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 4, 64, 4096, 16384
#: Files that hold a vector; places kept of an order, which are also the most files that a query asks.
POSTED, PLACES = 8, 64
#: Queries that measure the index, and the share of their neighbours that each of its two steps has to keep.
PROBES, COVER = 64, 0.98
#: Vectors and queries of one file that a task handles together.
FILE_ROWS, FILE_QUERIES = 4096, 8192
#: Queries that one comparison with all vectors answers.
BLOCK_QUERIES = 1024

_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, bound: float) -> np.ndarray:
    """Vectors of one length: a component more takes up what is less than the bound, so the largest product is the nearest."""
    rest = np.sqrt(np.maximum(bound * bound - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def _orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Per vector its nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :places].astype(np.int32)


def _vector_orders(x: np.ndarray, pivots: np.ndarray, bound: float, places: int) -> np.ndarray:
    return _orders(_lifted(x, bound), pivots, places)


def _query_orders(q: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    return _orders(np.column_stack([q, np.zeros(len(q))]), pivots, places)


def _savings(asked: np.ndarray, pivots: int, places: int) -> np.ndarray:
    """Per pivot what a match with it may save of the footrule distance; 0 where the query's order doesn't have it."""
    out = np.zeros(pivots, np.int32)
    out[asked] = places - np.arange(len(asked))
    return out


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, x, rank): the best k of rows (id, x) for each of a few queries, by comparing with all in one pass."""
    names = np.array([r["id"] for r in queries], np.int64)
    asked = np.array([r["x"] for r in queries], np.float64).reshape(len(queries), dim)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)))] * len(names)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("x"), dim)
                near = x @ asked.T
                for i, name in enumerate(names):
                    near[ids == name, i] = -np.inf
                    some = np.argpartition(-near[:, i], min(2 * k, len(ids) - 1))[: 2 * k]
                    edge = np.flatnonzero(near[:, i] >= near[some, i].min() - 1e-9)  # ties are ranked by id
                    edge = edge[ids[edge] != name]
                    a, b, c = held[i]
                    a, b = np.concatenate([a, ids[edge]]), np.concatenate([b, (x[edge] * asked[i]).sum(axis=1)])
                    c, best = np.concatenate([c, x[edge]]), _best(a, b, k)
                    held[i] = a[best], b[best], c[best]
        for i, (a, b, c) in enumerate(held):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), names[i])), pa.array(a), pa.array(b), pa.array(list(c), pa.list_(pa.float64()))], names=["query_id", "vec_id", "score", "x"])

    return _first(rows.mapInArrow(compare, f"{_FOUND}, x array<double>"), k)


def _measured(pivots: np.ndarray, bound: float, queries: list, near: list, dim: int) -> tuple[np.ndarray, int, int]:
    """The pivots, the files that a query asks and the least saving, so that COVER of the sample's neighbours are met and kept."""
    while True:
        places = min(PLACES, len(pivots))
        posted = min(POSTED, places)
        asked = {r["id"]: _savings(o, len(pivots), places) for r, o in zip(queries, _query_orders(np.array([r["x"] for r in queries], np.float64).reshape(-1, dim), pivots, places), strict=True)}
        orders = _vector_orders(np.array([r["x"] for r in near], np.float64).reshape(-1, dim), pivots, bound, places)
        own = np.array([asked[r["query_id"]][o] for r, o in zip(near, orders, strict=True)], np.int32).reshape(-1, places)
        if not len(own):
            return pivots, places, 0
        met = np.sort(places - own[:, :posted].max(axis=1))  # the place of the first file that has it; `places` for none
        probes = int(met[int(np.ceil(COVER * len(met))) - 1]) + 1
        if probes <= places or len(pivots) <= LEAST_PIVOTS:
            saved = np.sort(np.minimum(own, places - np.arange(places)).sum(axis=1))
            return pivots, min(probes, places), int(saved[int((1 - COVER) * len(saved))])
        pivots = pivots[: max(LEAST_PIVOTS, len(pivots) // 2)]


def _searching(sent: Broadcast, bound: float, probes: int, least: int, k: int, dim: int):
    def search(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        pivots, pivot = sent.value, key[0].as_py()
        places = min(PLACES, len(pivots))
        posted, saving = min(POSTED, places), places - np.arange(places, dtype=np.int32)
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            ids, x = a.column("id").to_numpy(), _matrix(a.column("x"), dim)
            orders = np.frombuffer(b"".join(a.column("places").to_pylist()), np.uint16).reshape(-1, places)
            wanted, q = b.column("id").to_numpy(), _matrix(b.column("x"), dim)
            for i, asked in enumerate(_query_orders(q, pivots, places)):
                save = _savings(asked, len(pivots), places)
                # a vector is ranked in the first file of the query that has it
                here = np.flatnonzero(save[orders[:, :posted]].max(axis=1) == save[pivot])
                near = np.minimum(save[orders[here]], saving).sum(axis=1)
                some = here[(near >= least) & (ids[here] != wanted[i])]
                score = (x[some] * q[i]).sum(axis=1)
                best = _best(ids[some], score, k)
                out.append((np.full(len(best), wanted[i]), ids[some][best], score[best]))
        found = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return search


def _sound(dim: int) -> Column:
    return (F.size("x") == dim) & F.col("id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k nearest: query_id, rank (from 1), vec_id, score; largest inner product first, then the smaller id.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows with a null id. The query's own id isn't a candidate; repeated vectors are candidates each, of repeated queries one stays.
    Where there are no more than k candidates, all are found. Other columns are left out; empty tables give no rows.
    All rows are indexed; pivots come from a sample of SAMPLE rows by hash.
    """
    spark = vectors.sparkSession
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    schema = "query_id long, rank int, vec_id long, score double"
    kind = vectors.schema[vector_col].dataType.simpleString()
    lengths = named(vectors).where("x is not null and size(x) > 0").groupBy(F.size("x").alias("n")).count()
    mode = lengths.orderBy(F.desc("count"), "n").first()
    if mode is None:
        return spark.createDataFrame([], schema)
    dim = mode["n"]
    rows, asked = named(vectors).where(_sound(dim)), written(named(queries).where(_sound(dim)).groupBy("id").agg(F.min("x").alias("x")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("bound")).first()
    if not known["n"]:
        return spark.createDataFrame([], schema)
    bound = known["bound"]
    by_hash = lambda name: (F.xxhash64(F.lit(name), "id"), "id", "x")
    some = rows.orderBy(*by_hash("pivot")).limit(SAMPLE).select("x").toPandas()["x"]
    sample = _lifted(np.unique(np.stack(some.to_list()).astype(np.float64), axis=0), bound)
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, int(ROOT * known["n"] ** 0.5)))
    pivots = sample[np.random.default_rng(7).permutation(len(sample))[:wanted]]
    probing = asked.orderBy(*by_hash("probe")).limit(PROBES).collect()
    near = exact(rows, probing, dim, k).collect() if probing else []  # PROBES times k rows
    pivots, probes, least = _measured(pivots, bound, probing, near, dim)
    places = min(PLACES, len(pivots))
    sent = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                orders = _vector_orders(_matrix(part.column("x"), dim), sent.value, bound, places)
                first = pa.array(list(orders[:, :POSTED]), pa.list_(pa.int32()))
                whole = pa.array([o.tobytes() for o in orders.astype(np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), first, whole], names=["id", "x", "pivots", "places"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                orders = _query_orders(_matrix(part.column("x"), dim), sent.value, probes)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.array(list(orders), pa.list_(pa.int32()))], names=["id", "x", "pivots"])

    posts = written(rows.mapInArrow(post, f"id long, x {kind}, pivots array<int>, places binary"))
    asks = written(asked.mapInArrow(ask, f"id long, x {kind}, pivots array<int>"))
    filed = lambda df: df.withColumn("pivot", F.explode("pivots")).drop("pivots")
    size = lambda df, n, out: filed(df.select("pivots")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(out))
    files = F.broadcast(size(posts, FILE_ROWS, "parts").join(size(asks, FILE_QUERIES, "groups"), "pivot"))  # a row for each pivot
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.col(n)).cast("int")
    left = filed(posts).join(files, "pivot").withColumn("part", dealt("parts")).withColumn("group", every("groups")).drop("parts", "groups")
    right = filed(asks).join(files, "pivot").withColumn("group", dealt("groups")).withColumn("part", every("parts")).drop("parts", "groups")
    key = ("pivot", "part", "group")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searching(sent, bound, probes, least, k, dim), _FOUND)
    found = written(_first(met, k))

    short = asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left")
    short = written(short.where(F.coalesce("n", F.lit(0)) < k).select("id", "x"))
    missing, whole = short.count(), found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    blocks = -(-missing // BLOCK_QUERIES)
    for b in range(blocks):
        block = short.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b).collect()  # some BLOCK_QUERIES
        if block:
            whole = whole.unionByName(exact(rows, block, dim, k).drop("x"))
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
