"""Nearest neighbours by inner product: a block matrix join in int8 with error bounds.

Queries are taken in waves of a fixed number of vectors, which bounds what is
broadcast; candidates are read where they lie, in tiles.  Both are quantised
to int8 with a scale for each vector.  The product of two int8 tiles is exact
in float32 up to BLAS_EXACT dimensions at a time, and with the quantisation
residuals it bounds the true inner product from both sides:

    |x.y - sx*sy*(qx.qy)| <= |rx|*|y| + |sx*qx|*|ry|,   rx = x - sx*qx

A pair survives if its upper bound reaches the k-th best lower bound that its
query has so far; survivors are recomputed in double precision and go to a heap
for each query and task.  The heaps of all tasks are merged by query: a task
sends k rows for each query at most.

Defined results: null and zero vectors and vectors with null or non-finite
components take no part; every other vector does, however large or small (a
pair whose bounds can't be told is computed; one whose product overflows both
ways has no order and is left out); a vector's own id is no candidate of its query; ties
go to the smaller id; of a query's several vectors the smallest is asked; repeated candidate rows count once for each distinct
vector of an id; vectors of another length than the query are no candidates;
empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

NEAREST = 20
WAVE = 4096
TILE = 2048
BLAS_EXACT = 1024
MERGE_FAN = 64


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows as float32, scale, norm of what is lost, norm of what is kept) of rows of doubles."""
    most = np.abs(x).max(axis=1, keepdims=True)
    # By a power of two, which is exact: rows of extreme size are quantised as rows between 0.5 and 1.
    power = np.frexp(most)[1]
    near = np.ldexp(x, -power)
    step = np.ldexp(most, -power) / 127.0
    q = np.rint(near / step)
    kept = step * q
    with np.errstate(over="ignore"):
        back = lambda v: np.ldexp(v, power[:, 0])
        return q.astype(np.int8), back(step[:, 0]), back(np.linalg.norm(near - kept, axis=1)), back(np.linalg.norm(kept, axis=1))


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows of any size."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    with np.errstate(over="ignore"):
        return np.ldexp(np.linalg.norm(np.ldexp(x, -power[:, None]), axis=1), power)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 rows times int8 rows, exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], BLAS_EXACT):
        out += a[:, at : at + BLAS_EXACT].astype(np.float32) @ b[:, at : at + BLAS_EXACT].astype(np.float32).T
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


class Nearest:
    """The best so far of each query: a heap of (score, -id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.q, self.scale, self.lost, self.kept = quantise(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.pairs = self.recomputed = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        q, scale, lost, kept = quantise(x)
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            about = tile_product(self.q, q) * self.scale[:, None] * scale
            error = self.lost[:, None] * norms(x) + self.kept[:, None] * lost
            error = error * (1 + 1e-9) + 1e-12 * np.abs(about) + np.finfo(float).tiny * (1 + q.shape[1])
            clear = np.isfinite(about) & np.isfinite(error)
            about, error = np.where(clear, about, 0.0), np.where(clear, error, np.inf)
        mine = self.ids[:, None] == ids
        low = np.where(mine, -np.inf, about - error)
        k = min(self.k, low.shape[1])
        # Repeated ids would count several times among the k best.
        alone = len(np.unique(ids)) == len(ids)
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if k == self.k and alone else np.full(len(low), -np.inf)
        have = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])
        alive = (about + error >= np.maximum(floor, have)[:, None]) & ~mine
        self.pairs += alive.size
        self.recomputed += int(alive.sum())
        for i in np.flatnonzero(alive.any(axis=1)):
            js = np.flatnonzero(alive[i])
            heap = self.heaps[i]
            for s, c in zip(exact(self.vectors[i], x[js]), ids[js].tolist()):
                if s != s:
                    continue
                if len(heap) < self.k:
                    if (s, -c) not in heap:
                        heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0] and (s, -c) not in heap:
                    heapq.heapreplace(heap, (s, -c))


def exact(query: np.ndarray, rows: np.ndarray) -> list[float]:
    """Inner products in double precision, each summed by itself in order of the components, whatever rows stand beside it."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return np.cumsum(rows * query, axis=1)[:, -1].tolist()


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", wave: int = WAVE, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other vectors."""
    spark = vectors.sparkSession
    pick = lambda df: df.filter(usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("i"), F.col(embedding).cast("array<double>").alias("v"))
    rows = pick(vectors)
    # Of several vectors of a query's id the smallest is asked, whatever the order of rows.
    asked = pick(queries).groupBy("i").agg(F.min("v").alias("v"))
    n = asked.count()
    waves = max(1, -(-n // wave))
    if waves > 1:
        asked = scratch.keep(asked.withColumn("w", F.pmod(F.xxhash64("i"), F.lit(waves))).repartition(waves, "w"), "queries")
    parts = None
    for w in range(waves if n else 0):
        mine = (asked.filter(F.col("w") == w).drop("w") if waves > 1 else asked).toPandas()  # about `wave` vectors
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, group in mine.groupby(mine["v"].map(len)):
            by_length[int(size)] = (group["i"].to_numpy(np.int64), np.stack(group["v"].to_numpy()).astype(float))
        sent = spark.sparkContext.broadcast(by_length)
        found = rows.mapInArrow(_searcher(sent, k, tile), "query_id long, found array<struct<score: double, vec_id: long>>")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))), order), 1, k).alias("found")
    # Two steps, so that no group holds the heaps of all tasks.
    some = parts.withColumn("s", F.spark_partition_id() % MERGE_FAN).groupBy("query_id", "s").agg(best)
    merged = some.groupBy("query_id").agg(best).withColumnRenamed("found", "best")
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _searcher(sent, k: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {size: Nearest(ids, v, k) for size, (ids, v) in sent.value.items()}
        waiting: dict[int, tuple[list[int], list[np.ndarray]]] = {s: ([], []) for s in states}

        def flush(size: int) -> None:
            ids, vs = waiting[size]
            if ids:
                states[size].add(np.array(ids, np.int64), np.concatenate(vs))
                ids.clear()
                vs.clear()

        for batch in batches:
            lists = batch.column("v")
            lengths = np.diff(np.asarray(lists.offsets))
            flat, ids = lists.flatten().to_numpy(zero_copy_only=False), batch.column("i").to_numpy()
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for size in np.unique(lengths):
                if int(size) not in states:
                    continue
                where = np.flatnonzero(lengths == size)
                for at in range(0, len(where), tile):
                    some = where[at : at + tile]
                    waiting[int(size)][0].extend(ids[some].tolist())
                    waiting[int(size)][1].append(flat[starts[some][:, None] + np.arange(size)])
                    if len(waiting[int(size)][0]) >= tile:
                        flush(int(size))
        for size, state in states.items():
            flush(size)
            for at in range(0, len(state.ids), 1000):
                some = [(int(q), h) for q, h in zip(state.ids[at : at + 1000], state.heaps[at : at + 1000]) if h]
                if some:
                    found = [[{"score": s, "vec_id": -c} for s, c in h] for _, h in some]
                    yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in some], pa.int64()), pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))], names=["query_id", "found"])

    return run
