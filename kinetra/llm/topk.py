"""Exact top-k search by inner product with pivot-table elimination.

Components become floor(SCALE * x), so scores are exact integers. By |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, a lower bound
on the distance of q and x is an upper bound on their score. Distances of all vectors to PIVOTS pivots (vectors with
the least hash of vec_id, a bounded choice) are computed once and stored beside the vectors; |d(q, p) - d(x, p)|, at most
over the pivots, is the lower bound. For each query, candidates of a block are evaluated in the order of their bounds until
no bound reaches the k-th best score so far, so the result is exact whatever the pivots are.

Queries go to the executors in blocks of at most BLOCK queries, each against all rows; every partition returns its k
best for each query, and those are merged. Work per task is bounded by its own rows and one block.

Defined results: vectors that are null, hold a null or a component that is not finite, or have no vec_id take no part;
vectors of different lengths have no product, so each length is searched by itself (empty vectors score 0); ties go to the
smaller vec_id; rows with a query's vec_id are its own and no candidates of it (of several such rows of one length the
least vector asks); other repeated rows count once each; k or fewer candidates give all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.workers import lean
from kinetra.session import durable

SCALE = 256
PIVOTS = 24
BLOCK = 8192
STEP = 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (integer components) and length of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding").filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return kept.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(SCALE))).cast("double")).alias("v"), F.size(x).alias("length"))


class PivotTable:
    """Rows of a block with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.far = ids[order], x[order], far[order]
        self.norm = (self.x**2).sum(1)

    def best(self, qid: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, vec_id, score): up to k best of this block for each query."""
        far, norm = distances(q, pivots), (q**2).sum(1)
        rows, ids, scores = [], [], []
        for i in range(len(q)):
            low = np.abs(self.far - far[i]).max(axis=1)
            # One unit of slack covers the rounding of the square roots.
            bound = (norm[i] + self.norm - np.maximum(low - 1e-6, 0) ** 2) / 2 + 1
            bound[self.ids == qid[i]] = -np.inf
            got_ids, got, start, size = np.zeros(0, np.int64), np.zeros(0), 0, STEP
            left = np.flatnonzero(bound > -np.inf)
            while len(left):
                head = left[np.argpartition(-bound[left], size - 1)[:size]] if len(left) > size else left
                here = self.x[head] @ q[i]
                got_ids, got = np.concatenate([got_ids, self.ids[head]]), np.concatenate([got, here])
                first = np.lexsort((got_ids, -got))[:k]
                got_ids, got = got_ids[first], got[first]
                if len(head) == len(left):
                    break
                edge = bound[head].min()
                least = got[-1] if len(got) == k else -np.inf
                if edge < least:
                    break
                rest = np.ones(len(self.ids), bool)
                rest[head] = False
                left = left[rest[left] & (bound[left] >= least)]
                size *= 4
            rows.append(np.full(len(got), i))
            ids.append(got_ids)
            scores.append(got)
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots) or not len(x):
        return np.zeros((len(x), len(pivots)))
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _tabled(pivots: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column("v"), pivots.shape[1]), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "far"])

    return run


def _search(qid: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            block = PivotTable(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), q.shape[1]), _matrix(batch.column("far"), len(pivots)))
            row, ids, scores = block.best(qid, q, pivots, k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by every."""
    spark, rows = vectors.sparkSession, usable(vectors)
    asking = F.pmod("vec_id", F.lit(every)) == 0
    kinds, parts = "query_id bigint, vec_id bigint, score bigint", []
    for (length,) in sorted(rows.filter(asking).select("length").distinct().collect()):
        own = rows.filter(F.col("length") == length).select("vec_id", "v")
        chosen = own.withColumn("_h", F.xxhash64("vec_id")).orderBy("_h", "vec_id", "v").limit(pivots).collect()
        points = np.array([r.v for r in chosen], np.float64).reshape(len(chosen), length)
        table = durable(own.mapInArrow(_tabled(points), "vec_id bigint, v array<double>, far array<double>"), "pivot-table")
        ids: list[int] = []
        vs: list[list[float]] = []
        for r in table.filter(asking).groupBy("vec_id").agg(F.min("v").alias("v")).toLocalIterator():
            ids.append(r.vec_id)
            vs.append(r.v)
            if len(ids) == BLOCK:
                parts.append(table.mapInArrow(_search(np.array(ids, np.int64), np.array(vs, np.float64).reshape(len(ids), length), points, k), kinds))
                ids, vs = [], []
        if ids:
            parts.append(table.mapInArrow(_search(np.array(ids, np.int64), np.array(vs, np.float64).reshape(len(ids), length), points, k), kinds))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = functools.reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
