"""Nearest neighbours by largest inner product, by collision-counting hashing.

Vectors are lifted so that the largest inner product is the least distance:
each gets one more component that brings it to the largest norm, a query is
scaled to that norm and gets 0. Every random projection is one sorted array.
Around a query's projection a window widens round by round (virtual
rehashing); a vector that lies in the windows of enough projections is
verified with its exact score. A query ends when the radius that the windows
stand for reaches its k-th best distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save_intermediate
from .common import ship

PROJECTIONS = 24
WIDTH = 1.0           # half window in units of the radius
MISS = 1.2           # standard deviations below the collisions expected at the radius
GROWTH = 1.2
SAMPLE, FIRST = 256, 0.8
BLOCK_ROWS = 65_536   # vectors indexed together in a task
QUERY_BLOCK = 4_096   # queries broadcast together


def collisions_needed(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a vector at the radius has but for ``miss`` standard deviations."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(projections * p - miss * math.sqrt(projections * p * (1 - p))))


class Index:
    """Sorted projections of a block of lifted vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, directions: np.ndarray):
        self.ids, self.vectors, self.norm = ids, vectors, norm
        rest = np.sqrt(np.maximum(norm**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        shadow = vectors @ directions[:-1] + rest[:, None] * directions[-1]
        self.order = np.argsort(shadow, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(shadow.T, self.order, axis=1)
        self.directions = directions
        self.need = collisions_needed(directions.shape[1])
        self.sample = vectors[::max(1, len(vectors) // SAMPLE)][:SAMPLE]

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted projections of a window around ``at`` on each."""
        low, high = (at - WIDTH * radius).tolist(), (at + WIDTH * radius).tolist()
        return (np.array([s.searchsorted(x) for s, x in zip(self.sorted, low)]),
                np.array([s.searchsorted(x, "right") for s, x in zip(self.sorted, high)]))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` (id, inner product), best first, ties to the smaller id; never the query's own id."""
        n = len(self.ids)
        size = math.sqrt(query @ query)
        at = (query * (self.norm / size)) @ self.directions[:-1]
        left = np.array([s.searchsorted(x) for s, x in zip(self.sorted, at.tolist())])
        right = left.copy()
        count = np.zeros(n, np.int64)
        scores = np.full(n, -np.inf)
        own = self.ids == query_id
        wanted = min(k, n - int(own.sum()))
        # The first radius is that of the nearest of a few vectors; it only saves rounds.
        radius = max(FIRST * math.sqrt(max(0.0, 2 * self.norm**2 - 2 * (self.sample @ query).max() * self.norm / size)), self.norm / 4)
        while wanted:
            a, b = self.windows(at, radius)
            parts = [o[i:j] for o, i, j in zip(self.order, a, left)] + [o[i:j] for o, i, j in zip(self.order, right, b)]
            count += np.bincount(np.concatenate(parts), minlength=n)
            left, right = np.minimum(a, left), np.maximum(b, right)
            found = np.flatnonzero((count >= self.need) & np.isneginf(scores) & ~own)
            scores[found] = self.vectors[found] @ query if 4 * len(found) < n else (self.vectors @ query)[found]
            verified = np.isfinite(scores)
            if verified.sum() >= wanted:
                worst = np.partition(scores, n - wanted)[n - wanted]
                distance = math.sqrt(max(0.0, 2 * self.norm**2 - 2 * worst * self.norm / size))
                if distance <= radius or verified.sum() == n - own.sum():
                    break
                radius = min(radius * GROWTH, distance) if distance > radius else radius * GROWTH
            else:
                radius *= GROWTH
        near = np.flatnonzero(np.isfinite(scores))
        if len(near) > wanted:
            least = np.partition(scores[near], len(near) - wanted)[len(near) - wanted] if wanted else np.inf
            near = near[scores[near] >= least - 1e-9 * self.norm * size]
        # Summed anew in one fixed order, so that equal vectors have equal scores.
        scores[near] = np.einsum("ij,j->i", self.vectors[near], query)
        near = near[np.lexsort((self.ids[near], -scores[near]))][:wanted]
        return self.ids[near], scores[near]


def usable(vector: Column) -> Column:
    """Vectors that take part: no null, no null or non-finite component, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           seed: int = 7, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each
    query (rows where ``queries`` holds) among all rows but its own id.

    Queries are taken in blocks of about ``query_block``, the only data that
    is collected and broadcast; each block meets every row, whose tasks index
    ``block_rows`` vectors at a time. Each task returns its best ``k`` per
    query, and these are merged by query. A block's results are written
    before the next one starts.

    Null, zero and non-finite vectors, those of another length than most,
    and rows without an id take no part. Ties go to the smaller id, so of many
    copies the first ids are returned. Fewer candidates than ``k`` give all;
    an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), queries.alias("asks"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    kinds = rows.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(squares).alias("m"), F.count_if("asks").alias("q"))
    kind = kinds.orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, vec_id long, score double"
    if kind is None or not kind.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == kind.d)
    norm, d = math.sqrt(kind.m) * (1 + 1e-12), kind.d
    directions = np.random.default_rng(seed).standard_normal((d + 1, PROJECTIONS))
    blocks = -(-kind.q // query_block)
    written = []
    for block in range(blocks):
        asked = rows.where(F.col("asks") & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).select("vec_id", "v").toArrow()
        if not asked.num_rows:
            continue
        values = asked["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        shared = spark.sparkContext.broadcast((asked["vec_id"].to_numpy(), values))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asks = shared.value

            def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                at = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
                flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held])
                index = Index(at, flat.reshape(len(at), d), norm, directions)
                for i, v in zip(ids.tolist(), asks):
                    near, scores = index.search(i, v, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), i)), pa.array(near), pa.array(scores)], names=["query_id", "vec_id", "score"])

            held, n = [], 0
            for b in batches:
                for s in range(0, b.num_rows, block_rows):
                    part = b.slice(s, block_rows)
                    if n and n + part.num_rows > block_rows:
                        yield from answers(held)
                        held, n = [], 0
                    held.append(part)
                    n += part.num_rows
            if held:
                yield from answers(held)

        found = rows.select("vec_id", "v").mapInArrow(work, schema)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        written.append(save_intermediate(top.select("query_id", "rank", "vec_id", "score"), "ann"))
        shared.destroy()
    out = written[0]
    for w in written[1:]:
        out = out.unionByName(w)
    return out
