"""Exact nearest neighbours and their vote (M19), as a pruned join.

Points are dealt to cells around sampled pivots. A query first meets the cells
next to it until they hold ``k`` points, which gives its k-th distance so far.
In a second round it visits only the cells that the triangle inequality does
not exclude, and only as far as its bound is not met yet; most cells far away
are never read for it. A cell is cut into blocks of bounded size and so are
the queries that visit it, so a hot cell (copies of one vector) is spread over
many tasks. Each block returns at most ``k`` rows per query, never all pairs.
The result is exact: there is no cap on candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save_intermediate, ship_library

MAX_PIVOTS = 1024        # collected and broadcast: this many vectors at most
CELL_ROWS = 2_000        # points per cell aimed at
BLOCK_ROWS = 8_192       # points of a cell that one task meets at a time
QUERY_ROWS = 4_096       # queries that meet such a block at a time
VALUES = 1 << 21         # numbers of a matrix (queries by pivots, visits by dimensions) that a task holds at a time
SLACK = 1e-9             # relative slack of the bounds, for rounding

POINT = "cell int, block int, id long, v array<double>, label double"
VISIT = "cell int, query_id long, q array<double>, bound double"
NEAR = "query_id long, id long, distance double, label double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all of ``b``, rounding error up to about 1e-8 of their norms."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def nearest(ids: np.ndarray, points: np.ndarray, query: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``k`` nearest of the points ``among``, ties to the smaller id."""
    exact = np.sqrt(np.square(points[among] - query).sum(1))
    order = np.lexsort((ids[among], exact))[:k]
    return among[order], exact[order]


def slices(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``n`` rows of ``width`` numbers each that hold at most ``VALUES`` numbers (at least one row)."""
    rows = max(1, VALUES // max(1, width))
    return ((a, min(n, a + rows)) for a in range(0, n, rows))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


class Cells:
    """Pivots and what is known of the points around them (p-sized)."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.counts, self.low, self.high = pivots, counts, low, high

    def first_visits(self, to_pivots: np.ndarray, k: int) -> np.ndarray:
        """Cells nearest to a query, until they hold ``k`` points."""
        order = np.argsort(to_pivots, kind="stable")
        order = order[self.counts[order] > 0]
        enough = np.searchsorted(np.cumsum(self.counts[order]), k) + 1
        return order[:enough]

    def open_to(self, to_pivots: np.ndarray, bound: float, scale: float) -> np.ndarray:
        """Cells that may hold a point within ``bound``: a point p of a cell is
        at ``low`` to ``high`` from its pivot, so at least ``to_pivot - high`` and
        ``low - to_pivot`` from the query; and as its pivot is its nearest one, at
        least ``(to_pivot - to_own) / 2``."""
        least = np.maximum(np.maximum(to_pivots - self.high, self.low - to_pivots), (to_pivots - to_pivots.min()) / 2)
        return np.flatnonzero((self.counts > 0) & (least <= bound + SLACK * scale))


def _vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    v = F.transform(vector_col, lambda x: x.cast("double"))
    label = F.col(label_col).cast("double") if label_col else F.lit(None).cast("double")
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), label.alias("label"))


def _deal(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Every point with its nearest pivot and the distance from it."""
    d = pivots.shape[1]
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in slices(whole.num_rows, max(len(pivots), d)):
                b = whole.slice(start, stop - start)
                x = _matrix(b.column(1), d)
                cell = distances(x, shared.value).argmin(1)
                exact = np.sqrt(np.square(x - shared.value[cell]).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("int32")), pa.array(exact)],
                                                 names=["id", "v", "label", "cell", "far"])

    return points.mapInArrow(work, "id long, v array<double>, label double, cell int, far double")


def _visits(queries: DataFrame, cells: Cells, k: int, second: bool) -> DataFrame:
    """One row per query and cell that it visits in this round."""
    d = cells.pivots.shape[1]
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for start, stop in slices(whole.num_rows, max(len(c.pivots), d)):
                b = whole.slice(start, stop - start)
                q = _matrix(b.column(1), d)
                far = distances(q, c.pivots)
                scale = np.sqrt((q * q).sum(1)) + np.sqrt((c.pivots * c.pivots).sum(1)).max() + c.high.max()
                bounds = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                goes = []
                for i in range(len(q)):
                    first = c.first_visits(far[i], k)
                    goes.append(np.setdiff1d(c.open_to(far[i], bounds[i], scale[i]), first) if second else first)
                cell = np.concatenate(goes).astype("int32")
                at = np.repeat(np.arange(len(q)), [len(g) for g in goes])
                # a query's vector is repeated for every cell it visits: in high dimensions that is most of them
                for x, y in slices(len(at), d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[x:y]), b.column(0).take(pa.array(at[x:y])), b.column(1).take(pa.array(at[x:y])),
                         pa.array(bounds[at[x:y]])], names=["cell", "query_id", "q", "bound"])

    return queries.mapInArrow(work, VISIT)


def _meet(visits: DataFrame, points: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest within its bound for every query and visited block."""
    spread = F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int")
    parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("query_parts"))
    parts = parts.join(blocks, "cell")      # a row per cell: bounded by the number of pivots
    asks = visits.join(F.broadcast(parts), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), spread.alias("part"), "query_id", "q", "bound")
    have = points.join(F.broadcast(parts), "cell").select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("part"), "id", "v", "label")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy(dtype=float)
            p = np.stack(right["v"].to_list())
            norm = np.sqrt((p * p).sum(1)).max()
            for a in range(0, len(left), 256):
                some = left.iloc[a:a + 256]
                q = np.stack(some["q"].to_list())
                far = distances(q, p)
                for i, (query_id, bound) in enumerate(zip(some["query_id"], some["bound"])):
                    # squares cancel, so the rough distance of a close pair is off by about the root of the rounding error
                    slack = 1e-6 * (norm + np.sqrt(q[i] @ q[i]))
                    worst = np.partition(far[i], k - 1)[k - 1] if len(ids) > k else np.inf
                    among = np.flatnonzero(far[i] <= min(worst, bound) + slack)
                    place, exact = nearest(ids, p, q[i], among, k)
                    out.append(pd.DataFrame({"query_id": query_id, "id": ids[place], "distance": exact, "label": labels[place]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": [], "label": []})

    keys = ["cell", "block", "part"]
    return asks.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInPandas(work, NEAR)


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def neighbours(queries: DataFrame, points: DataFrame, k: int = 16, id_col: str = "id", vector_col: str = "vector",
               label_col: str | None = None, point_id: str | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance, label: the ``k`` points nearest to
    every query (Euclidean, ties to the smaller id), exactly.

    Query ids are distinct; a point with a query's id is a point like any
    other. Rows with a null id or vector take no part. Fewer than ``k`` points
    give all of them. The driver sees up to ``MAX_PIVOTS`` pivots and four
    numbers per cell; a task meets ``BLOCK_ROWS`` points and ``QUERY_ROWS`` queries.
    """
    spark = points.sparkSession
    ship_library(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, id long, distance double, label double")
    asked = _vectors(queries, id_col, vector_col).select(F.col("id").alias("query_id"), "v", F.lit(float("inf")).alias("bound"))
    pts = _vectors(points, point_id or id_col, vector_col, label_col)
    n = pts.count()
    if not n:
        return empty
    # Pivots by a hash of the id: the same rows on every attempt of a task.
    wanted = max(1, min(MAX_PIVOTS, n // CELL_ROWS, int(n ** 0.5) + 1))
    drawn = pts.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).toArrow()["v"].combine_chunks()
    d = len(drawn[0])
    pivots = np.unique(_matrix(drawn, d), axis=0)
    dealt = _deal(pts, pivots)
    stats = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    counts, low, high = (np.zeros(len(pivots), t) for t in (np.int64, float, float))
    held = save_intermediate(dealt, "knn-cells")
    for r in stats.collect():
        counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    cells = Cells(pivots, counts, low, high)
    blocks = spark.createDataFrame([(i, max(1, -(-int(c) // BLOCK_ROWS))) for i, c in enumerate(counts)], "cell int, n_blocks int")
    in_blocks = held.join(F.broadcast(blocks), "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("block"), "id", "v", "label")

    first = save_intermediate(_best(_meet(_visits(asked, cells, k, False), in_blocks, blocks, k), k), "knn-first")
    bounds = first.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("m"))
    again = asked.join(bounds, "query_id").select(
        "query_id", "v", F.when(F.col("m") >= k, F.col("far")).otherwise(float("inf")).alias("bound"))
    more = _meet(_visits(again, cells, k, True), in_blocks, blocks, k)
    return _best(first.select("query_id", "id", "distance", "label").unionByName(more), k).select(
        "query_id", "rank", "id", "distance", "label")


def vote(near: DataFrame) -> DataFrame:
    """query_id, prediction, share: the label most frequent among a query's
    neighbours (ties to the smaller label) and its share; null labels do not vote."""
    counts = near.where(F.col("label").isNotNull()).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("query_id").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("prediction"),
        (F.max("n") / F.sum("n")).alias("share"))


def classify(train: DataFrame, rows: DataFrame, label_col: str, k: int = 16, id_col: str = "id",
             vector_col: str = "vector") -> DataFrame:
    """``rows`` labelled by the vote of their ``k`` nearest training rows."""
    return vote(neighbours(rows, train, k, id_col, vector_col, label_col))
