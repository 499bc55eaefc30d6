"""Boosted trees of many draws and folds (M8, M15): one pass over the data per tree level.

A separate ``GBTClassifier`` per draw and fold starts several jobs for every tree
level, tens of thousands for a search. Here the models advance
together: a task turns its rows into the histograms of every model's open
nodes, Spark adds them up and picks the splits, and the driver gets those alone.
The number of jobs does not depend on the number of models. Trees, splits and
weights are those of Spark's estimator.
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, save_intermediate, ship_library
from .folds import written_by_year

DEEPEST = 10            # levels of trees that advance together: their nodes are held by place
WIDEST = 64             # features of such trees: each open node has a histogram of them
ROWS = 5_000            # rows that are worth a task of their own, up to the session's parallelism
MOST_ROWS = 50_000      # rows of a task at most
CELLS = 2**28           # rows times models whose margins are kept at once
PLACES = 2**25          # numbers of the histograms that a task adds up at once
LINEAGE = 10            # rounds between checkpoints
SAMPLE = 10_000         # rows that thresholds are taken from, as in Spark's estimator
EPSILON = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Settings:
    """Parameters of one model."""

    rounds: int
    rate: float
    depth: int
    least: int          # rows of a leaf
    gain: float
    bins: int
    seed: int


@dataclass
class Tree:
    """Nodes by place (children of ``i`` at ``2 i + 1`` and ``2 i + 2``). ``feature`` is -1 where a row stays;
    otherwise it goes right if its bin is larger than ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    impurity: np.ndarray
    open: list[int] = field(default_factory=lambda: [0])    # nodes of the current level that may be split

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.full(n, np.nan))

    def place(self, x: np.ndarray) -> np.ndarray:
        """Node of every row of ``x`` (bins, a row per feature)."""
        n = x.shape[1]
        at, inner = np.zeros(n, np.int64), np.flatnonzero(self.feature >= 0)
        if not len(inner):
            return at
        # a leaf is its own child
        child, cell, cut = np.arange(len(self.feature)), np.zeros(len(self.feature), np.int64), np.full(len(self.feature), 255, np.uint8)
        child[inner], cell[inner], cut[inner] = 2 * inner + 1, self.feature[inner].astype(np.int64) * n, self.cut[inner]
        rows, flat = np.arange(n), x.ravel()
        for _ in range(int(inner[-1] + 1).bit_length()):
            at = child[at] + (flat.take(cell[at] + rows) > cut[at])
        return at


def settings(estimator, label: str) -> Settings | None:
    """Parameters of a plain ``GBTClassifier``, or None of one that does more."""
    if type(estimator) is not GBTClassifier or estimator.getLabelCol() != label:
        return None
    free = {"featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol", "maxIter", "stepSize", "maxDepth",
            "minInstancesPerNode", "minInfoGain", "maxBins", "seed", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval"}
    if not {p.name for p in estimator.params if estimator.isSet(p)} <= free or estimator.getRawPredictionCol() != "rawPrediction":
        return None
    if not 0 <= estimator.getMaxDepth() <= DEEPEST or not 2 <= estimator.getMaxBins() <= 256:
        return None
    return Settings(estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(),
                    estimator.getMinInfoGain(), estimator.getMaxBins(), estimator.getSeed())


def thresholds(values: np.ndarray, counts: np.ndarray, splits: int) -> np.ndarray:
    """At most ``splits`` thresholds between the distinct ``values`` (ascending), about equally many
    rows apart, by the rule of Spark's trees."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= splits:
        return middles
    stride = counts.sum() / (splits + 1)
    seen, target, out = float(counts[0]), stride, []
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (a row per feature) of rows ``x``: how many thresholds are smaller."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)


def _variance(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def best_splits(h: np.ndarray, least: int, gain: float, impurity: np.ndarray):
    """The best split of every node from its histogram ``h[node, (n, sum, sum of squares), feature, bin]``.

    ``impurity`` is that of the nodes, NaN for a root. Gives gain, feature and bin, and n, sum, sum of squares of the
    node and of its left and right child. Ties go to the first feature and bin; a node without a split has gain -inf."""
    left = h.cumsum(3)
    total = left[..., -1:]
    right = total - left
    (n, s, q), (nl, sl, ql), (nr, sr, qr) = (np.moveaxis(a, 1, 0) for a in (total, left, right))
    own = _variance(n[:, 0, 0], s[:, 0, 0], q[:, 0, 0])
    own = np.where(np.isnan(impurity), own, impurity)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = own[:, None, None] - nl / (nl + nr) * _variance(nl, sl, ql) - nr / (nl + nr) * _variance(nr, sr, qr)
    # beyond a feature's last threshold nothing is left on the right
    ok = (nl >= least) & (nr >= max(1, least)) & (found >= gain)
    found = np.where(ok, found, -np.inf).reshape(len(h), -1)
    best = found.argmax(1)
    node = np.arange(len(h))
    f, b = np.divmod(best, h.shape[3])
    return found[node, best], f, b, total[:, :, 0, 0], left[node, :, f, b], right[node, :, f, b]


def _histograms(x, target, at, slot, many: int, bins: int) -> np.ndarray:
    """Per open node (``slot`` of a node, -1: not open): rows, sum and sum of squares of ``target`` by feature and bin."""
    k = slot[at]
    keep = k >= 0
    if not keep.all():
        x, target, k = x[:, keep], target[keep], k[keep]
    base, size, square = k * bins, many * bins, target * target
    out = np.empty((many, 3, len(x), bins))
    for j, column in enumerate(x):
        cell = base + column
        for i, w in enumerate((None, target, square)):
            out[:, i, j] = np.bincount(cell, w, size).reshape(many, bins)
    return out


class Together:
    """Fits boosted trees on all rows but those of a fold, many at a time.

    ``data`` has rows (x array<double>, y double of 0 and 1, fold long); ``rows`` counts them by fold."""

    def __init__(self, data: DataFrame, rows: dict[int, int], wide: int, bins: int, seed: int):
        self.data, self.rows, self.wide, self.bins, self.seed = data, rows, wide, bins, seed
        self.cuts: dict[int, list[np.ndarray]] = {}

    def size(self, fold: int) -> int:
        return sum(self.rows.values()) - self.rows.get(fold, 0)

    def _take_thresholds(self, folds: Sequence[int]) -> None:
        """Thresholds of every feature from the training rows of each fold, or from ``SAMPLE`` of them."""
        bins, wide = self.bins, self.wide
        sizes = {f: self.size(f) for f in folds}

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("value")
            f = int(pdf["out"].iloc[0])
            found = thresholds(pdf["value"].to_numpy(), pdf["n"].to_numpy(float), min(bins, sizes[f]) - 1)
            return pd.DataFrame({"out": [f], "pos": [int(pdf["pos"].iloc[0])], "cuts": [found]})

        need = [f for f in folds if f not in self.cuts]
        parts = []
        for f in need:
            part = self.data.where(F.col("fold") != f)
            if sizes[f] > max(SAMPLE, bins * bins):
                part = part.sample(False, max(SAMPLE, bins * bins) / sizes[f], self.seed % 2**31)
            parts.append(part.select(F.lit(f).cast("long").alias("out"), F.posexplode("x").alias("pos", "value")))
        if not parts:
            return
        values = parts[0]
        for p in parts[1:]:
            values = values.unionByName(p)
        counted = values.groupBy("out", "pos", "value").agg(F.count(F.lit(1)).alias("n"))
        got = {(r.out, r.pos): np.array(r.cuts, dtype=float)
               for r in counted.groupBy("out", "pos").applyInPandas(cut, "out long, pos int, cuts array<double>").collect()}
        for f in need:
            self.cuts[f] = [got.get((f, j), np.empty(0)) for j in range(wide)]

    def _blocks(self, folds: Sequence[int]):
        """Training rows of every fold as blocks (fold, bins, labels -1 and 1)."""
        cuts = {f: self.cuts[f] for f in folds}

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                out = [(f, _binned(x[fold != f], c), 2 * y[fold != f] - 1) for f, c in cuts.items() if (fold != f).any()]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(o) for o in out], pa.binary())], names=["block"])

        return self.data.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r.block))

    def fit(self, models: Sequence[tuple[Settings, int]]) -> list[list[Tree]]:
        """Trees of every model (its settings and the fold left out)."""
        self._take_thresholds(sorted({f for _, f in models}))
        out: list[list[Tree]] = [[] for _ in models]
        for batch in self._batches(models):
            for m, trees in zip(batch, self._fit([models[m] for m in batch]), strict=True):
                out[m] = trees
        return out

    def _batches(self, models) -> Iterator[list[int]]:
        """Models by number that fit into ``CELLS`` and ``PLACES`` together."""
        batch, cells, places = [], 0, 0
        for m, (s, f) in enumerate(models):
            n = self.size(f)
            p = min(2 ** max(0, s.depth - 1), n // (2 * s.least) + 1) * 3 * self.wide * self.bins
            if batch and (cells + n > CELLS or places + p > PLACES):
                yield batch
                batch, cells, places = [], 0, 0
            batch.append(m)
            cells, places = cells + n, places + p
        if batch:
            yield batch

    def _fit(self, models: Sequence[tuple[Settings, int]]) -> list[list[Tree]]:
        mine: dict[int, list[int]] = {}
        for m, (_, f) in enumerate(models):
            mine.setdefault(f, []).append(m)
        forests: list[list[Tree]] = [[] for _ in models]
        state = self._blocks(sorted(mine)).map(lambda b: (*b, np.zeros((len(mine[b[0]]), len(b[2]))))).persist(StorageLevel.MEMORY_AND_DISK)
        old = []
        try:
            for r in range(max(s.rounds for s, _ in models)):
                now = [m for m, (s, _) in enumerate(models) if r < s.rounds]
                trees = {m: Tree.of_depth(models[m][0].depth) for m in now}
                for level in range(max(models[m][0].depth for m in now) or 1):
                    open_ = {m: t for m, t in trees.items() if t.open}
                    if not open_:
                        break
                    for m, found in self._pass(state, mine, models, open_, r == 0):
                        _grow(trees[m], models[m][0], level, found)
                    while old:
                        old.pop().unpersist()
                for m in now:
                    forests[m].append(trees[m])
                if r + 1 < max(s.rounds for s, _ in models):
                    old.append(state)
                    state = self._advanced(state, mine, {m: (t, models[m][0].rate if r else 1.0) for m, t in trees.items()})
                    if (r + 1) % LINEAGE == 0:
                        state.checkpoint()
        finally:
            for s in (*old, state):
                s.unpersist()
        return forests

    def _pass(self, state, mine, models, open_: dict[int, Tree], first: bool) -> list[tuple]:
        """The best splits of the open nodes of every model in ``open_``."""
        bins = self.bins
        work = {}
        for m, t in open_.items():
            slot = np.full(len(t.feature), -1, np.int32)
            slot[t.open] = np.arange(len(t.open))
            work[m] = (t, slot, t.impurity[t.open], models[m][0])

        def add_up(blocks):
            sums: dict[int, np.ndarray] = {}
            for f, x, y, margin in blocks:
                for row, m in enumerate(mine[f]):
                    if m not in work:
                        continue
                    t, slot, _, _ = work[m]
                    target = y if first else 4 * y / (1 + np.exp(np.minimum(2 * y * margin[row], 709)))
                    h = _histograms(x, target, t.place(x), slot, len(t.open), bins)
                    sums[m] = sums[m] + h if m in sums else h
            yield from sums.items()

        def split(m: int, h: np.ndarray):
            _, _, impurity, s = work[m]
            return m, best_splits(h, s.least, s.gain, impurity)

        n = state.getNumPartitions()
        sums = state.mapPartitions(add_up)
        if n > 1:
            sums = sums.reduceByKey(operator.add, min(n, len(work)))
        return sums.map(lambda a: split(*a)).collect()

    def _advanced(self, state, mine, trees: dict[int, tuple[Tree, float]]):
        """The blocks with the margins after one more tree of each model."""
        def step(block):
            f, x, y, margin = block
            margin = margin.copy()
            for row, m in enumerate(mine[f]):
                if m in trees:
                    t, weight = trees[m]
                    margin[row] += t.value[t.place(x)] * weight
            return f, x, y, margin

        return state.map(step).persist(StorageLevel.MEMORY_AND_DISK)

    def margins(self, models: Sequence[tuple[Settings, int]], forests: Sequence[Sequence[Tree]], column: Sequence[int]) -> DataFrame:
        """Rows (y, z0, z1, ..., fold) of the folds left out: ``z`` of number ``column[m]`` is the margin of
        model ``m`` on the rows of its fold, null elsewhere."""
        cuts, many = self.cuts, max(column) + 1
        folds = sorted({f for _, f in models})
        grown = [(f, c, s.rate, trees) for (s, f), c, trees in zip(models, column, forests, strict=True)]
        names = [f"z{i}" for i in range(many)]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                fold = b.column(2).to_numpy(zero_copy_only=False)
                z = np.full((many, b.num_rows), np.nan)
                for f in folds:
                    rows = np.flatnonzero(fold == f)
                    if not len(rows):
                        continue
                    binned = _binned(x[rows], cuts[f])
                    for g, c, rate, trees in grown:
                        if g == f:
                            z[c, rows] = sum(t.value[t.place(binned)] * (rate if i else 1.0) for i, t in enumerate(trees))
                yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(v, from_pandas=True) for v in z], b.column(2)],
                                                 names=["y", *names, "fold"])

        return self.data.where(F.col("fold").isin(folds)).mapInArrow(
            score, ", ".join(["y double", *[f"{c} double" for c in names], "fold long"]))

    def scored(self, models: Sequence[tuple[Settings, int]], column: Sequence[int]) -> DataFrame:
        """Fits the models and writes their margins (``margins``), to be read by fold and column."""
        return written_by_year(self.margins(models, self.fit(models), column), "fold")


def _grow(tree: Tree, s: Settings, level: int, found) -> None:
    """Splits the open nodes of ``tree`` as found; their children that may be split are open next."""
    nodes, tree.open = tree.open, []
    for node, gain, f, b, total, *sides in zip(nodes, *found, strict=True):
        if level == 0:
            tree.value[node] = total[1] / total[0]
        if not gain > 0 or level >= s.depth:
            continue
        tree.feature[node], tree.cut[node] = f, b
        for child, (n, t, q) in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
            tree.value[child] = t / n
            tree.impurity[child] = _variance(n, t, q)
            # no split leaves enough rows on both sides of a node with fewer than twice as many
            if level + 1 < s.depth and abs(tree.impurity[child]) >= EPSILON and n >= 2 * s.least:
                tree.open.append(child)


def together(data: DataFrame, features: str, label: str, fold: str, bins: int, seed: int) -> Together | None:
    """A frame of rows to fit boosted trees on, or None where Spark's estimator does more or refuses the rows: values missing or infinite,
    labels but 0 and 1, categorical features, more than ``WIDEST`` features, or one fold only."""
    attributes = data.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if set(attributes) - {"numeric"} or data.schema[fold].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return None
    spark = data.sparkSession
    x = vector_to_array(F.col(features))
    head = data.select(F.size(x)).first()
    wide = head[0] if head else None
    if not wide or not 0 < wide <= WIDEST:
        return None
    ok = (F.size("x") == wide) & F.forall("x", lambda v: F.abs(v) < float("inf")) & F.col("y").isin(0.0, 1.0) & F.col("fold").isNotNull()
    rows = data.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("long").alias("fold"))
    seen = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).collect()
    if len(seen) < 2 or any(r.bad for r in seen):
        return None
    ship_library(spark)
    checkpoint_dir(spark)
    n = sum(r.n for r in seen)
    parts = max(1, min(spark.sparkContext.defaultParallelism, n // ROWS), -(-n // MOST_ROWS))
    return Together(save_intermediate(rows.repartition(parts), "boost"), {r.fold: r.n for r in seen}, wide, bins, seed)
