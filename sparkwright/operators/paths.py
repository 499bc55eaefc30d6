"""Regularisation paths (M11): all strengths and folds in one pass per step.

A separate fit per strength and fold reads the data hundreds of times. Here
every pass evaluates all models at once: a task turns its rows into the sums
of loss, gradient and Hessian of every model by two matrix products, Spark adds
them up, and the driver takes one (proximal) Newton step per model. The
number of passes does not depend on the number of strengths or folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save_intermediate, ship_library

ROWS = 512          # rows whose products a task takes at a time: small enough that they stay in cache and on one thread
PASSES = 100
WIDEST = 64         # features of a grid whose models are advanced together: each has a Hessian
TOLERANCE = 1e-10   # largest change of a coefficient, relative to the largest coefficient (at least 1)


@dataclass(frozen=True)
class Path:
    """Fitted models: ``coefficients[f][i]`` belongs to fold ``f`` left out (the
    last: none) and strength ``cs[i]``, features in order, intercept last."""

    cs: tuple[float, ...]
    features: tuple[str, ...]
    coefficients: np.ndarray
    accuracy: np.ndarray        # per fold and strength, on the rows left out
    loss: np.ndarray            # mean log loss there
    passes: int

    @property
    def best(self) -> int:
        """Strength of the highest mean accuracy; ties to the stronger penalty."""
        return int(np.argmax(self.accuracy.mean(0)))


def _sums(df: DataFrame, width: int, work) -> np.ndarray:
    """Sum over all tasks of the vector that ``work(x, y, fold)`` gives per slice of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                total += work(x, part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    # Tasks' vectors are added by place on the executors; the driver gets one number per place.
    rows = df.mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("at", "x"))
    table = rows.groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(width)
    out[table["at"].to_numpy()] = table["x"].to_numpy()
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _directions(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 20_000) -> np.ndarray:
    """Steps (a row per model) that minimise the quadratic models plus their
    penalties, given per model and coefficient. With an L1 part by
    coordinate descent, all models together."""
    m, p = beta.shape
    diagonal = np.arange(p)
    a = h.copy()
    # the ridge, and a little for directions that the data do not determine
    a[:, diagonal, diagonal] += l2 + 1e-12 * np.maximum(1.0, np.trace(h, axis1=1, axis2=2))[:, None]
    rest = g + l2 * beta      # gradient of the quadratic at the step
    if not l1.any():
        return -np.linalg.solve(a, rest[..., None])[..., 0]
    point = beta.copy()
    for sweep in range(1, sweeps + 1):
        largest = 0.0
        for j in range(p):
            free = point[:, j] - rest[:, j] / a[:, j, j]
            new = np.sign(free) * np.maximum(0.0, np.abs(free) - l1[:, j] / a[:, j, j])
            change = new - point[:, j]
            point[:, j] = new
            rest += a[:, :, j] * change[:, None]
            largest = max(largest, np.abs(change).max())
        if largest <= 1e-13 * max(1.0, np.abs(point).max()):
            break
        if sweep % 25 == 0:
            _polish(point, rest, a, l1)
    return point - beta


def _polish(point: np.ndarray, rest: np.ndarray, a: np.ndarray, l1: np.ndarray) -> None:
    """Solves each model exactly for its coefficients that are not zero, where
    that keeps their signs: descent alone is slow on correlated features."""
    for m in range(len(point)):
        s = np.flatnonzero((point[m] != 0) | (l1[m] == 0))
        signs = np.sign(point[m, s])
        move = -np.linalg.solve(a[m][np.ix_(s, s)], rest[m, s] + l1[m, s] * signs)
        if (np.sign(point[m, s] + move) * (l1[m, s] > 0) == signs * (l1[m, s] > 0)).all():
            point[m, s] += move
            rest[m] += a[m][:, s] @ move


def _newton(data: DataFrame, model_fold: np.ndarray, size: np.ndarray, reg: np.ndarray, elastic: float,
            weight: np.ndarray) -> tuple[np.ndarray, int]:
    """Coefficients (a row per model, intercept last) and passes over ``data`` (x, y, fold).

    A model leaves out fold ``model_fold`` (-1: none), has ``size`` rows and
    penalty ``reg`` on its coefficients times ``weight``."""
    m, p = len(model_fold), weight.shape[1] + 1
    upper = np.triu_indices(p)
    beta = np.zeros((m, p))
    step = np.zeros((m, p))
    scale = np.ones(m)
    held = np.full(m, np.inf)       # objective of the last accepted point
    promised = np.zeros(m)
    open_ = np.ones(m, bool)

    def penalty(b: np.ndarray) -> np.ndarray:
        w = weight * b[:, :-1]
        return reg * (elastic * np.abs(w).sum(1) + (1 - elastic) / 2 * (w * w).sum(1))

    def evaluate(points: np.ndarray, left_out: np.ndarray):
        def work(x, y, fold_of):
            x = np.c_[x, np.ones(len(x))]
            z = x @ points.T
            mine = fold_of[:, None] != left_out[None]
            mu = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            loss = ((_softplus(z) - y[:, None] * z) * mine).sum(0)
            g = x.T @ ((mu - y[:, None]) * mine)
            h = (x[:, upper[0]] * x[:, upper[1]]).T @ (mu * (1 - mu) * mine)
            return np.concatenate([loss, g.ravel(), h.ravel()])
        w = len(points)
        total = _sums(data, w * (1 + p + len(upper[0])), work)
        h = np.zeros((w, p, p))
        h[:, upper[0], upper[1]] = total[w * (1 + p):].reshape(-1, w).T
        h = h + np.triu(h, 1).transpose(0, 2, 1)
        return total[:w], total[w:w * (1 + p)].reshape(p, w).T, h

    passes = 0
    while open_.any() and passes < PASSES:
        at = np.flatnonzero(open_)
        trial = beta[at] + scale[at, None] * step[at]
        loss, g, h = evaluate(trial, model_fold[at])
        passes += 1
        full = np.zeros((m, p))
        full[at] = trial
        objective = np.full(m, np.inf)
        objective[at] = loss / size[at] + penalty(full)[at]
        limit = held[at] + 1e-4 * scale[at] * promised[at] + 1e-14 * np.maximum(1.0, np.abs(np.where(np.isinf(held[at]), 0, held[at])))
        good = objective[at] <= limit
        scale[at[~good]] /= 2
        open_[at[~good]] = scale[at[~good]] > 1e-10
        now = at[good]
        if not len(now):
            continue
        beta[now], held[now], scale[now] = trial[good], objective[now], 1.0
        l1, l2 = reg[now] * elastic, reg[now] * (1 - elastic)
        slope = g[good] / size[now, None]
        s = weight[now]
        step[now] = _directions(beta[now], slope, h[good] / size[now, None, None], np.c_[l1[:, None] * s, np.zeros(len(now))],
                                np.c_[l2[:, None] * s * s, np.zeros(len(now))])
        before, after = beta[now, :-1], beta[now, :-1] + step[now, :-1]
        promised[now] = ((slope * step[now]).sum(1) + l1 * ((s * np.abs(after)).sum(1) - (s * np.abs(before)).sum(1))
                         + l2 * (s * s * before * (after - before)).sum(1))
        open_[now] = np.abs(step[now]).max(1) > TOLERANCE * np.maximum(1.0, np.abs(beta[now]).max(1))
    return beta, passes


def logit_path(df: DataFrame, features: Sequence[str], label: str, cs: Sequence[float], elastic: float = 0.0,
               fold: str | None = None) -> Path:
    """Logistic regressions over inverse strengths ``cs`` (falling penalty)
    on all rows and, with ``fold`` (values 0 to k - 1), on all rows but those of
    each fold, which then score the model.

    Minimises the mean log loss plus ``1 / (c n)`` times ``elastic |b|_1 + (1 -
    elastic) / 2 |b|^2``, the intercept unpenalised, as a separate fit with
    ``reg_param_for_c`` does on features taken as they are. Rows with a null
    feature, label or fold are refused. The driver holds p * p numbers per
    model; a table without rows is refused.
    """
    cs, p = tuple(float(c) for c in cs), len(features) + 1
    ship_library(df.sparkSession)
    f = F.col(fold).cast("long") if fold else F.lit(0).cast("long")
    needed = [F.col(c) for c in (*features, label, *([fold] if fold else []))]
    data = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"),
                     f.alias("fold"), (sum((c.isNull().cast("int") for c in needed), F.lit(0)) > 0).alias("bad"))
    data = save_intermediate(data, "path")
    seen = data.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), (F.max("fold") + 1).alias("k")).first()
    if seen.bad or not seen.n:
        raise ValueError(f"{seen.bad} of {seen.n} rows have nulls")
    data = data.select("x", "y", "fold")
    k = int(seen.k) if fold else 0
    sizes = {r.fold: r.n for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = [*range(k), -1]
    n = np.array([seen.n - (sizes.get(g, 0) if g >= 0 else 0) for g in groups], dtype=float)
    model_fold = np.repeat(groups, len(cs))
    size = np.repeat(n, len(cs))
    reg = 1 / (np.tile(cs, len(groups)) * size)
    beta, passes = _newton(data, model_fold, size, reg, elastic, np.ones((len(reg), p - 1)))
    accuracy = loss_out = np.zeros((0, len(cs)))
    if k:
        points, folds = beta[:k * len(cs)], model_fold[:k * len(cs)]

        def score(x, y, fold_of):
            z = np.c_[x, np.ones(len(x))] @ points.T
            mine = fold_of[:, None] == folds[None]
            return np.concatenate([(((z > 0) == (y[:, None] > 0.5)) & mine).sum(0), ((_softplus(z) - y[:, None] * z) * mine).sum(0)])
        total = _sums(data, 2 * len(points), score).reshape(2, k, len(cs))
        rows = np.array([max(1, sizes.get(g, 0)) for g in range(k)], dtype=float)[:, None]
        accuracy, loss_out = total[0] / rows, total[1] / rows
        passes += 1
    return Path(cs, tuple(features), beta.reshape(len(groups), len(cs), p), accuracy, loss_out, passes)


def held_out_margins(df: DataFrame, features: str, label: str, regs: Sequence[float], elastic: float, fold: str, folds: int,
                     standardise: bool = True) -> DataFrame | None:
    """Rows (y, fold, z0, z1, ...): the margin of every row under the logistic
    regression of each penalty of ``regs`` on all rows but its fold's.

    ``features`` is a vector column. Penalties are those of Spark's estimator: on
    coefficients times the standard deviation of their feature in the training
    rows (``standardise``), or as they are. Gives None where that estimator does not
    simply minimise: rows with missing or infinite values, labels but 0 and 1, no rows
    in a fold, one class or a constant feature in training rows, more than
    ``WIDEST`` features, or no convergence.
    """
    head = df.select(F.size(vector_to_array(F.col(features)))).first()
    wide = head[0] if head else None
    if not wide or not 0 < wide <= WIDEST or min(regs) <= 0:
        return None
    ship_library(df.sparkSession)
    data = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("long").alias("fold"))
    ok = (F.size("x") == wide) & F.forall("x", lambda v: F.abs(v) < float("inf")) & F.col("y").isin(0.0, 1.0) & F.col("fold").between(0, folds - 1)
    data = save_intermediate(data.withColumn("bad", ~F.coalesce(ok, F.lit(False))), "grid")
    if data.where("bad").take(1):
        return None
    data = data.select("x", "y", "fold")
    moments = [f(F.col("x")[j]).alias(f"{n}{j}") for n, f in (("m", F.avg), ("v", F.var_pop)) for j in range(wide)]
    seen = {r.fold: r for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), *moments).collect()}
    if len(seen) < folds:
        return None
    n = np.array([seen[i].n for i in range(folds)], dtype=float)
    pos = np.array([seen[i].pos for i in range(folds)])
    mean, var = (np.array([[seen[i][f"{c}{j}"] for j in range(wide)] for i in range(folds)]) for c in "mv")
    size, sds = n.sum() - n, []
    for i in range(folds):
        rest = np.arange(folds) != i
        if not 0 < pos[rest].sum() < size[i]:
            return None
        centre = n[rest] @ mean[rest] / size[i]
        sds.append(np.sqrt(n[rest] @ (var[rest] + (mean[rest] - centre) ** 2) / max(1.0, size[i] - 1)))
    sds = np.array(sds)
    if not (sds > 0).all():
        return None
    many = len(regs)
    beta, passes = _newton(data, np.repeat(np.arange(folds), many), np.repeat(size, many), np.tile(np.asarray(regs, float), folds), elastic,
                           np.repeat(sds if standardise else np.ones_like(sds), many, axis=0))
    if passes >= PASSES or not np.isfinite(beta).all():
        return None
    beta = beta.reshape(folds, many, wide + 1)
    of = lambda i, j: F.array(*[F.lit(float(b)) for b in beta[:, i, j]])[F.col("fold")]
    margins = [sum((of(i, j) * F.col("x")[j] for j in range(wide)), of(i, wide)).alias(f"z{i}") for i in range(many)]
    return data.select("y", *margins, "fold")


def path_rows(path: Path) -> list[tuple]:
    """(c_index, c, feature, coef, accuracy, log_loss, best) of the models of all rows."""
    names = (*path.features, "intercept")
    scored = len(path.accuracy) > 0
    return [(i, c, name, float(path.coefficients[-1, i, j]),
             float(path.accuracy[:, i].mean()) if scored else None, float(path.loss[:, i].mean()) if scored else None,
             scored and i == path.best)
            for i, c in enumerate(path.cs) for j, name in enumerate(names)]
