"""Splits and folds.

Splits are functions of a row key (hash buckets), so they do not depend
on partitioning or task order and survive recomputation after an executor
loss. ``randomSplit`` is not used: it depends on the partition layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import join_on
from .windows import event_ordinal

# The portable integer hash (same numbers in Spark and in
# plain SQL): bucket = pmod(key * MULT + seed * SEED_MULT, n).
MULT = 7919
SEED_MULT = 104729


def hash_bucket(key: str | Column, n: int, seed: int = 0, method: str = "xxhash") -> Column:
    """Bucket 0..n-1 of a row key. ``xxhash`` for any key type; ``mod`` is
    the portable integer form (keys below 1e14)."""
    k = F.col(key) if isinstance(key, str) else key
    if method == "mod":
        return F.pmod(k.cast("long") * F.lit(MULT) + F.lit(seed * SEED_MULT), F.lit(n))
    return F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(n))


def split_random(df: DataFrame, key: str, weights: Sequence[float], seed: int = 0,
                 method: str = "xxhash", buckets: int | None = None, out: str | None = None):
    """M1: repeatable split by key hash. Returns a list of DataFrames, or
    ``df`` with a split index column when ``out`` is given. Shares are held
    to one in ``buckets`` (by default 2**30, or 10,000 in the portable form,
    which does not spread small keys further); a null key is one key."""
    buckets = buckets or (10_000 if method == "mod" else 1 << 30)
    total = float(sum(weights))
    edges, acc = [], 0.0
    for w in weights:
        acc += w / total
        edges.append(round(acc * buckets))
    b = hash_bucket(key, buckets, seed, method)
    idx = F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        idx = F.when(b < edges[i], F.lit(i)).otherwise(idx)
    if out:
        return df.withColumn(out, idx.cast("int"))
    tagged = df.withColumn("_split", idx)
    return [tagged.filter(F.col("_split") == i).drop("_split") for i in range(len(weights))]


def split_stratified(df: DataFrame, key: str, label: str, test_frac: float, seed: int = 0,
                     method: str = "xxhash", out: str = "is_test") -> DataFrame:
    """M2: exact stratified split: within each class, rows ordered by key hash
    (key as tie-break) and the first ``round(frac * n_c)`` go to test.

    Ordinals come from the skew-safe ordinal operator (a class may hold
    most rows); class sizes from one aggregate.
    """
    h = df.withColumn("_h", hash_bucket(key, 1 << 30, seed, method))
    h = event_ordinal(h, label, "_h", key, "_ord", skew_safe=True)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    j = join_on(h, sizes, [label])
    k = F.round(F.col("_nc") * F.lit(test_frac))
    return j.withColumn(out, (F.col("_ord") <= k).cast("int")).drop("_h", "_ord", "_nc")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0,
                     method: str = "xxhash", out: str = "fold") -> DataFrame:
    """M6: stratified k folds: fold = (ordinal within class by key hash) mod k."""
    h = df.withColumn("_h", hash_bucket(key, 1 << 30, seed, method))
    h = event_ordinal(h, label, "_h", key, "_ord", skew_safe=True)
    return h.withColumn(out, F.pmod(F.col("_ord") - 1, F.lit(k)).cast("int")).drop("_h", "_ord")


def split_by_year(df: DataFrame, year: str | Column, train_until: int) -> tuple[DataFrame, DataFrame]:
    """M3: train = year <= train_until, test = later years."""
    y = F.col(year) if isinstance(year, str) else year
    return df.filter(y <= train_until), df.filter(y > train_until)


def walk_forward_plan(years: Sequence[int], mode: str = "expanding", n_folds: int = 6,
                      width: int = 2, holdout_last: bool = True) -> list[tuple[int, list[int]]]:
    """M4/M5 fold plan (driver-side, p-sized): [(validation year, train years)].

    Validation years are the last ``n_folds`` years before the final one
    (kept back as the hold-out when ``holdout_last``).
    """
    ys = sorted(set(years))
    pool = ys[:-1] if holdout_last else ys
    vals = pool[-n_folds:]
    plan = []
    for v in vals:
        prior = [y for y in ys if y < v]
        train = prior if mode == "expanding" else prior[-width:]
        if train:
            plan.append((v, train))
    return plan


def walk_forward(df: DataFrame, year: str, date: str, plan: list[tuple[int, list[int]]],
                 embargo_months: int = 6, valid_months: int = 12) -> DataFrame:
    """M4/M5: fold membership in long form: (row columns..., fold, role).

    A training row is dropped when it falls within ``embargo_months`` of the
    validation year's start (T35: forward-looking labels would leak); 0
    reproduces the reference. ``valid_months`` of the validation year are
    validated (6: its first half). One scan: each row is copied to the folds
    it belongs to.
    """
    first = lambda y, m=1: F.make_timestamp_ntz(F.lit(y), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    places = []
    for i, (v, train) in enumerate(plan):
        trains = F.col(year).isin(train)
        if embargo_months:
            trains = trains & (F.col(date) < F.add_months(first(v), -embargo_months))
        valid = F.col(year) == v
        if valid_months < 12:
            valid = valid & (F.col(date) < first(v, valid_months + 1))
        places += [F.when(hit, F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role")))
                   for hit, role in ((trains, "train"), (valid, "valid"))]
    return df.select("*", F.inline(F.filter(F.array(*places), lambda p: p.isNotNull())))
