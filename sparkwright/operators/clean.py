"""Filters, trims, deduplication and rare-level handling.

Predicates are plain Column expressions so Catalyst pushes them into the
Parquet scan where the column is stored. Per-group bounds are aggregated
(partial aggregation) and joined back by group key; AQE broadcasts the
bound table when it is small and splits skewed partitions when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import join_on
from .quantiles import quantiles_wide


def _c(col):
    return F.col(col) if isinstance(col, str) else col


# ----------------------------------------------------------- predicates

def between_exclusive(col, lo, hi) -> Column:
    """``lo < col < hi`` (strict both sides)."""
    c = _c(col)
    return (c > lo) & (c < hi)


def null_safe_not(cond: Column) -> Column:
    """negation where a null condition counts as false before negating."""
    return ~F.coalesce(cond, F.lit(False))


def match_flag(col, pattern: str, kind: str = "like") -> Column:
    """F8: LIKE / contains / RLIKE predicate."""
    c = _c(col)
    if kind == "like":
        return c.like(pattern)
    if kind == "contains":
        return c.contains(pattern)
    if kind == "rlike":
        return c.rlike(pattern)
    raise ValueError(kind)


def holdout(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(rows outside the hold-out period, rows inside it); null -> outside.

    Both masks are built on ``df`` itself (T38), never carried across frames."""
    inside = F.coalesce(cond, F.lit(False))
    return df.filter(~inside), df.filter(inside)


def filter_distinct(df: DataFrame, cond: Column, col: str) -> DataFrame:
    """distinct values of ``col`` among rows where ``cond`` holds."""
    return df.filter(cond).select(col).distinct()


# ---------------------------------------------------------------- trims

def trim_quantiles(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """keep rows with ``q(lo) < col < q(hi)`` (exact quantiles, strict)."""
    q = quantiles_wide(df, [col], [lo, hi], names=["lo", "hi"])
    b = q.select(F.struct(f"{col}_lo", f"{col}_hi")).scalar()
    return df.filter(between_exclusive(col, b[f"{col}_lo"], b[f"{col}_hi"]))


def _out_flags(cols: Sequence[str]) -> list[Column]:
    # null-safe: a missing value is never out of bounds
    return [F.coalesce((F.col(c) < F.col(f"{c}__lo")) | (F.col(c) > F.col(f"{c}__hi")), F.lit(False))
            for c in cols]


def _with_bounds(df: DataFrame, by: Sequence[str], cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    # ``df`` is read by the bound computation (three passes) and by the join:
    # pass a scan or a checkpointed frame, not an expensive derived plan
    b = quantiles_wide(df, cols, [lo, hi], by, names=["_lo", "_hi"])
    return join_on(df, b, list(by))


def trim_panel_any(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                   lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """drop rows where any column is outside its group's [q(lo), q(hi)] (null never trims, T21)."""
    j = _with_bounds(df, by, cols, lo, hi)
    keep = ~F.greatest(*[f.cast("int") for f in _out_flags(cols)], F.lit(0)).cast("boolean")
    return j.filter(keep).select(*df.columns)


def trim_panel_count(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                     lo: float = 0.025, hi: float = 0.975, max_out: int = 15) -> DataFrame:
    """drop rows with more than ``max_out`` columns outside the group bounds."""
    j = _with_bounds(df, by, cols, lo, hi)
    n_out = sum((f.cast("int") for f in _out_flags(cols)), F.lit(0))
    return j.filter(n_out <= max_out).select(*df.columns)


# ------------------------------------------------------------- set ops

def union_all(a: DataFrame, b: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Union by column name (T7: never by position)."""
    return a.unionByName(b, allowMissingColumns=allow_missing)


def dedupe(df: DataFrame, keys: Sequence[str] | None = None, order: str | None = None,
           keep: str = "last") -> DataFrame:
    """Drop duplicates.

    Without ``keys`` the whole row is the key (all copies are equal, so
    keep first/last does not matter). With ``keys`` and ``order`` the kept
    row is the one with the largest (``last``) or smallest (``first``)
    ``order`` value, found by an aggregate (``max_by``/``min_by``) rather
    than a window, so a hot key is combined map-side instead of sorted in
    one task.
    """
    if not keys:
        return df.dropDuplicates()
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*rest), F.struct(order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


# ---------------------------------------------------------- rare levels

def top_levels(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values (ties by value).

    Global top-N keeps at most ``n`` rows per partition before merging.
    """
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.desc("count"), F.asc(col)).limit(n)


def collapse_levels(df: DataFrame, col: str, top_n: int | None = None, min_count: int | None = None,
                    other: str = "others", out: str | None = None) -> DataFrame:
    """Replace levels outside the kept set with ``other`` (null stays null).

    Kept set: ``top_n`` most frequent (T23) or every level seen at least
    ``min_count`` times. Levels are computed on non-null values (T39).
    """
    out = out or col
    if top_n is not None:
        kept = F.broadcast(top_levels(df, col, top_n).select(col))    # at most top_n rows
    else:
        kept = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")) \
            .filter(F.col("_n") >= min_count).select(col)
    kept = kept.withColumn("_kept", F.lit(True))
    j = df.join(kept, col, "left")
    v = F.when(F.col(col).isNull(), F.lit(None)).when(F.col("_kept"), F.col(col)).otherwise(F.lit(other))
    return j.withColumn(out, v).drop("_kept")
