"""Window operators.

Where no order is needed (group means, deviations, z-scores) the group
statistic is an aggregate joined back by key: partial aggregation happens
map-side, and a hot key does not pull its rows into one sorted window
task. Ordered positions (ordinals, ranks, prior-row means) default to
``grouped_running``: ranges of (group, order) of about equal size keep
tasks balanced when one group holds a large share of all rows;
``skew_safe=False`` selects the plain per-group window (fewer stages when
groups are known to be small).
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import join_on
from .quantiles import quantiles_wide


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# ------------------------------------------------------------- ordinals

def ranged(df: DataFrame, order: Sequence[Column], partitions: int | None = None, slice_col: str = "_slice") -> DataFrame:
    """``df`` dealt by ranges of ``order``, each row with the number of its range.

    Spark samples the order values, so ranges hold about as many rows each
    whatever their distribution, for any sortable type; only rows equal in all
    of ``order`` stay together. The frame is written to the checkpoint folder:
    range numbers depend on the sample, and every branch that reads them must
    see the same ones, also after an executor is lost.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return cut_lineage(dealt.withColumn(slice_col, F.spark_partition_id()))


def grouped_running(df: DataFrame, by, order: Sequence[str], sums: dict[str, Column],
                    partitions: int | None = None, inclusive: bool = True, descending: bool = False) -> DataFrame:
    """Running sums within groups, ordered by ``order`` (unique within a group),
    without a per-group window task.

    Rows are cut into ranges of (group, order) of about equal size
    (``ranged``), so a hot group spans many ranges and a small one shares its
    range. Each (range, group) is summed by itself and offset by the totals
    of the group's earlier ranges: at most one row per range and group.
    ``inclusive=False`` sums the rows strictly before the current one. No
    ``by`` is one group. Null keys are a group, null order values come first.
    """
    by, order = _cols(by), list(order)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    x = ranged(df.withColumns({f"_x_{k}": e for k, e in sums.items()}), [*[F.col(c) for c in by], *cols], partitions)
    w = Window.partitionBy("_slice", *by).orderBy(*cols).rowsBetween(*frame)
    local = x.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_x_{k}").over(w), F.lit(0)) for k in sums})
    tot = x.groupBy(*by, "_slice").agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    w_off = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_slice", *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}")
                                       for k in sums])
    out = join_on(local, offs, [*by, "_slice"])
    return out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums}) \
        .drop("_slice", *[f"_{p}_{k}" for k in sums for p in ("x", "l", "o")])


def event_ordinal(df: DataFrame, by, order: str, tie: str, out: str = "ordinal",
                  skew_safe: bool = True, partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its group by (order, tie).

    ``tie`` must be unique within a group (T1). ``skew_safe`` computes the
    same numbers with ``grouped_running`` (a running count), so a hot
    group is numbered by several tasks instead of one window task.
    """
    by = _cols(by)
    if not skew_safe:
        w = Window.partitionBy(*by).orderBy(F.col(order), F.col(tie))
        return df.withColumn(out, F.row_number().over(w))
    r = grouped_running(df, by, [order, tie], {out: F.lit(1)}, partitions)
    return r.withColumn(out, F.col(out).cast("int"))


def event_rank(df: DataFrame, by, order: str, out: str = "rank", skew_safe: bool = True,
               partitions: int | None = None) -> DataFrame:
    """SQL ``rank()`` within group by ``order`` (ties share a rank).

    ``skew_safe``: rank = 1 + rows of the group with a smaller order value;
    counts per (group, value) are pre-aggregated map-side and summed with
    ``grouped_running`` (exclusive), then joined back by (group, value).
    """
    by = _cols(by)
    if not skew_safe:
        w = Window.partitionBy(*by).orderBy(F.col(order))
        return df.withColumn(out, F.rank().over(w))
    g = df.groupBy(*by, order).agg(F.count(F.lit(1)).alias("_c"))
    r = grouped_running(g, by, [order], {"_before": F.col("_c")}, partitions, inclusive=False)
    r = r.select(*by, order, (F.col("_before") + 1).cast("int").alias(out))
    return join_on(df, r, [*by, order])


def order_key(df: DataFrame, order: str) -> Column:
    """Numeric form of an order column (timestamps/dates as epoch microseconds)."""
    from pyspark.sql import types as T
    dt = df.schema[order].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        epoch = F.lit("1970-01-01 00:00:00").cast(dt if not isinstance(dt, T.DateType) else "date")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(order))
    return F.col(order)


def early_cutoff(df: DataFrame, by, order: str, frac: float = 0.1, mode: str = "rank") -> DataFrame:
    """Per group, the order value at position ``ceil(frac * n)``.

    ``rank`` mode reproduces ``rank() == ceil(frac*n)`` (T2): a group whose
    cutoff position falls inside a tie gets no cutoff (null).
    ``row_number`` mode always takes the value at that position.
    One (group, value) count table gives both the group sizes and, summed
    range by range, the positions.
    """
    by = _cols(by)
    counts = df.select(*by, order_key(df, order).alias("_ok")).groupBy(*by, "_ok").agg(F.count("_ok").alias("_c"))
    placed = grouped_running(counts, by, ["_ok"], {"_before": F.col("_c")}, inclusive=False)   # written once, read twice
    f = Fraction(str(frac))
    sizes = placed.groupBy(*by).agg(F.sum("_c").alias("n")) \
        .withColumn("_k", (F.col("n") * f.numerator + (f.denominator - 1)
                           - F.pmod(F.col("n") * f.numerator + (f.denominator - 1), F.lit(f.denominator))) / f.denominator)
    first = F.col("_before") + 1
    here = first == F.col("_k") if mode == "rank" else (F.col("_k") >= first) & (F.col("_k") <= F.col("_before") + F.col("_c"))
    hit = join_on(sizes, placed, by, "left").groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when((F.col("_c") > 0) & here, F.col("_ok"))).alias("cutoff"))
    return hit.select(*by, "n", "cutoff")


def early_flag(df: DataFrame, by, order: str, frac: float = 0.1, mode: str = "rank",
               out: str = "is_early") -> DataFrame:
    """1 when the row's order value is strictly before its group's cutoff."""
    by = _cols(by)
    cut = early_cutoff(df, by, order, frac, mode).select(*by, "cutoff")
    j = join_on(df, cut, by, "left")
    v = order_key(df, order)  # order values compare in the cutoff table's form
    return j.withColumn(out, F.when(F.col("cutoff").isNotNull() & (v < F.col("cutoff")), F.lit(1))
                        .otherwise(F.lit(0))).drop("cutoff")


# ------------------------------------------------------ group statistics

def attach_group_agg(df: DataFrame, by, aggs: dict[str, Column], source: DataFrame | None = None,
                     fill: dict | None = None) -> DataFrame:
    """Aggregate per group (from ``source`` or ``df``) joined back onto rows.

    Replaces window-then-distinct: one partial aggregate, one join.
    """
    by = _cols(by)
    src = source if source is not None else df
    g = src.groupBy(*by).agg(*[e.alias(k) for k, e in aggs.items()])
    out = join_on(df, g, by, "left")
    return out.na.fill(fill) if fill else out


def deviation(df: DataFrame, by, col: str, out: str | None = None, mean_out: str | None = None,
              fill_mean: float | None = 0.0) -> DataFrame:
    """W5 + W7: group mean of ``col`` and the row's deviation from it."""
    mean_out = mean_out or f"{col}_group_mean"
    j = attach_group_agg(df, by, {mean_out: F.avg(col)})
    if fill_mean is not None:
        j = j.na.fill({mean_out: fill_mean})
    return j.withColumn(out or f"{col}_deviation", F.col(col) - F.col(mean_out))


def history_mean(df: DataFrame, by, col: str, order: str, tie: str, out: str = "history_mean",
                 prior_only: bool = True, fill: float | None = 0.0, skew_safe: bool = True,
                 partitions: int | None = None) -> DataFrame:
    """Mean of ``col`` over the group's earlier rows (T6: no target leak).

    ``prior_only=False`` reproduces the reference (whole-group mean, the
    row's own value included). ``skew_safe`` uses exclusive running sums of
    the value and of non-null counts (``grouped_running``) instead of a
    per-group window.
    """
    by = _cols(by)
    if not prior_only:
        j = attach_group_agg(df, by, {out: F.avg(col)})
    elif skew_safe:
        r = grouped_running(df, by, [order, tie], {"_hs": F.col(col), "_hn": F.col(col).isNotNull().cast("long")},
                            partitions, inclusive=False)
        j = r.withColumn(out, F.try_divide(F.col("_hs"), F.col("_hn").cast("double"))).drop("_hs", "_hn")
    else:
        w = Window.partitionBy(*by).orderBy(F.col(order), F.col(tie)) \
            .rowsBetween(Window.unboundedPreceding, -1)
        j = df.withColumn(out, F.avg(col).over(w))
    return j.na.fill({out: fill}) if fill is not None else j


def zscore_by(df: DataFrame, by, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - mean) / sd`` within group, sample sd; zero/undefined sd -> null."""
    by = _cols(by)
    g = df.groupBy(*by).agg(*[e for c in cols for e in (
        F.avg(c).alias(f"{c}__mu"), F.stddev_samp(c).alias(f"{c}__sd"))])
    j = join_on(df, g, by, "left")
    exprs = {f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"{c}__mu"),
                                          F.when(F.col(f"{c}__sd") != 0, F.col(f"{c}__sd")))
             for c in cols}
    return j.withColumns(exprs).drop(*[f"{c}__{s}" for c in cols for s in ("mu", "sd")])


def median_label(df: DataFrame, by, col: str, out: str = "label", null_label: int | None = 0) -> DataFrame:
    """1 when ``col >= `` the group's exact median, else 0.

    A null ``col`` gets ``null_label`` (T17: the reference gives 0); pass
    ``None`` to keep null.
    """
    by = _cols(by)
    med = quantiles_wide(df, [col], [0.5], by, names=["median"])
    j = join_on(df, med, by, "left")
    lab = F.when(F.col(col).isNull(), F.lit(null_label)) \
        .when(F.col(col) >= F.col(f"{col}_median"), F.lit(1)).otherwise(F.lit(0))
    return j.withColumn(out, lab.cast("int"))


def share_within(df: DataFrame, by, count_col: str, out: str = "share") -> DataFrame:
    """``count / sum(count)`` within group, on an already grouped result."""
    return df.withColumn(out, F.col(count_col) / F.sum(count_col).over(Window.partitionBy(*_cols(by))))
