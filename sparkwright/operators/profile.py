"""Profiling and aggregation operators.

Design rules used throughout:
- one ``groupBy().agg()`` per result (map-side partial aggregation, one
  shuffle of partial states, not of rows);
- totals for shares come from a scalar subquery (``DataFrame.scalar``),
  executed once and inlined, so there is no cross join and no driver
  round trip of data;
- exact quantiles come from ``quantiles`` (bounded state per task);
- wide-to-long reshapes use ``inline`` of a literal struct array (``stack``),
  never a driver loop over columns that runs one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import join_on

from .quantiles import quantiles_wide


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def long_from_wide(df: DataFrame, keep: Sequence[str], items: dict[str, dict[str, Column]],
                   name_col: str = "column") -> DataFrame:
    """Reshape: one output row per ``items`` key, fields from the given columns."""
    structs = [F.struct(F.lit(k).alias(name_col), *[c.alias(f) for f, c in fields.items()])
               for k, fields in items.items()]
    return df.select(*keep, F.inline(F.array(*structs)))


# ------------------------------------------------------------------ counts

def value_counts(df: DataFrame, col: str | Sequence[str], normalize: bool = False,
                 dropna: bool = False, count_col: str = "count", share_col: str = "share") -> DataFrame:
    """A1/A2: rows per value (null is a value unless ``dropna``)."""
    cols = _cols(col)
    src = df.na.drop(subset=cols) if dropna else df
    out = src.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_col))
    if normalize:
        total = out.agg(F.sum(count_col)).scalar()   # over the grouped result, not the rows again
        out = out.withColumn(share_col, out[count_col] / total)
    return out


def summarise_by(df: DataFrame, by: str | Sequence[str], cols: Sequence[str],
                 fns: Sequence[str] = ("min", "max", "mean")) -> DataFrame:
    """A3: ``col_fn`` aggregates for a column list, one pass."""
    from ..functions.columns import agg_exprs
    return df.groupBy(*_cols(by)).agg(*agg_exprs({c: list(fns) for c in cols}))


def group_mean(df: DataFrame, by, col: str, out: str | None = None) -> DataFrame:
    """Mean of ``col`` per group."""
    return df.groupBy(*_cols(by)).agg(F.avg(col).alias(out or f"{col}_mean"))


def group_std(df: DataFrame, by, col: str, out: str | None = None) -> DataFrame:
    """Sample standard deviation per group (null for one row)."""
    return df.groupBy(*_cols(by)).agg(F.stddev_samp(col).alias(out or f"{col}_std"))


def group_count_nonnull(df: DataFrame, by, col: str, out: str | None = None) -> DataFrame:
    """Non-null count of ``col`` per group."""
    return df.groupBy(*_cols(by)).agg(F.count(col).alias(out or f"{col}_count"))


def sum_all(df: DataFrame, by, exclude: Sequence[str] = ()) -> DataFrame:
    """Sum of every numeric column per group."""
    from ..functions.columns import numeric_cols
    by = _cols(by)
    cols = numeric_cols(df, exclude=[*by, *exclude])
    return df.groupBy(*by).agg(*[F.sum(c).alias(f"{c}_sum") for c in cols])


# ---------------------------------------------------------------- describe

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per numeric column (long form).

    Quartiles are exact (linear interpolation), moments in one aggregate.
    """
    from ..functions.columns import numeric_cols
    cols = list(cols) if cols else numeric_cols(df)
    mom = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
        F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std"),
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    qs = quantiles_wide(df, cols, DESCRIBE_PROBS, names=["q25", "q50", "q75"])
    # the quartile row is attached as a scalar subquery (no join)
    qst = qs.select(F.struct(*qs.columns).alias("s")).scalar()
    wide = mom.withColumns({c: qst[c] for c in qs.columns})
    items = {c: {"count": F.col(f"{c}__count"), "mean": F.col(f"{c}__mean"), "std": F.col(f"{c}__std"),
                 "min": F.col(f"{c}__min"), "q25": F.col(f"{c}_q25"), "q50": F.col(f"{c}_q50"),
                 "q75": F.col(f"{c}_q75"), "max": F.col(f"{c}__max")} for c in cols}
    return long_from_wide(wide, [], items)


def value_key(c: Column) -> list[Column]:
    """128 bits of hash that stand for a value in counts, however long it is (two
    of n values meet with probability n * n / 2 ** 129)."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: count, unique, top, freq per column, values as text (long form).

    ``top`` is the most frequent non-null value; ties go to the smallest
    text. Values are counted by key (``value_key``), so texts are not shuffled; the
    keys that are most frequent are joined back for their text. A column whose
    values are all different needs its least text only.
    """
    cols = list(cols) if cols else df.columns
    cells = long_from_wide(df, [], {c: {"value": F.col(c).cast("string")} for c in cols}).filter(F.col("value").isNotNull())
    h1, h2 = value_key(F.col("value"))
    cells = cells.select("column", "value", h1.alias("h1"), h2.alias("h2"))
    counts = cells.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    per_col = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"))
    often = counts.join(per_col.filter(F.col("freq") > 1).select("column", F.col("freq").alias("n")), ["column", "n"])
    top = cells.join(often.select("column", "h1", "h2"), ["column", "h1", "h2"]).groupBy("column").agg(F.min("value").alias("_top"))
    least = cells.groupBy("column").agg(F.min("value").alias("_least"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(per_col.join(least, "column").join(top, "column", "left"), "column", "left") \
        .select("column", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
                F.when(F.col("freq") > 1, F.col("_top")).otherwise(F.col("_least")).alias("top"),
                F.col("freq").cast("long").alias("freq"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column (long form: column, nulls, share)."""
    cols = list(cols) if cols else df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols])
    items = {c: {"nulls": F.col(f"{c}__nulls"),
                 "share": F.try_divide(F.col(f"{c}__nulls").cast("double"), F.col("_rows"))} for c in cols}
    return long_from_wide(agg, [], items)


def drop_sparse_cols(df: DataFrame, max_null_share: float, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns whose null share exceeds ``max_null_share``.

    The decision needs one number per column on the driver (p values).
    """
    shares = null_counts(df, cols).select("column", "share").collect()
    return df.drop(*[r["column"] for r in shares if r["share"] is not None and r["share"] > max_null_share])


def nunique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (long form); texts count by key (``value_key``)."""
    cols = list(cols) if cols else df.columns

    def distinct(c: str) -> Column:
        if approx:
            return F.approx_count_distinct(c)
        if not isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)):
            return F.count_distinct(c)
        h1, h2 = value_key(F.col(c))
        return F.count_distinct(F.when(F.col(c).isNotNull(), h1), h2)

    agg = df.agg(*[distinct(c).alias(f"{c}__nu") for c in cols])
    return long_from_wide(agg, [], {c: {"nunique": F.col(f"{c}__nu")} for c in cols})


def quantile(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (see ``quantiles``)."""
    return quantiles_wide(df, cols, probs, by)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form (a, b, corr).

    One aggregate holds all p*(p-1)/2 co-moment states; the diagonal is 1.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    structs = []
    for a, b in pairs:
        structs += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr")),
                    F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}__{b}").alias("corr"))]
    structs += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in cols]
    return agg.select(F.inline(F.array(*structs)))


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True, margin_label: str = "All") -> DataFrame:
    """Counts of (a, b) with row/column/grand totals (long form).

    ``cube`` produces all four grouping sets in one aggregate; totals are
    labelled ``margin_label`` (values are cast to text for that).
    """
    if not margins:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    g = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return g.select(F.when(F.col("_ga") == 1, F.lit(margin_label)).otherwise(F.col(a).cast("string")).alias(a),
                    F.when(F.col("_gb") == 1, F.lit(margin_label)).otherwise(F.col(b).cast("string")).alias(b),
                    "n")


def crosstab_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) and their share within ``a``.

    The window runs over the grouped result (one row per cell), not raw rows.
    """
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", g["n"] / F.sum("n").over(Window.partitionBy(a)))


def rate(df: DataFrame, cond: Column, by: Sequence[str] = (), out: str = "rate") -> DataFrame:
    """Share of rows where ``cond`` holds (null counts as false)."""
    e = F.avg(F.coalesce(cond, F.lit(False)).cast("double")).alias(out)
    return df.groupBy(*by).agg(e) if by else df.agg(e)


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram; the maximum falls in the last bin.

    Output: bin (1..bins), lo, hi, n, plus the column's mean and exact
    median for reference lines. Edges come from scalar subqueries.
    """
    c = F.col(col).cast("double")
    # min, max and mean in one scalar subquery (one pass, reused by every reference)
    st = df.agg(F.struct(F.min(c).alias("mn"), F.max(c).alias("mx"), F.avg(c).alias("mean"))).scalar()
    mn, mx, mean = st["mn"], st["mx"], st["mean"]
    width = (mx - mn) / F.lit(bins)
    b = F.least(F.floor((c - mn) / (mx - mn) * F.lit(bins)) + 1, F.lit(bins)).cast("int")
    b = F.when(mx == mn, F.lit(1)).otherwise(b)
    h = df.filter(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    median = quantiles_wide(df, [col], [0.5], names=["median"]).scalar()
    return h.select("bin", (mn + (F.col("bin") - 1) * width).alias("lo"), (mn + F.col("bin") * width).alias("hi"),
                    "n", mean.alias("mean"), median.alias("median"))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), whisker: float = 1.5) -> DataFrame:
    """Quartiles, IQR fences, whisker ends and outlier counts per group."""
    by = list(by)
    q = quantiles_wide(df, [col], [0.25, 0.5, 0.75], by, names=["q1", "median", "q3"]) \
        .withColumnsRenamed({f"{col}_q1": "q1", f"{col}_median": "median", f"{col}_q3": "q3"})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower_fence", F.col("q1") - F.lit(whisker) * F.col("iqr")) \
        .withColumn("upper_fence", F.col("q3") + F.lit(whisker) * F.col("iqr"))
    v = F.col(col).cast("double")
    qcols = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    if by:
        base = join_on(df, q, by)
    else:
        # one row of quartiles: attached as a scalar subquery (no join)
        qst = q.select(F.struct(*qcols).alias("s")).scalar()
        base = df.withColumns({c: qst[c] for c in qcols})
    # the quartile columns are constant within a group: grouping by them keeps
    # them in one pass (no second join back to the quartile table)
    return base.groupBy(*by, *qcols).agg(
        F.count(v).alias("n"),
        F.min(F.when(v >= F.col("lower_fence"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("upper_fence"), v)).alias("whisker_hi"),
        F.count_if(v < F.col("lower_fence")).alias("n_low"),
        F.count_if(v > F.col("upper_fence")).alias("n_high"))


def ceil_fraction(n: Column, frac: float) -> Column:
    """``ceil(n * frac)`` with ``frac`` as an exact decimal fraction (bigint)."""
    f = Fraction(str(frac))
    return _ceil_div(n * F.lit(f.numerator), f.denominator)


def _ceil_div(a: Column, d: int) -> Column:
    # ceil(a / d) for a >= 0: the numerator is made a multiple of d first,
    # so the quotient is exact
    b = a + F.lit(d - 1)
    return ((b - F.pmod(b, F.lit(d))) / F.lit(d)).cast("long")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class (T28: not swapped)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    t = g.agg(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()   # totals of the grouped result
    return g.withColumn(out, t["n"] / (t["k"] * F.col("n_c")))


def attach_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A23 joined back to rows for ``weightCol``; a null label is a class."""
    return join_on(df, class_weights(df, label, out).select(label, out), [label], "left")


def freq_split(df: DataFrame, col: str, min_count: int = 50) -> DataFrame:
    """Value counts with a ``frequent`` flag (count >= min_count)."""
    return value_counts(df, col, dropna=True).withColumn("frequent", (F.col("count") >= min_count).cast("int"))
