"""Exact quantiles by bin selection, with bounded state.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so one hot group (a third of all rows) would land in a
single task's memory. Here all groups, columns and ranks are narrowed
together, a count table per round:

1. every value is counted in its bin on a logarithmic scale, an increasing
   function of the value, so running counts tell which bin holds which rank.
   Each bin keeps its count, least and largest value;
2. a bin with a rank in it and more than one value is counted again: by value
   when it holds few rows, else in ``BINS`` equal parts of its range. Each
   round narrows a range by ``BINS``, so four rounds reach single doubles whatever
   the data; a table below ``BINS`` rows a bin is done after the second.

A task orders the bins of one group, column and range (``BINS + 1`` at most),
never raw values. Bins are combined on the map side. Rounds run while the plan
is built, as many as the data need; each reads the input once.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .keys import join_on

BINS = 65_536
BROADCAST_RANGES = 100_000      # ranges that are broadcast to the values at most; more are joined by group and bin
PER_OCTAVE = 16      # bins of the first round for each doubling of a value


def _value_type(df: DataFrame, cols: Sequence[str]) -> str:
    """``bigint`` when every column is integral (values above 2**53 stay exact), else ``double``."""
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = df.select(*[F.col(c) for c in cols]).schema.fields
    return "bigint" if all(isinstance(f.dataType, integral) for f in kinds) else "double"


def _log_bin(v: Column) -> Column:
    """An increasing function of the value with about 70,000 results; NaN is above all."""
    d = v.cast("double")
    step = F.floor(F.least(F.log2(F.abs(d)) * PER_OCTAVE, F.lit(30_000.0))) + 40_000
    return F.when(F.isnan(d), F.lit(10**6)).when(d == 0, F.lit(0)).when(d > 0, step).otherwise(-step).cast("long")


def _range_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Part of ``lo`` to ``hi`` that holds ``v``: 0 at ``lo``, ``bins`` at ``hi``, increasing between."""
    return F.floor((v - lo).cast("double") / (hi - lo).cast("double") * bins)


def _ranks(n: Column, p: float, mode: str) -> tuple[Column, Column]:
    """0-based ranks of the value and of its neighbour (the next one, or the
    one before in rank mode); a neighbour that is not needed has rank -1."""
    if mode == "rank":
        f = Fraction(str(p))
        up = n * F.lit(f.numerator).cast("long") + (f.denominator - 1)
        k = ((up - F.pmod(up, F.lit(f.denominator))) / f.denominator).cast("long") - 1      # ceil, exact
        return k, k - 1
    h = (n - 1).cast("double") * F.lit(float(p))
    k = F.floor(h).cast("long")
    return k, F.when(h > k, k + 1).otherwise(-1)


def _hits(probs: Sequence[float], mode: str, n: Column, below: Column, count: Column) -> Column:
    """The wanted ranks (probability, value or neighbour, rank) that a bin holds; those of an empty column, once."""
    wanted = []
    for pi, p in enumerate(probs):
        for t, r in enumerate(_ranks(n, p, mode)):
            wanted.append(F.when((n == 0) | ((r >= below) & (r < below + count)), F.struct(
                F.lit(pi).alias("_pi"), F.lit(t).alias("_t"), r.cast("long").alias("_r"))))
    return F.filter(F.array(*wanted), lambda x: x.isNotNull())


def _before(keys: Sequence[str], order: str) -> Column:
    """Values in the bins before this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_c").over(w), F.lit(0).cast("long"))


def quantile_long(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                  by: Sequence[str] = (), mode: str = "cont", bins: int | None = None) -> DataFrame:
    """Exact quantiles in long form: ``by + [_ci, _pi, n, value, value_prev]``.

    ``_ci``/``_pi`` index ``cols``/``probs``. Nulls are ignored; a group
    whose column is all null gets ``n = 0`` and a null value. NaN is above
    all numbers. Integral columns are compared as integers. A null key is a group.

    ``mode="cont"``: linear interpolation at ``(n-1)*p``.
    ``mode="rank"``: the value at 1-based position ``ceil(p*n)`` with ``p``
    read as an exact decimal fraction; ``value_prev`` is the value one
    position earlier (equal values there mean that position is inside a tie).

    ``df`` is read once a round: pass a scan or a checkpointed frame.
    """
    by, cols, probs = list(by), list(cols), list(probs)
    if mode == "rank" and min(probs, default=1) <= 0:
        raise ValueError("positions start at 1: a rank needs p > 0")
    key = by if by else ["_qk"]
    bins = bins or BINS
    kind = _value_type(df, cols)
    base = df if by else df.withColumn("_qk", F.lit(0))
    vals = base.select(*key, *[F.col(c).cast(kind).alias(f"_v{ci}") for ci, c in enumerate(cols)])
    counts = [F.count("_v").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    place = [*key, "_ci", "_pi", "_t", "_n", "_r", "_log", "_below", "_c", "_lo", "_hi"]

    cells = vals.select(*key, F.inline(F.array(*[
        F.struct(F.lit(ci).alias("_ci"), _log_bin(F.col(f"_v{ci}")).alias("_log"), F.col(f"_v{ci}").alias("_v"))
        for ci in range(len(cols))])))
    table = cells.groupBy(*key, "_ci", "_log").agg(*counts)
    table = table.withColumns({"_n": F.sum("_c").over(Window.partitionBy(*key, "_ci")), "_below": _before([*key, "_ci"], "_log")})
    # A null value's bin is null and holds no count: it only keeps an all-null column in the table.
    state = table.select("*", F.inline(_hits(probs, mode, F.col("_n"), F.col("_below"), F.col("_c")))).select(*place)
    state = cut_lineage(state)

    while n_open := (open_ := state.where(F.col("_lo") < F.col("_hi"))).count():
        # A range lies inside one bin of the first round, by which values meet it.
        ranges = open_.groupBy(*key, "_ci", "_log", F.col("_lo").alias("_at")).agg(F.max("_hi").alias("_to"), F.max("_c").alias("_held"))
        met = join_on(cells, F.broadcast(ranges) if n_open <= BROADCAST_RANGES else ranges, [*key, "_ci", "_log"])
        part = F.when(F.col("_held") <= bins, F.col("_v")).otherwise(_range_bin(F.col("_v"), F.col("_at"), F.col("_to"), bins).cast(kind))
        met = met.where(F.col("_v").between(F.col("_at"), F.col("_to"))).withColumn("_bin", part)
        table = met.groupBy(*key, "_ci", "_at", "_bin").agg(*counts).withColumn("_before", _before([*key, "_ci", "_at"], "_bin"))
        asked = open_.select(*key, "_ci", "_pi", "_t", "_n", "_r", "_log", F.col("_below").alias("_under"), F.col("_lo").alias("_at"))
        found = join_on(asked, table, [*key, "_ci", "_at"]).withColumn("_below", F.col("_under") + F.col("_before"))
        found = found.where((F.col("_r") >= F.col("_below")) & (F.col("_r") < F.col("_below") + F.col("_c"))).select(*place)
        state = cut_lineage(state.where(~F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False))).unionByName(found))

    picked = state.groupBy(*key, "_ci", "_pi").agg(
        F.max("_n").alias("n"), F.max(F.when(F.col("_t") == 0, F.col("_lo"))).alias("_vk"),
        F.max(F.when(F.col("_t") == 1, F.col("_lo"))).alias("_other"))
    if mode == "rank":
        out = picked.select(*key, "_ci", "_pi", "n", F.col("_vk").alias("value"), F.col("_other").alias("value_prev"))
    else:
        h = (F.col("n") - 1).cast("double") * F.array(*[F.lit(float(p)) for p in probs])[F.col("_pi")]
        frac = h - F.floor(h)
        value = F.when(frac == 0, F.col("_vk").cast("double")) \
            .otherwise(F.col("_vk") + frac * (F.col("_other").cast("double") - F.col("_vk")))
        out = picked.select(*key, "_ci", "_pi", "n", value.alias("value"), F.lit(None).cast(kind).alias("value_prev"))
    return out if by else out.drop("_qk")


def _tag(p: float) -> str:
    s = f"{p:g}".replace("0.", "").replace(".", "_")
    return s


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles, one row per group: columns ``{col}_{name}``.

    ``names`` label the probabilities (default ``q25`` style tags).
    """
    by = list(by)
    names = list(names) if names else [f"q{_tag(p)}" for p in probs]
    long = quantile_long(df, cols, probs, by)
    aggs = [F.max(F.when((F.col("_ci") == ci) & (F.col("_pi") == pi), F.col("value"))).alias(f"{c}_{names[pi]}")
            for ci, c in enumerate(cols) for pi in range(len(probs))]
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)


def quantile_scalar(df: DataFrame, col: str, p: float):
    """One exact quantile as a scalar-subquery ``Column`` (no driver collect)."""
    return quantiles_wide(df, [col], [p], names=["q"]).scalar()
