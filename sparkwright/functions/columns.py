"""Projection helpers and scalar column functions.

Every function returns a ``Column`` or a ``DataFrame`` built from native
Spark expressions, so it stays inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- P: projections

def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns; names missing from ``df`` are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def sanitize_names(df: DataFrame, chars: str = " -/',") -> DataFrame:
    """Remove every character of ``chars`` from every column name."""
    pat = "[" + re.escape(chars) + "]"
    return df.toDF(*[re.sub(pat, "", c) for c in df.columns])


AGG_FUNCS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min,
    "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
    "nunique": F.count_distinct, "median": F.median,
}


def agg_exprs(spec: Mapping[str, Sequence[str] | str]) -> list[Column]:
    """P5: ``{col: [fn, ...]}`` to aggregate columns named ``col_fn``."""
    out = []
    for col, fns in spec.items():
        for fn in [fns] if isinstance(fns, str) else fns:
            out.append(AGG_FUNCS[fn](F.col(col)).alias(f"{col}_{fn}"))
    return out


def agg_named(df: DataFrame, by: str | Sequence[str], spec: Mapping[str, Sequence[str] | str]) -> DataFrame:
    """A4 + P5: one ``groupBy().agg()`` with flattened ``col_fn`` names."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*agg_exprs(spec))


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of numeric columns (booleans excluded)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def feature_cols(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """Columns of ``df`` not in ``exclude``, in schema order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def transpose_metrics(df: DataFrame, index_col: str) -> DataFrame:
    """P10: transpose a small metrics frame (models x metrics -> metrics x models).

    Only for results whose size is bounded by the number of models and
    metrics; Spark's ``transpose`` gathers the frame on the driver.
    """
    return df.transpose(F.col(index_col))


# ------------------------------------------------------------- N: null policies

def fill_null(df: DataFrame, mapping: Mapping[str, object]) -> DataFrame:
    """Fill nulls per column."""
    return df.na.fill(dict(mapping))


def fill_all(df: DataFrame, value) -> DataFrame:
    """Fill nulls in every column whose type accepts ``value``."""
    return df.na.fill(value)


def null_if(col: str | Column, sentinel) -> Column:
    """Sentinel value back to null."""
    return F.nullif(_c(col), F.lit(sentinel))


def remap(col: str | Column, mapping: Mapping[object, object], null_as=None,
          keep_unmapped: bool = True) -> Column:
    """Dictionary remap; ``null_as`` replaces a null input.

    Unmapped values pass through when ``keep_unmapped`` (pandas ``replace``),
    else become null (pandas ``map``, N5).
    """
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    if expr is None:
        expr = c
    elif keep_unmapped:
        expr = expr.otherwise(c)
    if null_as is not None:
        expr = F.when(c.isNull(), F.lit(null_as)).otherwise(expr)
    return expr


def map_labels(col: str | Column, mapping: Mapping[object, object]) -> Column:
    """Label map with no default: unmapped values become null."""
    return remap(col, mapping, keep_unmapped=False)


def flag(cond: Column, true_value=1, false_value=0) -> Column:
    """Binary flag with an else branch; a null condition takes the else."""
    return F.when(cond, F.lit(true_value)).otherwise(F.lit(false_value))


def bin_values(col: str | Column, edges: Sequence[float], labels: Sequence[str],
               default=None) -> Column:
    """``len(edges)+1`` bins: ``< e0``, ``[e0, e1]`` inclusive middle ..., ``> e_last``.

    With two edges this is the three-way split ``< lo``, ``lo..hi``
    inclusive, ``> hi``; a null or unmatched value takes ``default``.
    """
    assert len(labels) == len(edges) + 1
    c = _c(col)
    expr = F.when(c < edges[0], F.lit(labels[0]))
    for i in range(1, len(edges)):
        expr = expr.when(c.between(edges[i - 1], edges[i]), F.lit(labels[i]))
    expr = expr.when(c > edges[-1], F.lit(labels[-1]))
    return expr.otherwise(F.lit(default))


_OPS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def threshold_flag(col: str | Column, op: str, value) -> Column:
    """CASE WHEN col <op> value THEN 1 ELSE 0 END (int)."""
    return flag(_OPS[op](_c(col), F.lit(value))).cast("int")


def to_class(p: str | Column, threshold: float = 0.5, op: str = ">") -> Column:
    """Probability to class; the comparison operator is explicit."""
    return flag(_OPS[op](_c(p), F.lit(threshold))).cast("int")


# ------------------------------------------------------------------ N: dates

def date_parts(col: str | Column) -> tuple[Column, Column]:
    """(year, month) of a date or timestamp."""
    c = _c(col)
    return F.year(c), F.month(c)


def parse_date_parts(col: str | Column, fmt: str = "M d, yyyy") -> tuple[Column, Column]:
    """(year, month) of a text date; bad text gives null (no UDF)."""
    d = F.try_to_timestamp(_c(col), F.lit(fmt)).cast("date")
    return F.year(d), F.month(d)


def age(birth: str | Column, as_of) -> Column:
    """``year(as_of) - year(birth)``; ``as_of`` is a parameter."""
    return F.year(F.lit(as_of).cast("date")) - F.year(_c(birth))


def whole_days(end: str | Column, start: str | Column) -> Column:
    """Floored whole days of ``end - start`` (T12), as bigint.

    Two hours across midnight is 0 days; two hours back is -1 day. This is
    pandas' ``Timedelta.days``, not ``datediff`` (calendar days).
    """
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def days_since_epoch(epoch_seconds: str | Column, as_of) -> Column:
    """Calendar days from an epoch-seconds instant to ``as_of``."""
    ts = F.timestamp_seconds(_c(epoch_seconds))
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(ts))


def days_since(ts: str | Column, as_of) -> Column:
    """N14 for a timestamp column: calendar days to ``as_of``."""
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(_c(ts)))


def decay(days: str | Column, rate: float = 0.01) -> Column:
    """``exp(-rate * days)``."""
    return F.exp(F.lit(-rate) * _c(days))


def parse_percent(col: str | Column) -> Column:
    """``"1.25%"`` -> 0.0125; bad text -> null."""
    return F.try_divide(F.regexp_replace(_c(col), "%", "").try_cast("double"), F.lit(100.0))


def years_before(col: str | Column, year: int = 2023) -> Column:
    """``year - col`` with the year as a parameter."""
    return F.lit(year) - _c(col)


def diff(a: str | Column, b: str | Column) -> Column:
    """``a - b`` (interest = total due - principal)."""
    return _c(a) - _c(b)


def odds(coef: str | Column) -> tuple[Column, Column]:
    """(odds ratio, percent change of odds) of a log-odds coefficient."""
    o = F.exp(_c(coef))
    return o, (o - F.lit(1.0)) * F.lit(100.0)


def positive_prob(col: str | Column, index: int = 1) -> Column:
    """Element ``index`` of an ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(_c(col))[index]


def null_count_row(cols: Sequence[str]) -> Column:
    """Number of null cells in the row over ``cols`` (int)."""
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
