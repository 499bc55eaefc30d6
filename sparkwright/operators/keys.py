"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null equals null, as it does in ``groupBy`` and in window partitions.

    Columns: those of ``left``, then those of ``right`` without the keys.
    """
    other = {k: f"_right_{k}" for k in keys}
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(right.withColumnsRenamed(other), cond, how).drop(*other.values())
