"""Registry of catalogue queries: a Spark builder and its DuckDB oracle SQL.

Every query reads the given tables (or data Spark derives from them) in
full; none runs on made-up input. Doubles are rounded to 6 places on both
sides so the value comparison is not sensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL (or None)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, tie_safe_sql(sql) if sql else None)
        return fn
    return deco


# Rounding boundary nudge: decimal data makes exact half-way values common
# (a mean of cents), and two engines summing in different orders may land
# on either side of such a tie. Shifting the boundary by 1e-9 puts it where
# decimal data does not fall, on both sides alike.
ROUND_NUDGE = 1e-9


def tie_safe_sql(sql: str) -> str:
    """Apply the same nudge to every ``round(`` of a double in oracle SQL."""
    return sql.replace("round(", f"round({ROUND_NUDGE} + ")


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (top level) to ``digits`` places."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs[f.name] = F.round(F.lit(ROUND_NUDGE) + F.col(f.name).cast("double"), digits)
    return df.withColumns(exprs) if exprs else df
