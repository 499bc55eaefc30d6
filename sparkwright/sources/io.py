"""Sources and sinks.

Readers return lazy DataFrames: filters and projections applied later are
pushed into the scan (Parquet) by Catalyst. CSV readers take an explicit
schema whenever one is known; inference costs an extra pass over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.split import hash_bucket
from ..session import save_intermediate


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view by name."""
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (column pruning and filter pushdown apply)."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             encoding: str | None = None, date_cols: Sequence[str] = (), date_format: str | None = None,
             sep: str = ",") -> DataFrame:
    """CSV with a header.

    ``schema`` (preferred at scale) or type inference; ``encoding`` such as
    ``ISO-8859-1`` (S3); ``date_cols`` parsed to timestamps, with
    ``date_format`` when given; text that does not parse becomes null (S4).
    """
    r = spark.read.option("header", header).option("sep", sep)
    if encoding:
        r = r.option("encoding", encoding)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    df = r.csv(path)
    for c in date_cols:
        txt = F.col(c).cast("string")
        ts = F.try_to_timestamp(txt, F.lit(date_format)) if date_format else F.try_to_timestamp(txt)
        df = df.withColumn(c, ts)
    return df


def checkpoint_table(df: DataFrame, name: str) -> DataFrame:
    """Save an intermediate under the shared checkpoint folder and reload it (T20: written before it is read)."""
    return save_intermediate(df, name)


def profile_shape(df: DataFrame) -> dict:
    """Rows, columns and types (one count job; types from the schema)."""
    return {"rows": df.count(), "columns": len(df.columns),
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields}}


def preview(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows, in a stated order when given (a limit is the feature)."""
    return (df.orderBy(*order) if order else df).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """O2: last ``n`` rows by an explicit key (descending sort, then limit)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sample(df: DataFrame, frac: float, seed: int = 0, key: str | None = None, method: str = "xxhash") -> DataFrame:
    """Sample without replacement (the sampling operator itself).

    With ``key`` a row is in by the hash of its key, to one in 10,000
    (``method`` as in ``split.hash_bucket``): the same rows on every run, whatever the
    partitions; a null key is one key. Without, Spark's Bernoulli sample.
    """
    if key is None:
        return df.sample(withReplacement=False, fraction=frac, seed=seed)
    return df.where(hash_bucket(key, 10_000, seed, method) < round(frac * 10_000))
