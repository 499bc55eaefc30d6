"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of characters other than ASCII white space (fixed by the query contracts).
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row.

    A one-element ``transform`` binds the value to a lambda variable, so a
    costly array used many times (also inside other lambdas) is neither
    recomputed nor inlined again when a filter is pushed through.
    """
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """Words of a text (null: none) as an array of strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_of_id(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def ship(spark: SparkSession) -> None:
    """Make this library importable in Python workers, once per application.

    The driver hands Spark a zip of the library's own modules (as
    ``--py-files`` does); Spark distributes it and fetches it again for an
    executor that replaces a lost one.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sparkwright_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="sparkwright-py-")) / "sparkwright_py.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(path))
    sc._sparkwright_shipped = True


def text_slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of about ``chars`` characters each (a longer text alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
