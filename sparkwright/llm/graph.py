"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
                                           for a, b in (("u", "v"), ("v", "u"))])))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each vertex to the least of them: the greater
    neighbours (large star) or the vertex and its smaller ones (small star)."""
    way = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = way.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = way.join(least, "u")
    out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every vertex hangs on one root, or is one."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("x"), F.lit(int(c == "u")).alias("hangs")) for c in "uv"])))
    seen = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("only"))
    return not seen.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("only") == 0))).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v): the root is the least vertex of its component.

    Each round is written to the checkpoint folder; only one number a round
    comes to the driver, to see that the edges are stars around the least
    vertices. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut_lineage(edges.where(F.col("u") != F.col("v")).distinct())
    while not _is_forest_of_stars(edges):
        edges = cut_lineage(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
