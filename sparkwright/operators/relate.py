"""Joins, overlap counts and lookups (J1-J10, N2 in J5).

All joins are equi-joins; Spark picks the physical strategy. Explicit
``broadcast`` is used only for sides whose size is bounded by
construction (a fixed lexicon, a top-N level list); for every other side
AQE measures the shuffle output at runtime and converts to a broadcast
join below ``spark.sql.adaptive.autoBroadcastJoinThreshold``, or splits
skewed partitions of a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import MAX_LITERAL


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def join_inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Inner equi-join on one or more shared key names."""
    return left.join(right, _cols(on), "inner")


def join_left(left: DataFrame, right: DataFrame, on=None, left_on: str | None = None,
              right_on: str | None = None, fill: Mapping | None = None) -> DataFrame:
    """Left equi-join; with different key names the right key is renamed."""
    if on is None:
        right = right.withColumnRenamed(right_on, left_on)
        on = left_on
    out = left.join(right, _cols(on), "left")
    return out.na.fill(dict(fill)) if fill else out


def wide_row(base: DataFrame, sides: Sequence[tuple[DataFrame, str | Sequence[str], object]]) -> DataFrame:
    """Chain of left joins; each side's fill (N2) is applied right after
    its join, before the next side joins (T14's order)."""
    out = base
    for side, on, fill in sides:
        out = out.join(side, _cols(on), "left")
        if fill is not None:
            cols = [c for c in side.columns if c not in _cols(on)]
            if isinstance(fill, Mapping):
                out = out.na.fill(dict(fill))
            else:
                out = out.na.fill(fill, subset=cols)
    return out


def overlap_count(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None) -> Column:
    """Number of distinct ``a`` keys present in ``b`` (scalar subquery)."""
    key_b = key_b or key_a
    ka = a.select(F.col(key_a).alias("_k")).distinct()
    kb = b.select(F.col(key_b).alias("_k"))
    return ka.join(kb, "_k", "left_semi").agg(F.count(F.lit(1))).scalar()


def zip_by_key(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Column-wise combination of frames by an explicit row key (never position)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "inner")
    return out


def lookup_tokens(df: DataFrame, tokens: str, lexicon: DataFrame | Mapping[str, object],
                  out: str = "mapped", keep_unmatched: bool = False, key: str | None = None) -> DataFrame:
    """Map each token through a lexicon.

    A small lexicon (a mapping) becomes a literal map: every row is mapped
    in place with ``transform`` + ``element_at``, with no explode and no
    shuffle. A lexicon DataFrame (any size) goes through explode, a join
    (broadcast by AQE if small) and a regroup by row position; pass the
    row key as ``key`` (otherwise a generated id is attached and the tagged
    input is checkpointed, so both branches see the same ids).
    """
    if isinstance(lexicon, Mapping):
        if len(lexicon) > MAX_LITERAL:
            raise ValueError(f"{len(lexicon)} words: pass a table for more than {MAX_LITERAL}")
        m = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(v))])
        mapped = F.transform(F.col(tokens), lambda t: F.coalesce(
            F.try_element_at(m, t), t if keep_unmatched else F.lit(None)))
        if not keep_unmatched:
            mapped = F.filter(mapped, lambda x: x.isNotNull())
        return df.withColumn(out, mapped)
    lk, lv = lexicon.columns[:2]
    rid = key or "_rid"
    # a generated id must not be recomputed differently in the two branches
    # below: without a key, the tagged input is checkpointed once
    base = df if key else cut_lineage(df.withColumn(rid, F.monotonically_increasing_id()))
    ex = base.select(rid, F.posexplode(F.col(tokens)).alias("_pos", lk))
    how = "left" if keep_unmatched else "inner"
    j = ex.join(lexicon, lk, how)
    mapped_val = F.coalesce(F.col(lv), F.col(lk)) if keep_unmatched else F.col(lv)
    agg = j.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("_pos", mapped_val.alias("_v")))).alias("_s"))
    agg = agg.select(rid, F.transform("_s", lambda s: s["_v"]).alias(out))
    out_df = base.join(agg, rid, "left").withColumn(out, F.coalesce(F.col(out), F.array()))
    return out_df if key else out_df.drop(rid)
