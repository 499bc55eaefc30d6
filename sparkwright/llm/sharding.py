"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard is a pure function of the key and the number of shards: no
ring table, no state. Going from n to n + 1 shards moves about 1/(n + 1) of
the keys, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

# Fixed values of the published algorithm: multiplier of its 64-bit linear
# congruential generator, as high and low 32 bits.
LCG_HIGH, LCG_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK32 = 0xFFFFFFFF
STEPS_PER_BLOCK = 8
ROWS_PER_SLICE = 4096


def _lcg(hi: Column, lo: Column) -> Column:
    """``key * multiplier + 1`` modulo 2**64 on 32-bit halves held in longs.

    The halves are cut once more into 16 bits, so no product or sum passes
    2**63 and the arithmetic is also right under ANSI overflow checks.
    """
    p0 = lo.bitwiseAND(0xFFFF) * LCG_LOW
    p1 = F.shiftright(lo, 16) * LCG_LOW
    low = p0 + F.shiftleft(p1.bitwiseAND(MASK32), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftleft(F.shiftright(p1, 32), 16)
    hi_lo = (hi.bitwiseAND(0xFFFF) * LCG_LOW).bitwiseAND(MASK32) \
        + F.shiftleft((F.shiftright(hi, 16) * LCG_LOW).bitwiseAND(0xFFFF), 16)
    high = carry.bitwiseAND(MASK32) + hi_lo.bitwiseAND(MASK32) + (lo * LCG_HIGH).bitwiseAND(MASK32)
    return F.struct(high.bitwiseAND(MASK32).alias("hi"), low.bitwiseAND(MASK32).alias("lo"))


def _jump(s: Column) -> Column:
    return let(_lcg(s["hi"], s["lo"]), lambda k: F.struct(
        k["hi"].alias("hi"), k["lo"].alias("lo"), s["j"].alias("b"),
        ((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(k["hi"], 1) + 1).cast("double"))).cast("long").alias("j")))


def jump_state(key: Column, n_shards: int) -> Column:
    """Struct (b, j) of the jump sequence of a 64-bit ``key`` (long): ``b`` is
    its shard among ``n_shards``, ``j >= n_shards`` the bucket it jumps to next.

    Needs about ln(n) jumps, at most n; the steps come in blocks that are
    empty once the key has landed, so many shards cost little.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(MASK32).alias("lo"),
                     F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    step = lambda s, _: F.when(s["j"] < n_shards, _jump(s)).otherwise(s)
    none = F.array().cast("array<int>")
    block = lambda s, _: F.aggregate(
        F.when(s["j"] < n_shards, F.sequence(F.lit(1), F.lit(min(n_shards, STEPS_PER_BLOCK)))).otherwise(none), s, step)
    blocks = -(-n_shards // STEPS_PER_BLOCK)
    return F.aggregate(F.sequence(F.lit(1), F.lit(blocks)), start, block)


def shard_rows(df: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text",
               rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` depends on the key and ``n_shards`` alone (law ``key``);
    ``grown_shard`` is the shard with one shard more, read off the same jump
    sequence. ``slot`` numbers the rows of a shard from 0 without gaps. No
    task holds a shard: a shard is cut into slices by a hash of the row, as
    many as the row count asks for, numbered inside each slice and offset by
    the row counts of the slices before.

    Nulls: a null key is one key (its rows share a shard); a null text has
    size 1 and the checksum of the empty text. Repeated rows each get a slot;
    only rows equal in key and text share a slice. An empty table gives no
    rows. Other columns of ``df`` are not read.
    """
    n_rows = df.count()
    n_slices = max(1, -(-n_rows // (n_shards * rows_per_slice)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(key_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), jump_state(F.xxhash64(F.col(key_col)), n_shards).alias("_s"))
    rows = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_s.b").cast("int").alias("shard"),
        F.when(F.col("_s.j") == n_shards, F.lit(n_shards)).otherwise(F.col("_s.b")).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(n_slices)).alias("_slice"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_slice").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(offsets, ["shard", "_slice"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"),
        "grown_shard")


def write_shards(df: DataFrame, path: str, n_shards: int, key_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write ``df`` as Parquet, one folder per shard; a shard is written by
    ``files_per_shard`` tasks, so its size does not bind it to one task."""
    shard = jump_state(F.xxhash64(F.col(key_col)), n_shards)["b"].cast("int")
    salted = df.withColumns({"shard": shard, "_file": F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))})
    salted.repartition(n_shards * files_per_shard, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
