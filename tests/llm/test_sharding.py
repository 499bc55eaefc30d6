from __future__ import annotations

import zlib
from collections import Counter

from llm_support import clash, docs, no_docs, sf  # noqa: F401
from pyspark.sql import functions as F

from sparkwright.llm import catalog, sharding


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789, *range(1000, 1040)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 16, 1000):
        got = df.select("k", sharding.jump_state(F.col("k"), n)["b"].alias("b")).collect()
        assert all(r.b == jump(r.k & 0xFFFFFFFFFFFFFFFF, n) for r in got)


def check(rows, docs, n):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert all(0 <= r.shard < n and r.grown_shard in (r.shard, n) and r.law == "key" for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_query(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(catalog.op1_sharding(spark, sf).collect(), docs, 16)


def test_grown_shard_is_the_shard_of_one_more(docs):
    a = {r.doc_id: r.grown_shard for r in sharding.shard_rows(docs, 5).collect()}
    assert a == {r.doc_id: r.shard for r in sharding.shard_rows(docs, 6).collect()}


def test_odd_rows_and_many_slices(docs, no_docs):
    odd = [(r.doc_id, r.text or "") for r in docs.collect()]
    wide = clash(docs, "shard", "slot", "_slice", "size", "law", "_s", "_n")
    check(sharding.shard_rows(wide, 3, rows_per_slice=1).collect(), odd, 3)
    assert sharding.shard_rows(no_docs, 4).collect() == []


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
