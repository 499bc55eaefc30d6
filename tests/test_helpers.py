"""Schema helpers and small operators without a catalogue query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkwright.functions import columns as C
from sparkwright.operators import profile as P
from sparkwright.operators.relate import lookup_tokens


def test_p4_sanitize_names(spark):
    df = spark.createDataFrame([(1, 2)], "`type_ SUV-x` int, `it's/a,b` int")
    assert C.sanitize_names(df).columns == ["type_SUVx", "itsab"]


def test_p5_agg_named(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 3.0)], "k string, v double")
    r = C.agg_named(df, "k", {"v": ["sum", "mean", "max"]}).first()
    assert (r.v_sum, r.v_mean, r.v_max) == (4.0, 2.0, 3.0)


def test_p8_p9_column_sets(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "i int, s string, d double, b boolean")
    assert C.numeric_cols(df) == ["i", "d"]
    assert C.feature_cols(df, ["s", "b"]) == ["i", "d"]


def test_p10_transpose_metrics(spark):
    df = spark.createDataFrame([("lr", 0.8, 0.7), ("tree", 0.75, 0.9)], "model string, auc double, recall double")
    t = C.transpose_metrics(df, "model")
    got = {r[0]: (r["lr"], r["tree"]) for r in t.collect()}
    assert got == {"auc": (0.8, 0.75), "recall": (0.7, 0.9)}


def test_a13_drop_sparse_cols(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 5, 1)], "a int, b int, c int")
    assert P.drop_sparse_cols(df, 0.5).columns == ["a", "c"]


def test_j10_lookup_with_lexicon_frame(spark):
    docs = spark.createDataFrame([(1, ["is", "good", "x"]), (2, [])], "id int, toks array<string>")
    lex = spark.createDataFrame([("is", "be"), ("good", "good")], "token string, lemma string")
    out = lookup_tokens(docs, "toks", lex, out="lem", keep_unmatched=True)
    got = {r.id: r.lem for r in out.collect()}
    assert got == {1: ["be", "good", "x"], 2: []}
    keyed = lookup_tokens(docs, "toks", lex, out="lem", keep_unmatched=True, key="id")
    assert {r.id: r.lem for r in keyed.collect()} == got
    m = lookup_tokens(docs, "toks", {"is": "be"}, out="lem")
    assert {r.id: r.lem for r in m.collect()} == {1: ["be"], 2: []}


def test_n14_days_since_epoch(spark):
    epoch = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(epoch,)], "t long")
    assert df.select(C.days_since_epoch("t", "2020-01-11").alias("d")).first().d == 10


def test_a20_histogram_last_bin_inclusive(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r.bin: r.n for r in P.histogram(df, "x", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}


def test_a21_box_stats_ungrouped(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = P.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3, r.n_high, r.whisker_hi) == (2.0, 3.0, 4.0, 1, 4.0)


def test_a16_corr_matrix_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    got = {(r.a, r.b): r.corr for r in P.corr_matrix(df, ["a", "b"]).collect()}
    assert abs(got[("a", "b")] - 1.0) < 1e-12 and got[("a", "a")] == 1.0


def test_n16_parse_percent(spark):
    df = spark.createDataFrame([("1.25%",), ("bad",), (None,)], "p string")
    got = [r.v for r in df.select(C.parse_percent("p").alias("v")).collect()]
    assert abs(got[0] - 0.0125) < 1e-15 and got[1] is None and got[2] is None


def test_n11_text_date_parts(spark):
    df = spark.createDataFrame([("01 5, 2014",), ("1 15, 2014",), ("nope",)], "t string")
    y, m = C.parse_date_parts("t")
    got = [(r.y, r.m) for r in df.select(y.alias("y"), m.alias("m")).collect()]
    assert got == [(2014, 1), (2014, 1), (None, None)]


def test_value_counts_share_from_scalar_subquery(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = {r.c: (r["count"], r.share) for r in P.value_counts(df, "c", normalize=True).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}
    assert F is not None


def test_a22_ceil_fraction_is_exact(spark):
    df = spark.createDataFrame([(30,), (31,), (0,), (9,)], "n long")
    got = [r.c for r in df.select(P.ceil_fraction(F.col("n"), 0.1).alias("c")).collect()]
    assert got == [3, 4, 0, 1]       # 30 * 0.1 in binary floating point would ceil to 4


def test_cluster_conf_sizes_partitions():
    from sparkwright.session import cluster_conf
    c = cluster_conf(100 * 2**40)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 * 2**20)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 * 2**20)


def test_grouped_running_by_a_string(spark):
    from sparkwright.operators.windows import grouped_running
    df = spark.createDataFrame([("g", "b", 2.0), ("g", "a", 1.0), ("g", "c", 4.0)], "g string, k string, v double")
    out = grouped_running(df, "g", ["k"], {"s": F.col("v")})
    assert sorted((r.k, r.s) for r in out.collect()) == [("a", 1.0), ("b", 3.0), ("c", 7.0)]
