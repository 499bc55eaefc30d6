"""Null keys, integers beyond 2**53, outliers and concentrated values."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import clean as C
from sparkwright.operators import metrics as E
from sparkwright.operators import split as S
from sparkwright.operators import windows as W
from sparkwright.operators.quantiles import quantile_long, quantiles_wide

BIG = 2**53


@pytest.fixture()
def rows(spark):
    data = [(None, 3, 1, 1.0), (None, 1, 2, 2.0), (None, None, 3, 4.0), ("a", 2, 4, 8.0), ("a", 2, 5, None), ("a", 9, 6, 3.0)]
    return spark.createDataFrame(data, "g string, t long, id long, x double")


def ordered(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("op", [
    lambda d, s: W.event_ordinal(d, "g", "t", "id", "o", skew_safe=s),
    lambda d, s: W.event_rank(d, "g", "t", "o", skew_safe=s),
    lambda d, s: W.history_mean(d, "g", "x", "t", "id", "o", skew_safe=s)])
def test_both_forms_agree_on_null_keys_and_values(rows, op):
    a, b = op(rows, True), op(rows, False)
    assert ordered(a, "id", "o") == ordered(b, "id", "o") and a.count() == 6


def test_grouped_running_keeps_every_row_of_a_null_key(spark):
    df = spark.createDataFrame([(None if i % 3 else "k", i) for i in range(500)], "g string, t long")
    out = W.event_ordinal(df, "g", "t", "t", "o", partitions=9)
    seen = {}
    for r in out.collect():
        seen.setdefault(r.g, []).append(r.o)
    assert {g: sorted(v) == list(range(1, len(v) + 1)) for g, v in seen.items()} == {None: True, "k": True}
    assert out.count() == 500


def test_early_flag_has_a_cutoff_for_the_null_group_and_exact_integers(spark):
    df = spark.createDataFrame([(g, BIG + i) for g in (None, "a") for i in range(10)], "g string, t long")
    got = W.early_flag(df, "g", "t", 0.2)
    assert Counter((r.g, r.t - BIG) for r in got.collect() if r.is_early) == Counter([(None, 0), ("a", 0)])


def test_rank_quantiles_are_exact_beyond_double_precision(spark):
    df = spark.createDataFrame([(BIG + 1 + 2 * i,) for i in range(9)], "x long")
    r = quantile_long(df, ["x"], [0.5], mode="rank").first()
    assert (r.value, r.value_prev) == (BIG + 9, BIG + 7)


def test_quantiles_of_a_null_group(rows):
    got = {r.g: r.x_q for r in quantiles_wide(rows, ["x"], [0.5], ["g"], names=["q"]).collect()}
    assert got == {None: 2.0, "a": 5.5}


def test_trims_keep_the_null_group(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i)) for i in range(200)], "g string, i long, x double")
    for out in (C.trim_panel_any(df, ["g"], ["x"], 0.05, 0.95), C.trim_panel_count(df, ["g"], ["x"], 0.05, 0.95, 0)):
        n = Counter(r.g for r in out.collect())
        assert n == {None: 90, "a": 90}


def test_stratified_rows_with_null_labels_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "id long, y int")
    assert S.stratified_folds(df, "id", "y", 5).count() == 100
    t = S.split_stratified(df, "id", "y", 0.2)
    assert Counter((r.y, r.is_test) for r in t.collect()) == {(None, 0): 16, (None, 1): 4, (0, 0): 32, (0, 1): 8, (1, 0): 32, (1, 1): 8}


def test_small_shares_get_rows(spark):
    df = spark.range(1_000_000).withColumnRenamed("id", "k")
    assert 2 <= S.split_random(df, "k", [0.00001, 0.99999])[0].count() <= 30


@pytest.mark.parametrize("shape", ["outlier", "concentrated", "one hot group"])
def test_no_range_holds_much_more_than_its_share(spark, shape):
    rng = np.random.default_rng(0)
    n = 40_000
    t = {"outlier": np.append(np.arange(n - 1), 10**15), "concentrated": (rng.random(n) ** 40 * 1e12).astype("int64"),
         "one hot group": np.arange(n)}[shape]
    g = np.where(np.arange(n) % 10 == 0, np.arange(n) % 300, 0) if shape == "one hot group" else np.zeros(n, int)
    df = spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(zip(g, t))], "g long, t long, id long")
    sizes = [r["count"] for r in W.ranged(df, [F.col("g"), F.col("t"), F.col("id")], 20).groupBy("_slice").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 3 * n / 20
    out = W.event_ordinal(df, "g", "t", "id", "o", partitions=20)
    assert ordered(out, "id", "o") == ordered(W.event_ordinal(df, "g", "t", "id", "o", skew_safe=False), "id", "o")


def test_auc_of_concentrated_scores(spark):
    rng = np.random.default_rng(4)
    s = rng.random(3000) ** 30
    y = (rng.random(3000) < 0.3 + 0.4 * (s > np.median(s))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert E.auc(df, "y", "s").first().auc == pytest.approx(want)


def test_two_saves_of_one_name_stay_readable(spark):
    from sparkwright.session import save_intermediate
    a, b = (save_intermediate(spark.range(n), "same") for n in (3, 5))
    assert (a.count(), b.count()) == (3, 5)


def test_a_cluster_without_a_shared_folder_is_refused():
    from sparkwright.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
