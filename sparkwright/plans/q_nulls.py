"""Catalogue: operators on keys and values made null by a rule, and row predicates one by one.

The driver's tables hold no nulls; ``nullif`` rules make a fifth or more of
the keys null, so a row lost to a null key shows in the answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as K
from ..operators import profile as P
from ..operators import split as S
from ..operators import windows as W
from ..operators.quantiles import quantiles_wide
from .common import query, rounded, tbl
from .q_metrics import _H


def _events(spark, d):
    e = tbl(spark, d, "events").select("event_id", "ts", "value", F.nullif("event_type", F.lit("click")).alias("k"))
    return e.withColumn("t", F.when(F.col("event_id") % 7 != 3, F.col("event_id") % 50))


_E = """WITH e AS (SELECT event_id, ts, value, nullif(event_type, 'click') AS k,
  CASE WHEN event_id % 7 <> 3 THEN event_id % 50 END AS t FROM events)"""


@query("q_null_ordinal", f"""{_E}
SELECT event_id, CAST(row_number() OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id) AS INTEGER) AS ordinal FROM e""")
def q_null_ordinal(spark, d):
    """W1/W2 with a null group and null order values."""
    return W.event_ordinal(_events(spark, d), "k", "t", "event_id").select("event_id", "ordinal")


@query("q_null_rank", f"""{_E}
SELECT event_id, CAST(rank() OVER (PARTITION BY k ORDER BY t NULLS FIRST) AS INTEGER) AS rank FROM e""")
def q_null_rank(spark, d):
    """W3 with a null group and null order values (nulls tie)."""
    return W.event_rank(_events(spark, d), "k", "t").select("event_id", "rank")


@query("q_null_history", f"""{_E}
SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY k ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS history_mean FROM e""")
def q_null_history(spark, d):
    """W6 with a null group."""
    return rounded(W.history_mean(_events(spark, d), "k", "value", "ts", "event_id").select("event_id", "history_mean"))


@query("q_null_quantiles", f"""{_E}
SELECT k, round(quantile_cont(value, 0.1), 6) AS value_q1, round(quantile_cont(value, 0.9), 6) AS value_q9 FROM e GROUP BY k""")
def q_null_quantiles(spark, d):
    """A15 with a null group."""
    return rounded(quantiles_wide(_events(spark, d), ["value"], [0.1, 0.9], ["k"]))


@query("q_null_deviation", f"""{_E},
m AS (SELECT k, avg(value) AS m, count(*) AS n FROM e GROUP BY k)
SELECT event_id, round(m, 6) AS group_mean, round(value - m, 6) AS deviation, n FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k""")
def q_null_deviation(spark, d):
    """W5, W7, J8 with a null group: its mean, the deviations from it and its size."""
    e = W.deviation(_events(spark, d), "k", "value", out="deviation", mean_out="group_mean")
    return rounded(W.attach_group_agg(e, "k", {"n": F.count(F.lit(1))}).select("event_id", "group_mean", "deviation", "n"))


@query("q_null_history_all", f"""{_E},
m AS (SELECT k, avg(value) AS m FROM e GROUP BY k)
SELECT event_id, round(m, 6) AS history_mean FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k""")
def q_null_history_all(spark, d):
    """W6 in the reference's form (whole-group mean) with a null group."""
    return rounded(W.history_mean(_events(spark, d), "k", "value", "ts", "event_id", prior_only=False).select("event_id", "history_mean"))


@query("q_null_zscore", f"""{_E},
m AS (SELECT k, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY k)
SELECT event_id, round((value - m) / s, 6) AS value_z FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k""")
def q_null_zscore(spark, d):
    """W8 with a null group."""
    return rounded(W.zscore_by(_events(spark, d), "k", ["value"], "_z").select("event_id", "value_z"))


@query("q_null_median_label", f"""{_E},
m AS (SELECT k, quantile_cont(value, 0.5) AS m FROM e GROUP BY k)
SELECT event_id, CAST(value >= m AS INTEGER) AS label FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k""")
def q_null_median_label(spark, d):
    """W9 with a null group: labelled by its own median."""
    return W.median_label(_events(spark, d), "k", "value").select("event_id", "label")


@query("q_null_box", f"""{_E},
q AS (SELECT k, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY k)
SELECT q.k, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(value) AS n,
  count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS n_high
FROM e JOIN q ON e.k IS NOT DISTINCT FROM q.k GROUP BY q.k, q1, median, q3""")
def q_null_box(spark, d):
    """A21 with a null group."""
    return rounded(P.box_stats(_events(spark, d), "value", ["k"]).select("k", "q1", "median", "q3", "n", "n_high"))


def _panel(spark, d):
    return tbl(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.nullif(F.year("o_orderdate"), F.lit(1996)).alias("yr"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("cust"))


_P = """WITH p AS (SELECT o_orderkey, o_totalprice, nullif(year(o_orderdate), 1996) AS yr,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS cust FROM orders),
b AS (SELECT yr, quantile_cont(o_totalprice, {lo}) AS plo, quantile_cont(o_totalprice, {hi}) AS phi,
  quantile_cont(cust, {lo}) AS clo, quantile_cont(cust, {hi}) AS chi FROM p GROUP BY yr),
f AS (SELECT p.o_orderkey, CAST(o_totalprice < plo OR o_totalprice > phi AS INTEGER) AS a,
  coalesce(CAST(cust < clo OR cust > chi AS INTEGER), 0) AS c FROM p JOIN b ON p.yr IS NOT DISTINCT FROM b.yr)
SELECT o_orderkey FROM f WHERE {keep}"""


@query("q_null_trim_any", _P.format(lo=0.05, hi=0.95, keep="a + c = 0"))
def q_null_trim_any(spark, d):
    """F10 with a null group and null values (a null never trims, T21)."""
    return K.trim_panel_any(_panel(spark, d), ["yr"], ["o_totalprice", "cust"], 0.05, 0.95).select("o_orderkey")


@query("q_null_trim_count", _P.format(lo=0.1, hi=0.9, keep="a + c <= 1"))
def q_null_trim_count(spark, d):
    """F11 with a null group and null values."""
    return K.trim_panel_count(_panel(spark, d), ["yr"], ["o_totalprice", "cust"], 0.1, 0.9, 1).select("o_orderkey")


def _labels(spark, d):
    return tbl(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 != 1, F.col("quality")).alias("y"))


_L = "WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN quality END AS y FROM labels)"


@query("q_null_folds", f"""{_L}
SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {_H}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM l""")
def q_null_folds(spark, d):
    """M6 with null labels: they are a class."""
    return S.stratified_folds(_labels(spark, d), "doc_id", "y", 5, method="mod")


@query("q_null_stratified", f"""{_L},
r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY {_H}, doc_id) AS rn, count(*) OVER (PARTITION BY y) AS nc FROM l)
SELECT doc_id, y, CASE WHEN rn <= floor(nc * 0.2 + 0.5) THEN 1 ELSE 0 END AS is_test FROM r""")
def q_null_stratified(spark, d):
    """M2 with null labels: they are a class."""
    return S.split_stratified(_labels(spark, d), "doc_id", "y", 0.2, method="mod")


_O = """WITH o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_orderdate,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders)"""


def _orders(spark, d):
    return tbl(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderdate",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"))


@query("q_predicates", f"""{_O}
SELECT 'at_most' AS predicate, count(*) AS n FROM o WHERE price <= 300000
UNION ALL SELECT 'between', count(*) FROM o WHERE price > 50000 AND price < 300000
UNION ALL SELECT 'not', count(*) FROM o WHERE NOT coalesce(status = 'F', false)
UNION ALL SELECT 'not_null', count(*) FROM o WHERE status IS NOT NULL
UNION ALL SELECT 'drop_null', count(*) FROM o WHERE price IS NOT NULL AND status IS NOT NULL
UNION ALL SELECT 'outside_period', count(*) FROM o WHERE NOT (year(o_orderdate) = 1999 AND month(o_orderdate) > 6)
UNION ALL SELECT 'inside_period', count(*) FROM o WHERE year(o_orderdate) = 1999 AND month(o_orderdate) > 6""")
def q_predicates(spark, d):
    """F1, F2, F4, F5, F7, F13, each by itself: rows kept on columns with nulls."""
    o = _orders(spark, d)
    outside, inside = K.holdout(o, (F.year("o_orderdate") == 1999) & (F.month("o_orderdate") > 6))
    kept = {"at_most": o.filter(F.col("price") <= 300000), "between": o.filter(K.between_exclusive("price", 50000, 300000)),
            "not": o.filter(K.null_safe_not(F.col("status") == "F")), "not_null": o.filter(F.col("status").isNotNull()),
            "drop_null": o.na.drop(subset=["price", "status"]), "outside_period": outside, "inside_period": inside}
    out = None
    for name, rows in kept.items():
        n = rows.groupBy().agg(F.lit(name).alias("predicate"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("q_projections", f"""{_O}
SELECT o_orderkey AS order_id, o_custkey, round(price * 1.1, 6) AS price_tax, CAST(trunc(price) AS BIGINT) AS price_int FROM o""")
def q_projections(spark, d):
    """P1, P2, P3, P6, P7 on every row, nulls kept."""
    x = C.rename(_orders(spark, d), {"o_orderkey": "order_id"}).drop("o_orderdate", "status")
    x = x.withColumns({"price_tax": F.col("price") * 1.1, "price_int": F.col("price").cast("long")})
    return rounded(x.select("order_id", "o_custkey", "price_tax", "price_int"))


@query("q_sorted_head", f"""{_O}
SELECT o_orderkey, rk FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) AS INTEGER) AS rk
FROM o) WHERE rk <= 100""")
def q_sorted_head(spark, d):
    """O1 + O2: the first 100 rows of a descending sort, nulls last, in order (the limit is the feature)."""
    from pyspark.sql import Window
    head = _orders(spark, d).orderBy(F.desc("price"), F.asc("o_orderkey")).limit(100)
    place = Window.orderBy(F.desc("price"), F.asc("o_orderkey"))   # over the 100 rows of the head only
    return head.select("o_orderkey", F.row_number().over(place).alias("rk"))


@query("q_sorted_distinct", """
SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS place
FROM (SELECT DISTINCT p_type FROM part WHERE p_size > 25 AND p_brand LIKE 'Brand#1%')""")
def q_sorted_distinct(spark, d):
    """F12 with its order: distinct values under a condition, sorted and numbered."""
    p = tbl(spark, d, "part")
    x = K.filter_distinct(p, (F.col("p_size") > 25) & K.match_flag("p_brand", "Brand#1%", "like"), "p_type")
    return W.event_ordinal(x.withColumn("_all", F.lit(0)), "_all", "p_type", "p_type", "place").select("p_type", "place")
