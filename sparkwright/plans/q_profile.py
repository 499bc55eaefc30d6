"""Catalogue: profiling and aggregation queries (A1-A24, P5, N26, J5 slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import agg_named, flag, null_count_row, whole_days
from ..operators import profile as P
from ..operators.quantiles import quantiles_wide
from ..operators.relate import wide_row
from .common import query, rounded, tbl

# ---------------------------------------------------------------- q_wide_row

WIDE_ROW_SQL = """
WITH li AS (SELECT DISTINCT l_orderkey, l_shipdate, l_extendedprice, l_discount FROM lineitem),
x AS (
  SELECT o.o_custkey, li.l_extendedprice, li.l_extendedprice * li.l_discount AS interest,
         60 - CAST(floor(date_diff('microsecond', o.o_orderdate, li.l_shipdate) / 86400000000.0) AS BIGINT) AS days_left
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey),
g AS (
  SELECT o_custkey, sum(l_extendedprice) AS s1, avg(l_extendedprice) AS m1, sum(interest) AS s2, avg(interest) AS m2,
         avg(days_left) AS m3, max(days_left) AS x3, min(days_left) AS n3,
         CAST(sum(CASE WHEN days_left < 0 THEN 0 ELSE 1 END) AS BIGINT) AS good_sum
  FROM x GROUP BY o_custkey)
SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey,
       round(coalesce(g.s1, 0), 6) AS l_extendedprice_sum, round(coalesce(g.m1, 0), 6) AS l_extendedprice_mean,
       round(coalesce(g.s2, 0), 6) AS interest_sum, round(coalesce(g.m2, 0), 6) AS interest_mean,
       round(coalesce(g.m3, 0), 6) AS days_left_mean, coalesce(g.x3, 0) AS days_left_max,
       coalesce(g.n3, 0) AS days_left_min, coalesce(g.good_sum, 0) AS good_sum,
       CAST(g.o_custkey IS NOT NULL AS INTEGER) AS has_history
FROM customer c LEFT JOIN g ON c.c_custkey = g.o_custkey
"""


def wide_row_plan(spark, d):
    """Minimum slice: U3 -> P6/N13/N6 -> A4/P5 -> J3 -> N2 (loan-history wide row)."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount") \
        .dropDuplicates()
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    x = li.join(o, "l_orderkey").withColumns({
        "interest": F.col("l_extendedprice") * F.col("l_discount"),
        "days_left": F.lit(60) - whole_days("l_shipdate", "o_orderdate"),
    }).withColumn("good", flag(F.col("days_left") < 0, 0, 1))
    hist = agg_named(x, "o_custkey", {
        "l_extendedprice": ["sum", "mean"], "interest": ["sum", "mean"],
        "days_left": ["mean", "max", "min"], "good": "sum"}) \
        .withColumnRenamed("o_custkey", "c_custkey").withColumn("has_history", F.lit(1))
    cust = tbl(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    out = wide_row(cust, [(hist, "c_custkey", 0)])
    return rounded(out)


query("q_wide_row", WIDE_ROW_SQL)(wide_row_plan)


# ------------------------------------------------------------------- counts

@query("q_value_counts", """
SELECT p_brand, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 6) AS share
FROM part GROUP BY p_brand""")
def q_value_counts(spark, d):
    """A1 + A2: brand counts and shares (total from a scalar subquery)."""
    return rounded(P.value_counts(tbl(spark, d, "part"), "p_brand", normalize=True))


@query("q_group_minmaxmean", """
SELECT l_returnflag,
  min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(avg(l_quantity), 6) AS l_quantity_mean,
  min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
  round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
  min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max, round(avg(l_discount), 6) AS l_discount_mean
FROM lineitem GROUP BY l_returnflag""")
def q_group_minmaxmean(spark, d):
    """A3: min / max / mean of three columns per return flag, one aggregate."""
    return rounded(P.summarise_by(tbl(spark, d, "lineitem"), "l_returnflag",
                                  ["l_quantity", "l_extendedprice", "l_discount"]))


@query("q_agg_named", """
WITH x AS (SELECT o.o_orderpriority, l.l_extendedprice,
                  l.l_extendedprice * (1 + l.l_tax) - l.l_extendedprice AS interest
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT o_orderpriority, round(sum(l_extendedprice), 6) AS l_extendedprice_sum,
       round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
       round(sum(interest), 6) AS interest_sum, round(avg(interest), 6) AS interest_mean,
       round(max(interest), 6) AS interest_max, round(min(interest), 6) AS interest_min
FROM x GROUP BY o_orderpriority""")
def q_agg_named(spark, d):
    """A4 + P5 + N26: named sum/mean/max/min per priority; interest = total due - principal."""
    from ..functions.columns import diff
    li = tbl(spark, d, "lineitem")
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    x = li.join(o, "l_orderkey").withColumn(
        "interest", diff(F.col("l_extendedprice") * (1 + F.col("l_tax")), "l_extendedprice"))
    return rounded(agg_named(x, "o_orderpriority", {
        "l_extendedprice": ["sum", "mean"], "interest": ["sum", "mean", "max", "min"]}))


@query("q_std_by_group", """
SELECT o_orderstatus, round(stddev_samp(o_totalprice), 6) AS o_totalprice_std,
       round(avg(o_totalprice), 6) AS o_totalprice_mean
FROM orders GROUP BY o_orderstatus""")
def q_std_by_group(spark, d):
    """A5 + A6: sample standard deviation and mean per status."""
    o = tbl(spark, d, "orders")
    return rounded(P.group_std(o, "o_orderstatus", "o_totalprice")
                   .join(P.group_mean(o, "o_orderstatus", "o_totalprice"), "o_orderstatus"))


@query("q_sum_all", """
SELECT l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum,
       round(sum(l_quantity), 6) AS l_quantity_sum, round(sum(l_extendedprice), 6) AS l_extendedprice_sum,
       round(sum(l_discount), 6) AS l_discount_sum, round(sum(l_tax), 6) AS l_tax_sum
FROM lineitem GROUP BY l_linestatus""")
def q_sum_all(spark, d):
    """Sum of every numeric non-key column per line status."""
    return rounded(P.sum_all(tbl(spark, d, "lineitem"), "l_linestatus",
                             exclude=["l_orderkey", "l_partkey", "l_suppkey"]))


_DESCRIBE_ONE = """
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM customer)"""


@query("q_describe", _DESCRIBE_ONE.format(c="c_acctbal") + " UNION ALL " + _DESCRIBE_ONE.format(c="c_nationkey"))
def q_describe(spark, d):
    """A9 + A15: count, mean, sd, min, exact quartiles, max per column (long form)."""
    return rounded(P.describe(tbl(spark, d, "customer"), ["c_acctbal", "c_nationkey"]))


@query("q_describe_all", """
WITH cells AS (
  SELECT 'p_brand' AS col, CAST(p_brand AS VARCHAR) AS value FROM part
  UNION ALL SELECT 'p_type', CAST(p_type AS VARCHAR) FROM part
  UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
freq AS (SELECT col, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY col, value),
pc AS (SELECT col, sum(n) AS cnt, count(*) AS uniq, max(n) AS fr FROM freq GROUP BY col)
SELECT pc.col AS "column", CAST(pc.cnt AS BIGINT) AS count, CAST(pc.uniq AS BIGINT) AS "unique",
       min(f.value) AS top, CAST(pc.fr AS BIGINT) AS freq
FROM pc JOIN freq f ON f.col = pc.col AND f.n = pc.fr
GROUP BY pc.col, pc.cnt, pc.uniq, pc.fr""")
def q_describe_all(spark, d):
    """A10: count, unique, top (ties to the smallest value), freq per column."""
    return P.describe_all(tbl(spark, d, "part"), ["p_brand", "p_type", "p_size"])


def _customer_with_nulls(spark, d):
    """Nulls by rule (the tables have none): negative balance and one segment."""
    from ..functions.columns import null_if
    c = tbl(spark, d, "customer")
    return c.withColumns({
        "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
        "c_mktsegment": null_if("c_mktsegment", "BUILDING"),
    })


_CUST_NULLS = """(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""


@query("q_null_counts", f"""
WITH c AS {_CUST_NULLS}
SELECT 'c_custkey' AS "column", CAST(sum(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
       round(sum(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS share FROM c
UNION ALL SELECT 'c_acctbal', CAST(sum(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) AS BIGINT),
       round(sum(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) / count(*), 6) FROM c
UNION ALL SELECT 'c_mktsegment', CAST(sum(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT),
       round(sum(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) / count(*), 6) FROM c""")
def q_null_counts(spark, d):
    """A11 + N3: nulls per column after sentinel rules turn values into nulls."""
    return rounded(P.null_counts(_customer_with_nulls(spark, d), ["c_custkey", "c_acctbal", "c_mktsegment"]))


@query("q_null_row", f"""
WITH c AS {_CUST_NULLS}
SELECT c_custkey, (CAST(c_acctbal IS NULL AS INTEGER) + CAST(c_mktsegment IS NULL AS INTEGER)) AS n_null FROM c""")
def q_null_row(spark, d):
    """Null cells per row."""
    c = _customer_with_nulls(spark, d)
    return c.select("c_custkey", null_count_row(["c_acctbal", "c_mktsegment"]).alias("n_null"))


@query("q_dropna", f"""
WITH c AS {_CUST_NULLS}
SELECT count(*) AS n_all,
       count(*) FILTER (WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS n_complete,
       count(*) FILTER (WHERE c_acctbal IS NOT NULL) AS n_acctbal
FROM c""")
def q_dropna(spark, d):
    """rows left after dropping any-null rows and after a subset drop."""
    c = _customer_with_nulls(spark, d)
    n_all = c.agg(F.count(F.lit(1)).alias("n_all"))
    n_complete = c.na.drop("any").agg(F.count(F.lit(1)).alias("n_complete"))
    n_acct = c.na.drop(subset=["c_acctbal"]).agg(F.count(F.lit(1)).alias("n_acctbal"))
    return n_all.select("n_all", n_complete.scalar().alias("n_complete"), n_acct.scalar().alias("n_acctbal"))


@query("q_nunique", """
SELECT 'lang' AS "column", count(DISTINCT lang) AS nunique FROM documents
UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
UNION ALL SELECT 'text', count(DISTINCT text) FROM documents""")
def q_nunique(spark, d):
    """Distinct values per column."""
    return P.nunique(tbl(spark, d, "documents"), ["lang", "source", "text"])


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem")
            parts.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 6) FROM lineitem")
    parts += [f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _CORR_COLS]
    return " UNION ALL ".join(parts)


@query("q_corr_matrix", _corr_sql())
def q_corr_matrix(spark, d):
    """Pairwise Pearson correlations, long form with the diagonal."""
    return rounded(P.corr_matrix(tbl(spark, d, "lineitem"), _CORR_COLS))


@query("q_crosstab_margins", """
SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority,
       count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def q_crosstab_margins(spark, d):
    """Crosstab counts with row, column and grand totals (cube)."""
    return P.crosstab(tbl(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("q_crosstab_rows", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share
FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def q_crosstab_rows(spark, d):
    """Crosstab counts and shares within the row level."""
    return rounded(P.crosstab_rows(tbl(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("q_rate", """
SELECT quality, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM labels GROUP BY quality
UNION ALL SELECT -1, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) FROM labels""")
def q_rate(spark, d):
    """A19 per group and over all rows (T34: both denominators reported)."""
    lab = tbl(spark, d, "labels")
    per = P.rate(lab, F.col("toxic") == 1, by=["quality"])
    allr = P.rate(lab, F.col("toxic") == 1).select(F.lit(-1).alias("quality"), "rate")
    return rounded(per.unionByName(allr))


@query("q_histogram", """
WITH mm AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx, avg(p_retailprice) AS mean,
                   quantile_cont(p_retailprice, 0.5) AS median FROM part),
b AS (SELECT CAST(least(floor((p_retailprice - mn) / (mx - mn) * 10) + 1, 10) AS INTEGER) AS bin
      FROM part, mm WHERE p_retailprice IS NOT NULL)
SELECT bin, round(mn + (bin - 1) * ((mx - mn) / 10), 6) AS lo, round(mn + bin * ((mx - mn) / 10), 6) AS hi,
       count(*) AS n, round(mean, 6) AS mean, round(median, 6) AS median
FROM b, mm GROUP BY bin, mn, mx, mean, median""")
def q_histogram(spark, d):
    """Ten equal-width bins (maximum in the last bin) with mean and median lines."""
    return rounded(P.histogram(tbl(spark, d, "part"), "p_retailprice", 10))


@query("q_box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, count(l.l_extendedprice) AS n,
       round(min(CASE WHEN l.l_extendedprice >= lower_fence THEN l.l_extendedprice END), 6) AS whisker_lo,
       round(max(CASE WHEN l.l_extendedprice <= upper_fence THEN l.l_extendedprice END), 6) AS whisker_hi,
       count(*) FILTER (WHERE l.l_extendedprice < lower_fence) AS n_low,
       count(*) FILTER (WHERE l.l_extendedprice > upper_fence) AS n_high
FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag
GROUP BY f.l_returnflag, q1, median, q3, iqr, lower_fence, upper_fence""")
def q_box_stats(spark, d):
    """Quartiles, IQR fences, whiskers and outlier counts per return flag."""
    return rounded(P.box_stats(tbl(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("q_quantiles", """
SELECT l_linestatus,
  round(quantile_cont(l_extendedprice, 0.1), 6) AS l_extendedprice_q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice_q5,
  round(quantile_cont(l_extendedprice, 0.9), 6) AS l_extendedprice_q9,
  round(quantile_cont(l_quantity, 0.1), 6) AS l_quantity_q1,
  round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_q5,
  round(quantile_cont(l_quantity, 0.9), 6) AS l_quantity_q9
FROM lineitem GROUP BY l_linestatus""")
def q_quantiles(spark, d):
    """Exact deciles and median of two columns per line status."""
    return rounded(quantiles_wide(tbl(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"],
                                  [0.1, 0.5, 0.9], ["l_linestatus"]))


_Q_SQL = """
SELECT l_linestatus,
  round(quantile_cont(l_extendedprice, 0.1), 6) AS l_extendedprice_q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice_q5,
  round(quantile_cont(l_extendedprice, 0.9), 6) AS l_extendedprice_q9,
  round(quantile_cont(l_quantity, 0.1), 6) AS l_quantity_q1,
  round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_q5,
  round(quantile_cont(l_quantity, 0.9), 6) AS l_quantity_q9
FROM lineitem GROUP BY l_linestatus"""


@query("q_quantiles_bracket", _Q_SQL)
def q_quantiles_bracket(spark, d):
    """A15 in the form of the deciles per line status that the trims use."""
    return rounded(quantiles_wide(tbl(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"],
                                  [0.1, 0.5, 0.9], ["l_linestatus"]))


@query("q_trim_bracket", """
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part
WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.005) FROM part)
  AND p_retailprice < (SELECT quantile_cont(p_retailprice, 0.995) FROM part)""")
def q_trim_bracket(spark, d):
    """F9 with extreme quantiles, as bounds attached to the rows."""
    from ..operators.clean import between_exclusive
    p = tbl(spark, d, "part").select("p_partkey", "p_retailprice")
    q = quantiles_wide(p, ["p_retailprice"], [0.005, 0.995], names=["lo", "hi"])
    b = q.select(F.struct("p_retailprice_lo", "p_retailprice_hi")).scalar()
    return rounded(p.filter(between_exclusive("p_retailprice", b["p_retailprice_lo"], b["p_retailprice_hi"])))


@query("q_class_weights", """
SELECT quality, count(*) AS n_c, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight
FROM labels GROUP BY quality""")
def q_class_weights(spark, d):
    """Balanced class weights n / (k * n_c)."""
    return rounded(P.class_weights(tbl(spark, d, "labels"), "quality"))


@query("q_freq_split", """
SELECT c_nationkey, count(*) AS count, CAST(count(*) >= 60 AS INTEGER) AS frequent
FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey""")
def q_freq_split(spark, d):
    """Level counts with a frequent flag (count >= 60)."""
    return P.freq_split(tbl(spark, d, "customer"), "c_nationkey", 60)
