"""Catalogue: filters, trims, set operations, joins and windows.

Bindings (SURVEY 7.3): reviews -> events (reviewer user_id, product
event_type, time ts, rating value); panel -> orders by month; loans ->
lineitem/orders; demographics -> customer; vehicles -> part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as K
from ..operators import relate as J
from ..operators import windows as W
from .common import query, rounded, tbl

# -------------------------------------------------------------- set ops

@query("q_dedupe", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM p)
SELECT l_orderkey, l_linenumber, l_shipdate, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_quantity, 6) AS l_quantity
FROM r WHERE rn = 1""")
def q_dedupe(spark, d):
    """Keep the latest row per (order, line); ties broken by the other columns."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    return rounded(K.dedupe(li, ["l_orderkey", "l_linenumber"], order="l_shipdate", keep="last"))


@query("q_dedupe_rows", """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS n_distinct
FROM lineitem""")
def q_dedupe_rows(spark, d):
    """U2/U3 whole-row: distinct rows of a projection."""
    li = tbl(spark, d, "lineitem")
    n_distinct = K.dedupe(li.select("l_orderkey", "l_linenumber", "l_returnflag")).agg(F.count(F.lit(1))).scalar()
    return li.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", n_distinct.alias("n_distinct"))


@query("q_union_distinct", """
SELECT DISTINCT nationkey, kind FROM (
  SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer
  UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)""")
def q_union_distinct(spark, d):
    """U1 (by name, T7) + U4 (drop before union) + U2."""
    c = tbl(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind"),
                                         F.col("c_acctbal").alias("acctbal"))
    s = tbl(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"))
    return K.union_all(c.drop("acctbal"), s).distinct()


# ---------------------------------------------------------------- trims

@query("q_trim_quantiles", """
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part
WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.1) FROM part)
  AND p_retailprice < (SELECT quantile_cont(p_retailprice, 0.99) FROM part)""")
def q_trim_quantiles(spark, d):
    """strict quantile trim of one column."""
    p = tbl(spark, d, "part").select("p_partkey", "p_retailprice")
    return rounded(K.trim_quantiles(p, "p_retailprice", 0.1, 0.99))


_TRIM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _trim_bounds_sql(src, lo, hi):
    qs = ", ".join(f"quantile_cont({c}, {lo}) AS {c}_lo, quantile_cont({c}, {hi}) AS {c}_hi" for c in _TRIM_COLS)
    return f"SELECT yr, {qs} FROM {src} GROUP BY yr"


def _out_sql(alias="b"):
    return [f"coalesce(x.{c} < {alias}.{c}_lo OR x.{c} > {alias}.{c}_hi, false)" for c in _TRIM_COLS]


_PANEL = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, " \
         "CAST(year(l_shipdate) AS INTEGER) AS yr FROM lineitem)"

_TRIM_ANY_SQL = f"""
WITH x AS {_PANEL}, b AS ({_trim_bounds_sql('x', 0.005, 0.995)})
SELECT x.* FROM x JOIN b ON x.yr = b.yr
WHERE NOT ({' OR '.join(_out_sql())})"""


def _panel(spark, d):
    return tbl(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *_TRIM_COLS, F.year("l_shipdate").alias("yr"))


@query("q_trim_panel_any", f"""
WITH t AS ({_TRIM_ANY_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, yr FROM t""")
def q_trim_panel_any(spark, d):
    """per-year trim, any of the columns outside [q.005, q.995] (null never trims)."""
    return K.trim_panel_any(_panel(spark, d), ["yr"], _TRIM_COLS, 0.005, 0.995) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "yr")


@query("q_trim_panel_count", f"""
WITH x AS ({_TRIM_ANY_SQL}), b AS ({_trim_bounds_sql('x', 0.025, 0.975)})
SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, x.yr FROM x JOIN b ON x.yr = b.yr
WHERE ({' + '.join(f'CAST({e} AS INTEGER)' for e in _out_sql())}) <= 1""")
def q_trim_panel_count(spark, d):
    """F11 on F10's output: drop rows with more than 1 of 4 columns outside [q.025, q.975]."""
    first = K.trim_panel_any(_panel(spark, d), ["yr"], _TRIM_COLS, 0.005, 0.995)
    return K.trim_panel_count(first, ["yr"], _TRIM_COLS, 0.025, 0.975, max_out=1) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "yr")


# ---------------------------------------------------------------- joins

@query("q_isin_merge", """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name IN ('ASIA', 'EUROPE')""")
def q_isin_merge(spark, d):
    """F3 + J1: membership filter on a dimension, then inner joins."""
    r = tbl(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    n = tbl(spark, d, "nation").join(r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    c = tbl(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return J.join_inner(c, n, "n_nationkey").select("c_custkey", "n_name", "r_name")


@query("q_composite_join", """
WITH l AS (SELECT l_orderkey AS k, CAST(year(l_shipdate) AS INTEGER) AS yr, count(*) AS n_lines,
                  sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority FROM orders)
SELECT o.o_orderpriority, CAST(sum(l.n_lines) AS BIGINT) AS n_lines, round(sum(l.qty), 6) AS qty, count(*) AS n_keys
FROM l JOIN o ON l.k = o.k AND l.yr = o.yr GROUP BY o.o_orderpriority""")
def q_composite_join(spark, d):
    """Inner join on (key, year): lines shipped in the order's own year."""
    l = tbl(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.year("l_shipdate").alias("yr")) \
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    o = tbl(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("yr"),
                                       "o_orderpriority")
    j = J.join_inner(l, o, ["k", "yr"])
    return rounded(j.groupBy("o_orderpriority").agg(F.sum("n_lines").alias("n_lines"), F.sum("qty").alias("qty"),
                                                    F.count(F.lit(1)).alias("n_keys")))


@query("q_left_other_key", """
WITH g AS (SELECT l_suppkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey)
SELECT s.s_suppkey, coalesce(g.n_lines, 0) AS n_lines, round(coalesce(g.qty, 0), 6) AS qty,
       CASE WHEN g.l_suppkey IS NULL THEN 0 ELSE 1 END AS has_ref
FROM supplier s LEFT JOIN g ON s.s_suppkey = g.l_suppkey""")
def q_left_other_key(spark, d):
    """Left join where the right key has another name (renamed, then joined)."""
    g = tbl(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.lit(1).alias("has_ref"))
    s = tbl(spark, d, "supplier").select("s_suppkey")
    out = J.join_left(s, g, left_on="s_suppkey", right_on="l_suppkey", fill={"n_lines": 0, "qty": 0.0, "has_ref": 0})
    return rounded(out)


@query("q_overlap_counts", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer) a WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS cust_in_orders,
       (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) a WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS orders_in_cust,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents) a WHERE doc_id IN (SELECT doc_id FROM labels)) AS docs_in_labels,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) a WHERE doc_id IN (SELECT doc_id FROM documents)) AS labels_in_docs""")
def q_overlap_counts(spark, d):
    """Id overlaps between tables (semi joins, one scalar each)."""
    c, o = tbl(spark, d, "customer"), tbl(spark, d, "orders")
    doc, lab = tbl(spark, d, "documents"), tbl(spark, d, "labels")
    return spark.range(1).select(
        J.overlap_count(c, o, "c_custkey", "o_custkey").alias("cust_in_orders"),
        J.overlap_count(o, c, "o_custkey", "c_custkey").alias("orders_in_cust"),
        J.overlap_count(doc, lab, "doc_id").alias("docs_in_labels"),
        J.overlap_count(lab, doc, "doc_id").alias("labels_in_docs"))


@query("q_attach_agg", """
WITH g AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(g.n_lines, 0) AS n_lines, round(coalesce(g.qty, 0), 6) AS qty,
       round(o.o_totalprice / nullif(coalesce(g.qty, 0), 0), 6) AS price_per_unit
FROM orders o LEFT JOIN g ON o.o_orderkey = g.l_orderkey""")
def q_attach_agg(spark, d):
    """J3 + J8 + N1: per-order aggregate of another table joined back, nulls filled."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_totalprice")
    li = tbl(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = W.attach_group_agg(o, "o_orderkey", {"n_lines": F.count(F.lit(1)), "qty": F.sum("l_quantity")},
                             source=li, fill={"n_lines": 0, "qty": 0.0})
    out = out.withColumn("price_per_unit", F.try_divide(F.col("o_totalprice"), F.col("qty")))
    return rounded(out.drop("o_totalprice"))


@query("q_zip_by_key", """
SELECT p_partkey, round(p_retailprice / p_size, 6) AS price_per_size, CAST(length(p_name) AS INTEGER) AS name_len,
       upper(p_brand) AS brand_upper FROM part""")
def q_zip_by_key(spark, d):
    """Derived frames combined by an explicit key, never by position."""
    p = tbl(spark, d, "part")
    a = p.select("p_partkey", F.try_divide(F.col("p_retailprice"), F.col("p_size")).alias("price_per_size"))
    b = p.select("p_partkey", F.length("p_name").alias("name_len"))
    c = p.select("p_partkey", F.upper("p_brand").alias("brand_upper"))
    return rounded(J.zip_by_key([a, b, c], "p_partkey"))


# ----------------------------------------------------------- rare levels

@query("q_topn_levels", """
WITH t AS (SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10)
SELECT p.p_partkey, CASE WHEN p.p_brand IS NULL THEN NULL WHEN t.p_brand IS NOT NULL THEN p.p_brand ELSE 'others' END AS brand_level
FROM part p LEFT JOIN t ON p.p_brand = t.p_brand""")
def q_topn_levels(spark, d):
    """O4 + N9 top-N mode."""
    p = tbl(spark, d, "part").select("p_partkey", "p_brand")
    return K.collapse_levels(p, "p_brand", top_n=10, out="brand_level").select("p_partkey", "brand_level")


@query("q_min_count_levels", """
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nk FROM customer),
k AS (SELECT nk FROM c WHERE nk IS NOT NULL GROUP BY nk HAVING count(*) >= 60)
SELECT c.c_custkey, CASE WHEN c.nk IS NULL THEN NULL WHEN k.nk IS NOT NULL THEN c.nk ELSE 'others' END AS nation_level
FROM c LEFT JOIN k ON c.nk = k.nk""")
def q_min_count_levels(spark, d):
    """A24 + N9 min-count mode."""
    c = tbl(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nk"))
    return K.collapse_levels(c, "nk", min_count=60, out="nation_level").select("c_custkey", "nation_level")


# ------------------------------------------------------- scalar helpers

@query("q_bins", """
SELECT CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice BETWEEN 10000 AND 50000 THEN 'mid'
            WHEN l_extendedprice > 50000 THEN 'high' ELSE 'unknown' END AS price_bin, count(*) AS n
FROM lineitem GROUP BY 1""")
def q_bins(spark, d):
    """Three bins with an inclusive middle and a default."""
    li = tbl(spark, d, "lineitem")
    b = C.bin_values("l_extendedprice", [10000, 50000], ["low", "mid", "high"], default="unknown")
    return li.groupBy(b.alias("price_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("q_remap", """
SELECT CASE WHEN o_orderpriority IS NULL THEN 'Missing' WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
            WHEN o_orderpriority = '2-HIGH' THEN 'high' ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS status_label,
       count(*) AS n
FROM orders GROUP BY 1, 2""")
def q_remap(spark, d):
    """N4 (remap with a null key) + N5 (label map, unmapped -> null)."""
    o = tbl(spark, d, "orders")
    pr = C.remap("o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high"}, null_as="Missing")
    st = C.map_labels("o_orderstatus", {"F": 1, "O": 0})
    return o.groupBy(pr.alias("priority"), st.alias("status_label")).agg(F.count(F.lit(1)).alias("n"))


@query("q_days_floor", """
SELECT event_id,
  CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-15 12:00:00', ts) / 86400000000.0) AS BIGINT) AS days_from_mid,
  CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-15 12:00:00') / 86400000000.0) AS BIGINT) AS days_to_mid
FROM events""")
def q_days_floor(spark, d):
    """Floored whole days both ways across part days."""
    e = tbl(spark, d, "events")
    mid = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return e.select("event_id", C.whole_days("ts", mid).alias("days_from_mid"),
                    C.whole_days(mid, "ts").alias("days_to_mid"))


@query("q_decay", """
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days_since,
       round(exp(-0.01 * date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')), 6) AS weight
FROM orders""")
def q_decay(spark, d):
    """N14 + N15 with a fixed as-of date."""
    o = tbl(spark, d, "orders")
    days = C.days_since("o_orderdate", "2002-01-01")
    return rounded(o.select("o_orderkey", days.alias("days_since"), C.decay(days).alias("weight")))


@query("q_flags", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
       CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished,
       CASE WHEN o_totalprice / 500000 > 0.5 THEN 1 ELSE 0 END AS cls_gt,
       CASE WHEN o_totalprice / 500000 >= 0.5 THEN 1 ELSE 0 END AS cls_ge,
       2023 - CAST(year(o_orderdate) AS INTEGER) AS age_years
FROM orders""")
def q_flags(spark, d):
    """N6, N8, N10, N25 (> vs >=), N27."""
    o = tbl(spark, d, "orders")
    yr, mon = C.date_parts("o_orderdate")
    score = F.col("o_totalprice") / 500000
    return o.select("o_orderkey", yr.alias("yr"), mon.alias("mon"),
                    C.threshold_flag("o_totalprice", ">", 200000).alias("big"),
                    C.flag(F.col("o_orderstatus") == "F").alias("finished"),
                    C.to_class(score, 0.5, ">").alias("cls_gt"), C.to_class(score, 0.5, ">=").alias("cls_ge"),
                    C.years_before(yr, 2023).alias("age_years"))


@query("q_text_dates", """
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%-m %-d, %Y') AS odate_text,
                  printf('%.2f%%', o_totalprice) AS pct_text, o_orderdate FROM orders)
SELECT o_orderkey, odate_text, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
       round(CAST(replace(pct_text, '%', '') AS DOUBLE) / 100, 6) AS pct,
       2001 - CAST(year(o_orderdate) AS INTEGER) AS age
FROM t""")
def q_text_dates(spark, d):
    """N11 (text date -> year, month, no UDF), N12 (age at a fixed date), N16 (percent text)."""
    o = tbl(spark, d, "orders")
    t = o.select("o_orderkey", F.date_format("o_orderdate", "M d, yyyy").alias("odate_text"),
                 F.format_string("%.2f%%", F.col("o_totalprice")).alias("pct_text"), "o_orderdate")
    yr, mon = C.parse_date_parts("odate_text", "M d, yyyy")
    return rounded(t.select("o_orderkey", "odate_text", yr.alias("yr"), mon.alias("mon"),
                            C.parse_percent("pct_text").alias("pct"),
                            C.age(F.to_date("o_orderdate"), "2001-06-30").alias("age")))


# -------------------------------------------------------------- windows

@query("q_ordinals", """
SELECT event_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS user_ordinal,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS type_ordinal
FROM events""")
def q_ordinals(spark, d):
    """W1 + W2: ordinals per product and per reviewer, id as the tie-break."""
    e = tbl(spark, d, "events")
    e = W.event_ordinal(e, "user_id", "ts", "event_id", "user_ordinal")
    e = W.event_ordinal(e, "event_type", "ts", "event_id", "type_ordinal")
    return e.select("event_id", "user_ordinal", "type_ordinal")


@query("q_ordinals_skewsafe", """
SELECT event_id,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS type_ordinal
FROM events""")
def q_ordinals_skewsafe(spark, d):
    """W1 with the range-partitioned variant (5 groups of 2,000: every group is hot)."""
    e = tbl(spark, d, "events")
    return W.event_ordinal(e, "event_type", "ts", "event_id", "type_ordinal", skew_safe=True) \
        .select("event_id", "type_ordinal")


_EARLY_SQL = """
WITH r AS (SELECT {id}, {g}, {t}, rank() OVER (PARTITION BY {g} ORDER BY {t}) AS rk FROM {tab}),
th AS (SELECT {g}, CAST(ceil(count(*) * 0.1) AS BIGINT) AS thr FROM {tab} GROUP BY {g}),
c AS (SELECT DISTINCT r.{g}, r.{t} AS cutoff FROM r JOIN th ON r.{g} = th.{g} AND r.rk = th.thr)
SELECT r.{id}, CAST(r.rk AS INTEGER) AS rank,
       CASE WHEN c.cutoff IS NOT NULL AND r.{t} < c.cutoff THEN 1 ELSE 0 END AS is_early
FROM r LEFT JOIN c ON r.{g} = c.{g}"""


@query("q_early_flag", _EARLY_SQL.format(id="event_id", g="event_type", t="ts", tab="events"))
def q_early_flag(spark, d):
    """W3 + W4 + J7 + A22: first-decile flag per product, rank mode."""
    e = tbl(spark, d, "events").select("event_id", "event_type", "ts")
    e = W.event_rank(e, "event_type", "ts", "rank")
    return W.early_flag(e, "event_type", "ts", 0.1, mode="rank").select("event_id", "rank", "is_early")


@query("q_early_flag_ties", _EARLY_SQL.format(id="o_orderkey", g="o_custkey", t="o_orderdate", tab="orders"))
def q_early_flag_ties(spark, d):
    """W4 rank mode where dates tie (T2: a tie over the cutoff rank means no cutoff)."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = W.event_rank(o, "o_custkey", "o_orderdate", "rank")
    return W.early_flag(o, "o_custkey", "o_orderdate", 0.1, mode="rank").select("o_orderkey", "rank", "is_early")


@query("q_early_flag_rownum", """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c AS (SELECT o_custkey, o_orderdate AS cutoff FROM r WHERE rn = CAST(ceil(n * 0.1) AS BIGINT))
SELECT r.o_orderkey, CASE WHEN r.o_orderdate < c.cutoff THEN 1 ELSE 0 END AS is_early
FROM r LEFT JOIN c ON r.o_custkey = c.o_custkey""")
def q_early_flag_rownum(spark, d):
    """W4 row_number mode: the cutoff always exists."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.early_flag(o, "o_custkey", "o_orderdate", 0.1, mode="row_number").select("o_orderkey", "is_early")


@query("q_deviation", """
WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY event_type)
SELECT e.event_id, round(m.mu, 6) AS value_group_mean, round(e.value - m.mu, 6) AS value_deviation
FROM events e JOIN m ON e.event_type = m.event_type""")
def q_deviation(spark, d):
    """W5 + W7: rating minus product mean (aggregate joined back, not window + distinct)."""
    e = tbl(spark, d, "events").select("event_id", "event_type", "value")
    return rounded(W.deviation(e, "event_type", "value").select("event_id", "value_group_mean", "value_deviation"))


@query("q_history_prior", """
SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS history_mean
FROM events""")
def q_history_prior(spark, d):
    """W6 leak-free (T6): mean of the reviewer's earlier values, 0 when none."""
    e = tbl(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return rounded(W.history_mean(e, "user_id", "value", "ts", "event_id")
                   .select("event_id", "history_mean"))


@query("q_history_prior_skewsafe", """
SELECT event_id, round(coalesce(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS history_mean
FROM events""")
def q_history_prior_skewsafe(spark, d):
    """W6 skew-safe form (exclusive running sums; 5 groups of 2,000: every group is hot)."""
    e = tbl(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return rounded(W.history_mean(e, "event_type", "value", "ts", "event_id", skew_safe=True)
                   .select("event_id", "history_mean"))


@query("q_rank_skewsafe", """
SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS INTEGER) AS rank FROM orders""")
def q_rank_skewsafe(spark, d):
    """W3 skew-safe form: rank from pre-aggregated (group, value) counts; 3 statuses, ties on dates."""
    o = tbl(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return W.event_rank(o, "o_orderstatus", "o_orderdate", "rank", skew_safe=True).select("o_orderkey", "rank")


@query("q_history_all", """
SELECT e.event_id, round(m.mu, 6) AS history_mean
FROM events e JOIN (SELECT user_id, avg(value) AS mu FROM events GROUP BY user_id) m ON e.user_id = m.user_id""")
def q_history_all(spark, d):
    """W6 reference mode: whole-group mean including the row itself."""
    e = tbl(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return rounded(W.history_mean(e, "user_id", "value", "ts", "event_id", prior_only=False)
                   .select("event_id", "history_mean"))


_YM = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)"


def _orders_ym(spark, d):
    return tbl(spark, d, "orders").withColumn("ym", F.year("o_orderdate") * 100 + F.month("o_orderdate"))


@query("q_zscore", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {_YM} AS ym FROM orders),
g AS (SELECT ym, avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM o GROUP BY ym)
SELECT o.o_orderkey, o.ym, round((o.o_totalprice - g.mu) / nullif(g.sd, 0), 6) AS o_totalprice_z
FROM o JOIN g ON o.ym = g.ym""")
def q_zscore(spark, d):
    """Z-score by month with sample sd; zero sd -> null."""
    o = _orders_ym(spark, d).select("o_orderkey", "ym", "o_totalprice")
    return rounded(W.zscore_by(o, "ym", ["o_totalprice"], suffix="_z").select("o_orderkey", "ym", "o_totalprice_z"))


@query("q_median_label", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {_YM} AS ym FROM orders),
m AS (SELECT ym, quantile_cont(o_totalprice, 0.5) AS med FROM o GROUP BY ym)
SELECT o.o_orderkey, CASE WHEN o.o_totalprice IS NULL THEN 0 WHEN o.o_totalprice >= m.med THEN 1 ELSE 0 END AS label
FROM o JOIN m ON o.ym = m.ym""")
def q_median_label(spark, d):
    """Above-median label per month (null -> 0, T17)."""
    o = _orders_ym(spark, d).select("o_orderkey", "ym", "o_totalprice")
    return W.median_label(o, "ym", "o_totalprice").select("o_orderkey", "label")


@query("q_share", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share
FROM orders GROUP BY 1, 2""")
def q_share(spark, d):
    """Share within group on the grouped result."""
    g = tbl(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.share_within(g, "o_orderpriority", "n"))


@query("q_top15", """
SELECT o_custkey, round(sum(o_totalprice), 6) AS total, count(*) AS n_orders
FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 15""")
def q_top15(spark, d):
    """O3 (+ M31's ranking step): top 15 keys by summed value; the limit is the feature."""
    g = tbl(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"),
                                                         F.count(F.lit(1)).alias("n_orders"))
    return rounded(g.orderBy(F.desc("total"), F.asc("o_custkey")).limit(15))


@query("q_rows_basic", """
SELECT o_orderkey AS order_id, o_custkey, round(o_totalprice * 1.1, 6) AS price_tax,
       CAST(trunc(o_totalprice) AS BIGINT) AS price_int
FROM orders
WHERE o_totalprice <= 400000 AND o_totalprice > 1000 AND o_totalprice < 300000
  AND NOT (o_orderstatus = 'P') AND o_orderpriority IS NOT NULL
  AND NOT (year(o_orderdate) = 2001 AND month(o_orderdate) > 6)
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q_rows_basic(spark, d):
    """F1, F2, F4, F5, F7, F13, P1, P2, P3, P6, P7, O1, O2 (head of a sorted frame)."""
    o = tbl(spark, d, "orders")
    train, _hold = K.holdout(o, (F.year("o_orderdate") == 2001) & (F.month("o_orderdate") > 6))
    x = train.filter(F.col("o_totalprice") <= 400000) \
        .filter(K.between_exclusive("o_totalprice", 1000, 300000)) \
        .filter(K.null_safe_not(F.col("o_orderstatus") == "P")) \
        .na.drop(subset=["o_orderpriority"]).filter(F.col("o_orderpriority").isNotNull())
    x = C.rename(x, {"o_orderkey": "order_id"}).drop("o_orderdate", "o_orderstatus")
    x = x.withColumns({"price_tax": F.col("o_totalprice") * 1.1,
                       "price_int": F.col("o_totalprice").cast("long")})
    top = x.orderBy(F.desc("o_totalprice"), F.asc("order_id")).limit(100)
    return rounded(top.select("order_id", "o_custkey", "price_tax", "price_int"))


@query("q_distinct_filtered", """
SELECT DISTINCT p_type FROM part WHERE p_size > 25 AND p_brand LIKE 'Brand#1%'""")
def q_distinct_filtered(spark, d):
    """F12 + F8 (LIKE): distinct values under a two-column condition."""
    p = tbl(spark, d, "part")
    return K.filter_distinct(p, (F.col("p_size") > 25) & K.match_flag("p_brand", "Brand#1%", "like"), "p_type")


@query("q_group_nonnull", """
WITH c AS (SELECT c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)
SELECT c_nationkey, count(c_acctbal) AS c_acctbal_count, round(avg(c_acctbal), 6) AS c_acctbal_mean
FROM c GROUP BY c_nationkey""")
def q_group_nonnull(spark, d):
    """A5 + A7: group mean and non-null count where the column has nulls."""
    c = tbl(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    from ..operators import profile as P
    return rounded(P.group_count_nonnull(c, "c_nationkey", "c_acctbal").join(
        P.group_mean(c, "c_nationkey", "c_acctbal"), "c_nationkey"))
