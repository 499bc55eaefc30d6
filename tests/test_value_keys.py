from __future__ import annotations

from collections import Counter

from sparkwright.operators import profile as P


def test_describe_all_and_distinct_counts(spark):
    long = "x" * 5000
    rows = [("a", 1, long, None, "u1"), ("b", 1, long + "y", None, "u2"), ("a", 2, long, None, "u3"), ("b", 3, None, None, "u0"), (None, 3, "z", None, None)]
    df = spark.createDataFrame(rows, "s string, i int, t string, n string, u string")
    got = {r.column: (r["count"], r.unique, r.top, r.freq) for r in P.describe_all(df).collect()}
    for at, name in enumerate(df.columns):
        values = Counter(str(r[at]) for r in rows if r[at] is not None)
        best = min(values, key=lambda v: (-values[v], v), default=None)
        assert got[name] == (sum(values.values()), len(values), best, values[best] if values else None)
    distinct = {r.column: r.nunique for r in P.nunique(df).collect()}
    assert distinct == {"s": 2, "i": 3, "t": 3, "n": 0, "u": 4}
    assert {r.column: r["count"] for r in P.describe_all(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)


def test_texts_are_not_dealt_by_value(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert "hashpartitioning(s#" not in P.nunique(df)._jdf.queryExecution().toString()
    assert "hashpartitioning(column#" in P.describe_all(df)._jdf.queryExecution().toString()
    assert "value#" not in "".join(x.split("\n")[0] for x in P.describe_all(df)._jdf.queryExecution().toString().split("hashpartitioning(")[1:])
