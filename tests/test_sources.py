"""S1-S8 on local files (tests only write to pytest's tmp_path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.sources import io as IO


def test_csv_header_inference_and_dates(spark, tmp_path):
    p = tmp_path / "loans.csv"
    p.write_text("customerid,loanamount,approveddate\nc1,100.5,2017-07-01 08:00:00\nc2,,bad\n")
    df = IO.read_csv(spark, str(p), date_cols=["approveddate"], date_format="yyyy-MM-dd HH:mm:ss")
    got = sorted(df.collect(), key=lambda r: r.customerid)
    assert got[0].loanamount == 100.5 and got[0].approveddate.year == 2017
    assert got[1].loanamount is None and got[1].approveddate is None


def test_csv_latin1_encoding(spark, tmp_path):
    p = tmp_path / "songs.csv"
    p.write_bytes("artist,year\nBeyonc\xe9,2010\n".encode("latin-1"))
    df = IO.read_csv(spark, str(p), schema="artist string, year int", encoding="ISO-8859-1")
    assert df.first().artist == "Beyoncé"


def test_catalog_table_and_shape(spark):
    spark.range(5).createOrReplaceTempView("t_five")
    df = IO.load_table(spark, "t_five")
    shape = IO.profile_shape(df)
    assert shape["rows"] == 5 and shape["columns"] == 1 and shape["dtypes"] == {"id": "bigint"}
    assert [r.id for r in IO.preview(df, 2, ["id"]).collect()] == [0, 1]
    assert [r.id for r in IO.tail(df, 2, ["id"]).collect()] == [4, 3]


def test_checkpoint_table_round_trip(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = IO.checkpoint_table(df, "roundtrip_test")
    assert sorted(r.x for r in back.collect()) == [i * 2 for i in range(10)]


def test_sample_fraction(spark):
    n = IO.sample(spark.range(10_000), 0.1, seed=0).count()
    assert 800 < n < 1200


def test_submission_columns(spark):
    from pyspark.ml.linalg import Vectors

    from sparkwright.operators.models import submission
    df = spark.createDataFrame([(1, Vectors.dense([0.3, 0.7]))], ["id", "probability"])
    r = submission(df, "id").first()
    assert r.id == 1 and abs(r.label - 0.7) < 1e-12


def test_submission_written_as_csv(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from sparkwright.operators.models import submission
    df = spark.createDataFrame([(1, Vectors.dense([0.9, 0.1])), (2, Vectors.dense([0.2, 0.8]))], ["id", "probability"])
    out = str(tmp_path / "sub")
    submission(df, "id", path=out)
    back = spark.read.option("header", True).schema("id int, label double").csv(out)
    assert sorted((r.id, r.label) for r in back.collect()) == [(1, 0.1), (2, 0.8)]


def test_driver_entry_contract(spark):
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0 and "c_custkey" in df.columns
    qs, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(qs) and len(sql) >= 100


def test_scratch_removes_what_was_saved(spark, tmp_path):
    import os

    from sparkwright.session import SCRATCH, save_intermediate, scratch
    with scratch(spark) as path:
        df = save_intermediate(spark.range(10), "a")
        with scratch(spark) as inner:
            save_intermediate(spark.range(3), "b")
            assert inner != path and os.path.isdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:"))
        assert df.count() == 10 and os.listdir(path.removeprefix("file:"))
        df.write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(path.removeprefix("file:")) and spark.conf.get(SCRATCH, None) is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    try:
        with scratch(spark) as path:
            save_intermediate(spark.range(10), "a")
            raise KeyError
    except KeyError:
        assert not os.path.exists(path.removeprefix("file:"))
