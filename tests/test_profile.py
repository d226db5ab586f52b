"""Profiles: one scan a table, exact where named, sketches within their bounds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import schema_profile, sketch_profile


def profile(df, **options):
    return {r["column_name"]: tuple(r)[4:] for r in schema_profile(df, **options).collect()}


def test_one_scan_and_two_exchanges(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = schema_profile({"a": df, "b": spark.read.parquet(f"{sf_dir}/orders.parquet")}, distinct="all")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan


def test_only_named_columns_are_counted(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "#NULO#")], "n int, s string")
    assert profile(df) == {"n": (3, 1, 0, None), "s": (3, 0, 1, None)}
    assert profile(df, distinct=["s"]) == {"n": (3, 1, 0, None), "s": (3, 0, 1, 3)}


def test_values_of_every_kind(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
           (true, 1.50BD, DATE'2020-01-01', TIMESTAMP'2020-01-01 00:00:00', TIMESTAMP_NTZ'2020-01-01 00:00:00', array(1, NULL), X'00', double('NaN'), map('a', 1)),
           (false, 1.5BD, DATE'2020-01-02', TIMESTAMP'2020-01-01 00:00:00.000001', TIMESTAMP_NTZ'2020-01-01 00:00:00', array(1), X'0000', double('NaN'), map('a', 1)),
           (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(b, d, day, ts, ntz, a, x, f, m)"""
    )
    want = {"b": 2, "d": 1, "day": 2, "ts": 2, "ntz": 1, "a": 2, "x": 2, "f": 1, "m": 1}
    assert profile(df, distinct="all") == {c: (3, 1, 0, n) for c, n in want.items()}


def test_columns_with_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, value int, c1 int")
    assert profile(df, distinct="all") == {c: (1, 0, 0, 1) for c in ("a.b", "value", "c1")}


def test_sentinels_with_quotes(spark):
    for text in ("it's", "a\\\\'b", "c\\\\"):
        df = spark.createDataFrame([(text,), ("x",)], "s string")
        assert profile(df, sentinel=text) == {"s": (2, 0, 1, None)}


def test_a_table_without_columns(spark):
    with pytest.raises(ValueError):
        schema_profile(spark.range(3).select())


def test_sketches_stay_within_their_bounds(spark):
    n = 20000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("z"),
        F.lit(dt.date(2020, 1, 1)).alias("day"),
    )
    found = {r["column_name"]: r for r in sketch_profile(df).collect()}
    exact = profile(df, distinct="all")
    for name, (rows, nulls, _, distinct) in exact.items():
        r = found[name]
        assert (r["n_rows"], r["n_nulls"]) == (rows, nulls)
        assert abs(r["approx_distinct"] - distinct) <= 5 * 0.02 * distinct
    for q, value in zip((0.25, 0.5, 0.75), found["id"]["quantiles"]):
        assert abs(value / n - q) <= 1e-3
    assert found["s"]["quantiles"] is None and found["day"]["quantiles"] is None
    top = found["s"]["frequent"][0]
    assert top["item"] == "hot" and abs(top["count"] - exact["id"][0] / 3) <= 0.001 * n
    assert [(v["item"], v["count"]) for v in found["z"]["frequent"]] == [("0.0", n)]


def test_sketches_of_nothing(spark):
    found = {r["column_name"]: tuple(r)[2:] for r in sketch_profile(spark.createDataFrame([], "a int, b string")).collect()}
    assert found == {"a": (0, 0, 0, None, []), "b": (0, 0, 0, None, [])}
    nulls = sketch_profile(spark.createDataFrame([(None,), (None,)], "a int")).first()
    assert tuple(nulls)[2:] == (2, 2, 0, None, [])
