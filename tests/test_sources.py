"""Readers and writers."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources import (
    StageStore,
    checked_lines,
    quarantine,
    read_delimited,
    rejects_by_column,
    shared_root,
    write_delimited,
    write_partitioned,
    write_sorted,
)

SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("note", T.StringType())]
)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("ISO-8859-1"))


def test_binds_by_name_and_keeps_text(spark, tmp_path):
    write(tmp_path / "a" / "x.csv", "note;extra;n;code\nSão;1;7;001234\n#NULO#;2;#NULO#;10:11:12\n")
    out = read_delimited(spark, f"{tmp_path}/*/*.csv", SCHEMA)
    assert [tuple(r) for r in out.collect()] == [("001234", 7, "São"), ("10:11:12", None, "#NULO#")]
    nulls = read_delimited(spark, f"{tmp_path}/*/*.csv", SCHEMA, null_value="#NULO#")
    assert [r["note"] for r in nulls.collect()] == ["São", None]


def test_missing_column_is_named(spark, tmp_path):
    write(tmp_path / "x.csv", "note;code\na;b\n")
    with pytest.raises(ValueError, match="n"):
        read_delimited(spark, str(tmp_path), SCHEMA)


def test_quoted_and_positional(spark, tmp_path):
    write(tmp_path / "x.csv", '"c";"n";"t"\n"a;b";"3";"q"\n')
    out = read_delimited(spark, str(tmp_path), SCHEMA, by_name=False)
    assert tuple(out.first()) == ("a;b", 3, "q")


def test_folders_and_name_patterns(spark, tmp_path):
    write(tmp_path / "a" / "b" / "x_ALL.csv", "code;n;note\n1;1;x\n")
    write(tmp_path / "a" / "x_PART.csv", "code;n;note\n2;2;y\n")
    out = read_delimited(spark, str(tmp_path), SCHEMA, recursive=True, file_glob="*_ALL.csv")
    assert [r["code"] for r in out.collect()] == ["1"]


def test_each_layout_is_bound_by_its_own_header(spark, tmp_path):
    schema = T.StructType.fromDDL("x int, y string")
    write(tmp_path / "a.csv", "x;y\n1;one\n")
    write(tmp_path / "b.csv", "y;x\nthree;3\n")
    write(tmp_path / "c.csv", "z;x;y\nzz;5;five\n")
    layouts = [f"{tmp_path}/{n}*.csv" for n in "abc"]
    assert sorted(map(tuple, read_delimited(spark, layouts, schema).collect())) == [(1, "one"), (3, "three"), (5, "five")]
    with pytest.raises(Exception):
        read_delimited(spark, f"{tmp_path}/[ab].csv", schema).collect()


def test_delimited_parts_have_headers(spark, tmp_path):
    df = spark.range(0, 100, 1, 5)
    write_delimited(df, str(tmp_path / "many"))
    assert len(glob.glob(f"{tmp_path}/many/*.csv")) == 5
    assert spark.read.options(header=True, sep=";").csv(str(tmp_path / "many")).count() == 100


def test_sorted_files_are_in_order_and_hot_values_spread(spark, tmp_path):
    # a third of the rows share one key value
    df = spark.range(0, 30000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 15000).otherwise(F.col("id")).alias("k"), "id"
    )
    write_sorted(df, str(tmp_path / "s"), ["k"], partitions=10)
    files = (
        spark.read.parquet(str(tmp_path / "s"))
        .groupBy(F.col("_metadata.file_name").alias("f"))
        .agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
        .orderBy("f")
        .collect()
    )
    assert sum(r["n"] for r in files) == 30000
    assert all(a["high"] <= b["low"] for a, b in zip(files, files[1:], strict=False))
    assert max(r["n"] for r in files) < 8000
    for f in glob.glob(f"{tmp_path}/s/*.parquet"):
        import pyarrow.parquet as pq

        keys = pq.read_table(f)["k"].to_pylist()
        assert keys == sorted(keys)


def test_partitioned_export_prunes(spark, tmp_path):
    write_partitioned(spark.range(100).withColumn("g", F.col("id") % 4), str(tmp_path / "p"), ["g"])
    one = spark.read.parquet(str(tmp_path / "p")).where("g = 2")
    assert one.count() == 25
    assert "PartitionFilters: [isnotnull(g" in one._jdf.queryExecution().executedPlan().toString()


def test_stages_use_the_shared_folder(spark):
    store = StageStore(spark)
    assert store.root.startswith(spark.conf.get("spark.checkpoint.dir")) and shared_root(spark) in store.root
    back = store.write("x", spark.range(5))
    assert back.count() == 5 and store.read("x").count() == 5
    assert "Range" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from tallyloom.catalog import QUERIES

    plan = QUERIES["filter_eq"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(l_linenumber,2)" in plan
    assert "l_extendedprice" not in plan


LINES = "code;n;note;extra\n1;7;good;x\n2;seven;bad number;x\n3;;absent;x\n4;8\n5;9;long;x;y\n\n6;99999999999;too large;x\n"


def test_quarantine_keeps_every_line(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", LINES)
    write(tmp_path / "in" / "b.csv", "code;n;note;extra\n7;1;good;x\n")
    write(tmp_path / "other" / "c.csv", "n;note;code\nX;bad;8\n2;good;9\n")
    lines = checked_lines(spark, [f"{tmp_path}/in/*.csv", f"{tmp_path}/other"], SCHEMA)
    good, bad = quarantine(StageStore(spark, f"{tmp_path}/stages"), "lines", lines)
    assert good.columns == SCHEMA.fieldNames()
    assert sorted(tuple(r) for r in good.collect()) == [("1", 7, "good"), ("3", None, "absent"), ("7", 1, "good"), ("9", 2, "good")]
    rows = bad.collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], [tuple(p) for p in r["problems"]]) for r in rows if r["line"]) == [
        ("a.csv", "4;8", []),
        ("a.csv", "5;9;long;x;y", []),
    ]
    assert sorted((r["file"].rsplit("/", 1)[1], [tuple(p) for p in r["problems"]]) for r in rows if not r["line"]) == [
        ("a.csv", [("n", "99999999999")]),
        ("a.csv", [("n", "seven")]),
        ("c.csv", [("n", "X")]),
    ]
    assert good.count() + bad.count() == 9
    summary = {(r["file"][-5:], r["column"]): (r["n_values"], r["example"]) for r in rejects_by_column(bad).collect()}
    assert summary == {("a.csv", "n"): (2, "99999999999"), ("a.csv", None): (2, "4;8"), ("c.csv", "n"): (1, "X")}


def test_quarantine_edges(spark, tmp_path):
    write(tmp_path / "empty" / "a.csv", "code;n;note\n")
    good, bad = quarantine(StageStore(spark, f"{tmp_path}/stages"), "none", checked_lines(spark, f"{tmp_path}/empty", SCHEMA))
    assert (good.count(), bad.count()) == (0, 0)
    write(tmp_path / "sentinel" / "a.csv", "code;n;note\n1;#NULO#;x\n1;2;x\n1;2;x\n")
    lines = checked_lines(spark, f"{tmp_path}/sentinel", SCHEMA)
    assert [len(r["_problems"]) for r in lines.orderBy(F.size("_problems")).collect()] == [0, 0, 1]
    assert checked_lines(spark, f"{tmp_path}/sentinel", SCHEMA, null_value="#NULO#").where(F.size("_problems") > 0).isEmpty()
    text_only = T.StructType([T.StructField("note", T.StringType())])
    assert checked_lines(spark, f"{tmp_path}/sentinel", text_only).where(F.size("_problems") == 0).count() == 3
    with pytest.raises(ValueError, match="missing"):
        checked_lines(spark, f"{tmp_path}/sentinel", T.StructType([T.StructField("absent", T.StringType())]))
    with pytest.raises(ValueError, match="reserved"):
        checked_lines(spark, f"{tmp_path}/sentinel", T.StructType([T.StructField("_line", T.StringType())]))


def test_bucketed_stages_join_and_fold_without_a_shuffle(spark, tmp_path):
    store = StageStore(spark, f"{tmp_path}/stages")
    left = spark.range(1000).selectExpr("id % 300 AS k", "id AS a")
    right = spark.range(300).selectExpr("id AS k", "id * 2 AS b")
    x, y = store.write_bucketed("x", left, ["k"], 4), store.write_bucketed("y", right, ["k"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = x.join(y, "k").groupBy("k").agg(F.sum("a").alias("a"), F.max("b").alias("b"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {r["k"]: (r["a"], r["b"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan
    assert rows == {k: (sum(range(k, 1000, 300)), 2 * k) for k in range(300)}
    assert len(glob.glob(f"{tmp_path}/stages/x/*.parquet")) == 4
    with pytest.raises(ValueError):
        store.write_bucketed("x", left, [], 4)
    store.remove()
    assert not glob.glob(f"{tmp_path}/stages/x")
