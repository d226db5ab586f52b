"""The source-shaped tables that Spark derives against the text of the SQL checks, on odd rows."""

import pytest

from tallyloom.plans import derived
from tallyloom.plans.standin import table

TABLES = {
    "nation": ("n_nationkey int, n_name string", [(0, "ZERO"), (17, "SEVENTEEN"), (20, None), (41, "BEYOND")]),
    "customer": (
        "c_custkey bigint, c_nationkey int, c_mktsegment string",
        [(1, 0, "MACHINERY"), (2, 17, "BUILDING"), (3, 20, None), (4, 41, "HOUSEHOLD"), (5, None, "BUILDING"), (2, 17, "FURNITURE")],
    ),
    "supplier": ("s_suppkey bigint, s_nationkey int, s_acctbal double", [(1, 0, 512.0), (2, None, -3.0), (7, 17, None)]),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
        [
            (1, 1, "F", 1999.5, "1-URGENT"),
            (2, 2, "P", 250000.0, "1-URGENT"),
            (3, 3, "P", None, "5-LOW"),
            (4, 4, "O", 0.0, None),
            (5, 2, None, 1250.0, "2-HIGH"),
            (5, 2, "P", 1250.0, "1-URGENT"),
            (None, 1, "P", 1.0, "1-URGENT"),
            (6, None, "F", 1.0, "5-LOW"),
            (7, 5, "F", 1.0, "5-LOW"),
        ],
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
        [
            (1, 20, 25, 1, 3.0, "A", "F"),
            (1, 21, 26, 2, 4.9, "A", "F"),
            (1, 50, 27, 7, 1.0, "R", "F"),
            (2, 40, 50, 1, None, "N", "O"),
            (2, 40, 50, 1, None, "N", "O"),
            (2, None, 51, 2, 2.0, None, None),
            (3, 7, None, 3, 2.0, "N", "F"),
            (4, 60, 75, None, 9.0, "R", "O"),
            (5, 61, 75, 4, 9.0, "R", "O"),
            (6, 61, 75, 4, 9.0, "R", "O"),
            (7, 61, 75, 4, 9.0, "R", "O"),
            (None, 20, 25, 1, 3.0, "A", "F"),
        ],
    ),
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", derived.SOURCES)
def test_rows_at_size_are_those_of_the_text(spark, odd, name):
    text = derived.SOURCES[name]
    written = spark.sql(text, **{i: table(spark, odd, i) for i in TABLES if "{" + i + "}" in text})
    made = derived.source(spark, odd, name)
    assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in written.schema]
    rows, expected = (sorted(map(repr, df.collect())) for df in (made, written))
    assert rows == expected and rows


@pytest.mark.parametrize("name", ["results", "machines"])
def test_each_table_is_read_once(spark, odd, name):
    plan = derived.source(spark, odd, name)._jdf.queryExecution().optimizedPlan()
    read = [plan.collectLeaves().apply(i).output().apply(0).name() for i in range(plan.collectLeaves().size())]
    assert len(read) == len(set(read))
