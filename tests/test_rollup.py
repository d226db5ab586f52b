"""Reports from one fold against the same reports from the rows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import oracle
from tallyloom.catalog import QUERIES
from tallyloom.operators import CELLS, Folds, compare_by, crosstab_long, fold, having_mixed_groups
from tallyloom.plans import reports, standin
from tallyloom.sources import StageStore


def same(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes
    assert oracle.bag(a.columns, [tuple(r) for r in a.collect()]) == oracle.bag(b.columns, [tuple(r) for r in b.collect()])


@pytest.fixture(scope="module")
def store(spark):
    return StageStore(spark)


@pytest.fixture(scope="module")
def sec(spark, sf_dir, store):
    rows = standin.sections(spark, sf_dir)
    # NULL dims and measures, and a group of its own
    odd = rows.limit(30).withColumns({"region": F.lit(None).cast("string"), "model": F.lit(None).cast("int"), "a_votes": F.lit(None).cast("long")})
    return store.write("sec", rows.unionAll(odd.select(*rows.columns)))


@pytest.fixture(scope="module")
def names():
    return replace(standin.NAMES, zone_limit=10**15)


@pytest.fixture(scope="module")
def folds(sec, names, store):
    return reports.fold_reports(sec, sec, store, names)


def test_every_comparison(sec, names, folds):
    direct, folded = reports.comparisons(sec, sec, names), folds.comparisons()
    assert list(direct) == list(folded) and len(direct) == 23
    for name in direct:
        same(direct[name](), folded[name]())


def test_mixed_groups(sec, store):
    options = dict(key="nation", a="a_votes", b="r_votes", labels=["region"], size="eligible", max_size=10**15, flag="late")
    folds = Folds.store(store, "mixed", sec, {"nation": "nation", "late": "late"}, [["nation", "late"]], sums=["a_votes", "r_votes", "eligible"], maxima=["region"])
    direct = having_mixed_groups(sec, **options)
    same(direct, having_mixed_groups(folds.smallest({"nation", "late"}), **options, of=CELLS))
    assert direct.count() > 0


@pytest.mark.parametrize("wide", [True, False])
def test_every_contingency_table(sec, names, folds, wide):
    direct, folded = reports.crosstabs(sec, names, wide=wide), folds.crosstabs(wide=wide)
    assert list(direct) == list(folded) and len(direct) == 12
    for name in direct:
        same(direct[name](), folded[name]())


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_rows_are_read_once(sec, folds):
    cells = fold(sec, {"region": "region", "late": "late"}, [["region"], ["late"], []], sums=["a_votes"])
    assert scans(cells) == 1
    for make in {**folds.comparisons(), **folds.crosstabs()}.values():
        df = make()
        assert scans(df) == 1 and all("/folds_" in f for f in df.inputFiles())


def test_smallest_fold_answers(spark, folds, names):
    for k, s in enumerate(folds.p.sets):
        assert folds.p.sizes[k] == folds.p.cells.where(F.col("cell_set") == k).count() > 0
    assert sum(folds.p.sizes[1:]) < 3000
    with pytest.raises(ValueError):
        folds.p.smallest({"zone_id", "late"})


def test_edges(spark, store):
    rows = [(None, 1, 5, 2.5), (None, 2, None, 0.5), ("a", 1, 7, None), ("a", None, -7, 1.5), ("a", None, 2**40, 1e9), ("b", 3, 1, 1.0)]
    df = spark.createDataFrame(rows, "d string, e int, x long, y double")
    folds = Folds.store(store, "edges", df, {"d": "d", "e": "e"}, [["d", "e"], ["d"], []], squares=["x", "y"])
    assert folds.sizes == [5, 3, 1]
    for dims in ("d", ["d", "e"]):
        for where in (None, F.col("d") == "a"):
            reads = {dims} if isinstance(dims, str) else set(dims)
            same(
                compare_by(df, dims, "x", "y", where=where, count="n", stddev=True),
                compare_by(folds.smallest(reads), dims, "x", "y", where=where, count="n", stddev=True, of=CELLS),
            )
    same(crosstab_long(df, "d", "e"), crosstab_long(folds.smallest({"d", "e"}), "d", "e", of=CELLS))
    none = Folds.store(store, "nothing", df.limit(0), {"d": "d"}, [["d"]], sums=["x", "y"])
    assert compare_by(none.smallest({"d"}), "d", "x", "y", of=CELLS).count() == 0
    with pytest.raises(ValueError):
        fold(df, {"d": "d"}, [["d"], ["d"]])


def test_sums_beyond_bigint_stay_exact(spark, tmp_path):
    """The squares of large keys add up to more than a bigint holds."""
    keys = [1 << 40, (1 << 40) + 1, 3]
    lines = spark.createDataFrame(
        [(k, i, "A" if i else "N", 5 + i) for i, k in enumerate(keys)], "l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long"
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    cells = QUERIES["fold_cells"](spark, str(tmp_path))
    whole = cells.where("cell_set = 2").first()
    assert whole["square_l_orderkey"] == sum(k * k for k in keys) > 1 << 63
    assert whole["total_l_orderkey"] == sum(keys) and dict(cells.dtypes)["total_l_orderkey"] == "bigint"
    small = QUERIES["fold_cells"](spark, "/root/testdata/sf0.001")
    assert dict(small.dtypes)["square_l_orderkey"] == "bigint"


def test_texts_are_not_sorted_by_row(spark):
    """Greatest texts, NULL ones among them, from cells; only these are sorted, after the hash fold of the rows."""
    rows = spark.sql(
        """SELECT id % 3 AS a, IF(id % 4 = 0, NULL, id % 2) AS b, id AS v, CAST(id AS DOUBLE) AS d, id * 1000000007 AS w,
                  IF(id % 5 = 0, NULL, CAST(id % 7 AS STRING)) AS t FROM RANGE(200)"""
    )
    sets = [["a", "b"], ["b"], []]
    cells = fold(rows, {"a": "a", "b": "b"}, sets, sums=["v", "d"], squares=["w"], maxima=["t"])
    plain = fold(rows, {"a": "a", "b": "b"}, sets, sums=["v", "d"], squares=["w"])
    keys = ["cell_set", "a", "b"]
    assert [f for f in cells.dtypes if f[0] != "max_t"] == plain.dtypes
    same(cells.drop("max_t"), plain)
    by = {tuple(r[k] for k in keys): r["max_t"] for r in cells.collect()}
    for k, group in enumerate(sets):
        for r in rows.groupBy(*group).agg(F.max("t").alias("t")).collect():
            assert by[(k, *(r[c] if c in group else None for c in "ab"))] == r["t"]
    plan = cells._jdf.queryExecution().sparkPlan().toString()
    scan = plan[plan.rindex("SortAggregate") :]
    assert scan.count("HashAggregate") >= 2 and scan.index("HashAggregate") < scan.index("Range")
