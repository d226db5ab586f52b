"""Interval joins against comparing all with all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import interval_join, range_bucket_from_table
from tallyloom.operators.intervals import HIGHEST, LAST, LOWEST, STEP, cells_of, whole_cells

RANGES = "id int, low long, high long, label string, rank int"


def ranges_of_all_kinds():
    rng = random.Random(3)
    out = [(0, None, -50, "left", 5), (1, 900, None, "right", 5), (2, None, None, "all", 9), (3, 7, 3, "empty", 0), (4, LOWEST, HIGHEST, "full", 8)]
    out += [(5, 4, 4, "point", 1), (6, HIGHEST, HIGHEST, "last", 1), (7, LOWEST, LOWEST + 1, "least", 1), (8, -1, 0, "across", 2)]
    for k in range(9, 120):
        low = rng.randint(-1000, 1000)
        out.append((k, low, low + rng.choice([0, 1, 2, 3, 15, 16, 17, 200]), f"r{k}", rng.randint(0, 20)))
    return out


def values():
    rng = random.Random(4)
    return [None, LOWEST, LOWEST + 1, HIGHEST, HIGHEST - 1, -1, 0, 4, 4, 4, *(rng.randint(-1300, 1300) for _ in range(200))]


def holds(r, v):
    return v is not None and (r[1] is None or r[1] <= v) and (r[2] is None or v <= r[2])


def test_all_matches(spark):
    ranges, numbers = ranges_of_all_kinds(), list(enumerate(values()))
    df = spark.createDataFrame(numbers, "row int, v long").withColumn("level", F.lit(1)).withColumn("cell", F.lit("x"))
    got = interval_join(df, "v", spark.createDataFrame(ranges, RANGES), "low", "high")
    assert got.columns == ["row", "v", "level", "cell", "id", "low", "high", "label", "rank"]
    assert sorted((r["row"], r["id"]) for r in got.collect()) == sorted((k, r[0]) for k, v in numbers for r in ranges if holds(r, v))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_first_label(spark):
    ranges, numbers = [r for r in ranges_of_all_kinds() if r[0] not in (2, 4)], list(enumerate(values()))
    df = spark.createDataFrame(numbers, "tag int, label long")
    got = range_bucket_from_table(df, "label", spark.createDataFrame(ranges, RANGES), "low", "high", "label", "rank", "bucket", "none")
    want = {k: min(((r[4], r[3]) for r in ranges if holds(r, v)), default=(0, "none"))[1] for k, v in numbers}
    assert {r["tag"]: r["bucket"] for r in got.collect()} == want and len(set(want.values())) > 20 and "none" in want.values()
    for none in (df.limit(0), df):
        out = range_bucket_from_table(none, "label", spark.createDataFrame([], RANGES), "low", "high", "label", "rank", "bucket", "none")
        assert {r["bucket"] for r in out.collect()} <= {"none"} and out.count() == none.count()
    with pytest.raises(ValueError):
        interval_join(df, "label", spark.createDataFrame(ranges, RANGES), "low", "high")


def test_intervals_touch_few_cells(spark):
    ranges = spark.createDataFrame(ranges_of_all_kinds(), RANGES)
    assert cells_of(ranges, "low", "high").groupBy("id").count().agg(F.max("count")).first()[0] <= 2


def test_folded_matches_without_listing_them(spark):
    ranges, numbers = ranges_of_all_kinds() * 2, list(enumerate(values()))
    df = spark.createDataFrame(numbers, "row int, v long").withColumn("tier", F.lit(1))
    parts = interval_join(df, "v", spark.createDataFrame(ranges, RANGES), "low", "high", "n", {"total": "row"})
    assert parts.columns == ["id", "low", "high", "label", "rank", "n", "total"]
    got = parts.groupBy("id").agg(F.sum("n"), F.sum("total")).collect()
    held = {r[0]: [k for k, v in numbers for s in ranges if s[0] == r[0] and holds(s, v)] for r in ranges}
    assert {tuple(r) for r in got} == {(i, len(rows), sum(rows)) for i, rows in held.items() if rows}
    with pytest.raises(ValueError, match="taken"):
        interval_join(df, "v", spark.createDataFrame(ranges, RANGES), "low", "high", "rank")


def test_whole_cells_part_the_interval(spark):
    ranges = [r for r in ranges_of_all_kinds() if r[1] is None or r[2] is None or r[1] <= r[2]]
    cells = whole_cells(spark.createDataFrame(ranges, RANGES), "low", "high", F.lit(LOWEST), F.lit(HIGHEST))
    got = {}
    for r in cells.collect():
        first = max(r["cell"] << (STEP * r["tier"]), LOWEST)
        got.setdefault(r["id"], []).append((first, min(first + (1 << (STEP * r["tier"])) - 1, HIGHEST)))
    for r in ranges:
        runs = sorted(got[r[0]])
        assert runs[0][0] == (LOWEST if r[1] is None else r[1]) and runs[-1][1] == (HIGHEST if r[2] is None else r[2])
        assert all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:]))
        assert len(runs) <= 14 * (LAST + 1)


def test_open_intervals_are_not_listed(spark):
    """10,000 open intervals over 10,000 numbers: 100 million matches, of which no join makes more than the cells."""
    numbers = spark.range(10_000).select(F.col("id").alias("v"))
    ranges = spark.range(10_000).select(
        F.col("id").alias("rank"), F.lit(None).cast("long").alias("low"), (F.col("id") + 5000).alias("high"), F.col("id").cast("string").alias("label")
    )
    out = range_bucket_from_table(numbers, "v", ranges, "low", "high", "label", "rank", "bucket", "none")
    assert all(int(r["bucket"]) == max(0, r["v"] - 5000) for r in out.collect())
    rows = []

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        if "Join" in name:
            rows.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 1_000_000
