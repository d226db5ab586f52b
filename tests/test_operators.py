"""Operators on small frames: edges, policies, stability and skew."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import (
    LateRule,
    elapsed_seconds,
    floor_positive,
    late_expr,
    list_item_count,
    parse_date_time,
    parse_timestamp,
    range_bucket,
    sentinel_flag,
)
from tallyloom.operators import (
    FanoutError,
    compare_by,
    crosstab_wide,
    density_grid,
    density_levels,
    distinct_list,
    enrich_detail,
    first_row_per_key,
    fit_mixture,
    hash_sample,
    join_left,
    k_sweep,
    left_join_default,
    load_mixture,
    save_mixture,
    schema_differences,
    schema_profile,
    standard_scale,
    top_n,
    unique_side,
    wide_tally,
)
from tallyloom.operators.mixture import partitions_for
from tallyloom.operators.mixture import bic


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "number,model",
    [
        (999499, 1), (999500, 2009), (1220500, 2009), (1220501, 2010), (1345500, 2010), (1345501, 1), (1368501, 2011),
        (1650000, 2011), (1650001, 2013), (1701000, 2013), (1750000, 2015), (2250000, 2020), (2250001, 1), (None, 1),
    ],
)
def test_model_ranges(spark, number, model):
    from tallyloom.plans.election import MODEL_OTHER, MODEL_RANGES

    df = spark.createDataFrame([(number,)], "n bigint")
    assert df.select(range_bucket("n", MODEL_RANGES, MODEL_OTHER)).first()[0] == model


def test_timestamps_never_fail(spark):
    df = spark.createDataFrame(
        [("30/10/2022 17:05:09",), ("#NULO#",), ("31/02/2022 00:00:00",), ("2022-10-30 17:05:09",), (None,), ("",)],
        "t string",
    )
    found = [str(r[0]) for r in df.select(parse_timestamp("t")).collect()]
    assert found == ["2022-10-30 17:05:09"] + ["None"] * 5
    minute = spark.createDataFrame([("30/10/2022 17:05",)], "t string")
    assert str(minute.select(parse_timestamp("t", "dd/MM/yyyy HH:mm")).first()[0]) == "2022-10-30 17:05:00"


def test_timestamps_keep_the_clock_in_any_zone(spark):
    df = spark.createDataFrame([("30/10/2022 17:05:09",)], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert str(df.select(parse_timestamp("t")).first()[0]) == "2022-10-30 17:05:09"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_and_time_parts(spark):
    df = spark.createDataFrame([("30/10/2022", "10:11:12"), ("30/10/2022", None), ("#NULO#", "10:11:12")], "d string, t string")
    for skip in (False, True):
        found = [str(r[0]) for r in df.select(parse_date_time("d", "t", skip_nulls=skip)).collect()]
        assert found == ["2022-10-30 10:11:12", "None", "None"]


def test_sentinels_and_lists(spark):
    df = spark.createDataFrame([("#NULO#",), ("a",), (None,), ("10 / 20 / 30",)], "x string")
    flags = df.select(sentinel_flag("x"), sentinel_flag("x", unmatched="null"), list_item_count("x")).collect()
    assert [tuple(r) for r in flags] == [(0, 0, 0), (1, 1, 1), (1, None, 0), (1, 1, 3)]


def test_floor(spark):
    df = spark.createDataFrame([(None,), (0.0,), (-1.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(floor_positive("x")).collect()] == [0.001, 0.001, 0.001, 0.5]


def test_elapsed_is_signed(spark):
    df = spark.sql("SELECT timestamp_ntz'2022-01-01 00:00:10' AS a, timestamp_ntz'2022-01-01 00:00:00' AS b")
    assert tuple(df.select(elapsed_seconds("a", "b"), elapsed_seconds("b", "a")).first()) == (10, -10)


def test_late_rules_with_null_area(spark):
    rules = [LateRule("2022-01-01 12:00:00", {"area": ["A"]}, {"town": ["t"]})]
    df = spark.sql(
        """SELECT * FROM VALUES (timestamp_ntz'2022-01-01 12:00:01', 'A', 'x'), (timestamp_ntz'2022-01-01 12:00:00', 'A', 'x'),
           (timestamp_ntz'2022-01-01 12:00:01', 'A', 't'), (timestamp_ntz'2022-01-01 12:00:01', NULL, 'x'),
           (NULL, 'A', 'x') AS t(ts, area, town)"""
    )
    assert [r[0] for r in df.select(late_expr("ts", rules)).collect()] == [1, 0, 0, 0, 0]


def test_distinct_list_domain_refuses_strays(spark):
    df = spark.createDataFrame([(1, 2020), (1, 2009), (1, 2020), (2, None)], "k int, v int")
    found = rows(df.groupBy("k").agg(distinct_list("v", domain=[2009, 2020])))
    assert found == [(1, "2009,2020"), (2, "")]
    assert rows(df.groupBy("k").agg(distinct_list("v"))) == found
    with pytest.raises(Exception, match="outside the domain"):
        df.groupBy("k").agg(distinct_list("v", domain=[2009])).collect()


def test_picked_row_is_one_row(spark):
    df = spark.createDataFrame([(1, "b", "x", 1), (1, "a", "z", 2), (1, "a", None, 4)], "k int, p string, q string, n int")
    wide = wide_tally(df, ["k"], "p", "n", {"a": "na", "b": "nb"}, constants={"p": "p", "q": "q"})
    assert rows(wide) == [(1, "a", None, 6, 1)]
    by_column = wide_tally(df, ["k"], "p", "n", {"a": "na"}, constants={"p": "p", "q": "q"}, pick="column")
    assert rows(by_column) == [(1, "a", "x", 6)]


def test_unique_side_policies(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    with pytest.raises(FanoutError):
        unique_side(df, ["k"])
    assert rows(unique_side(df, ["k"], "dedupe")) == [(1, "a"), (2, "c")]
    assert unique_side(df, ["k"], "allow").count() == 3
    assert rows(unique_side(df.where("k = 2"), ["k"])) == [(2, "c")]
    assert first_row_per_key(df.select("k"), ["k"]).count() == 2


def test_left_join_default_keeps_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5)], "k int, v int")
    out = left_join_default(left, right, ["k"], {"v": 0}, {"seen": "v"})
    assert sorted(out.collect(), key=str) == sorted([(1, 5, 1), (None, 0, 0)], key=str)


def test_compare_with_zero_opponent(spark):
    df = spark.createDataFrame([("x", 3, 0), ("y", 3, 2)], "d string, a int, b int")
    assert [tuple(r) for r in compare_by(df, "d", "a", "b").collect()] == [("y", 3, 2, 1, 0.5), ("x", 3, 0, 3, None)]


def test_crosstab_is_typed_and_counts_nulls(spark):
    df = spark.createDataFrame([(10, 1), (9, 1), (9, None), (None, 2)], "r int, c int")
    out = crosstab_wide(df, "r", "c", [1, None], ordered=True)
    assert out.columns == ["r", "c_1", "c_null", "c_other"]
    assert [tuple(r) for r in out.collect()] == [(9, 1, 1, 0), (10, 1, 0, 0), (None, 0, 0, 1)]
    assert [tuple(r) for r in crosstab_wide(df, "r", "c", [2], ordered=True).collect()] == [(9, 0, 2), (10, 0, 1), (None, 1, 0)]


@pytest.mark.parametrize("hot_rows", [1, 2, 70, 1499, 1500, 10**6])
def test_left_join_splits_a_hot_right_key(spark, hot_rows):
    left = spark.range(50).select(F.when(F.col("id") < 40, F.col("id")).alias("k"), "id", F.lit(9).alias("_share"))
    right = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 > 0, F.col("id") % 30).alias("k"), (F.col("id") % 20).alias("v")
    )
    plain = left.join(right, ["k"], "left")
    out = join_left(left, right, ["k"], hot_rows=hot_rows)
    assert out.columns == plain.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    empty = right.where("false")
    assert sorted(map(str, join_left(left, empty, ["k"], hot_rows=hot_rows).collect())) == sorted(
        map(str, left.join(empty, ["k"], "left").collect())
    )


def test_left_join_by_two_keys_reads_the_left_once(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    other = lines.select("l_orderkey", (F.col("l_linenumber") % 2 + 1).alias("l_linenumber"), F.col("l_quantity").alias("q"))
    on = ["l_orderkey", "l_linenumber"]
    out = join_left(lines, other, on, hot_rows=2)
    assert sorted(map(str, out.collect())) == sorted(map(str, lines.join(other, on, "left").collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_quantity") and plan.count("Relation") == 4  # left, right and the right's keys for either side


@pytest.mark.parametrize("hot_rows", [1, 3, 10**6])
def test_detail_join_with_a_hot_extra_key(spark, hot_rows):
    base = spark.range(60).select((F.col("id") % 11).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("e"), "id")
    match = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 2).alias("m"))
    extra = spark.range(40).select(F.when(F.col("id") < 30, 2).otherwise(F.col("id") % 4).alias("e"), F.col("id").alias("x"))
    names = ["k"], extra, ["e"], {"m": "m"}, {"x": "x", "none": F.col("extra.x").isNull()}
    out = enrich_detail(base, match, *names, hot_rows=hot_rows)
    plain = base.alias("b").join(match, "k").join(extra.alias("x"), F.col("b.e") == F.col("x.e"), "left")
    want = plain.select("b.k", "b.e", "b.id", "m", "x.x", F.col("x.x").isNull().alias("none"))
    assert out.columns == want.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_top_n_of_ties_and_nan(spark):
    df = spark.range(0, 2000, 1, 6).select("id", F.when(F.col("id") % 2 == 0, 0.7).otherwise(F.col("id") / 2000).alias("v"))
    df = df.unionAll(spark.createDataFrame([(5000, float("nan")), (5001, None), (5002, 9.0)], "id long, v double"))
    for n in (1, 2, 400, 900, 1990, 5000):
        plain = [r["id"] for r in top_n(df, "v", n, ["id"]).collect()]
        assert [r["id"] for r in top_n(df, "v", n, ["id"], bounds=(0.0, 1.0)).collect()] == plain


def test_profile_of_nothing_and_of_negative_zero(spark):
    empty = {r["column_name"]: tuple(r)[4:] for r in schema_profile(spark.createDataFrame([], "a int, b string"), distinct="all").collect()}
    assert empty == {"a": (0, 0, 0, 0), "b": (0, 0, 0, 0)}
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "x double")
    assert tuple(schema_profile(zeros, distinct="all").first())[4:] == (3, 1, 0, 1)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    kept = rows(hash_sample(df.repartition(3), ["id"], 0.1))
    assert kept == rows(hash_sample(df.repartition(11), ["id"], 0.1)) and 400 < len(kept) < 600
    assert hash_sample(df, ["id"], 0.0).count() == 0


def test_levels_by_brute_force(spark):
    counts = {"g": [50, 30, 10, 5, 3, 1, 1], None: [2, 2, 2]}
    data = [(h, i, 0, n) for h, ns in counts.items() for i, n in enumerate(ns)]
    grid = spark.createDataFrame(data, "h string, cell_x bigint, cell_y bigint, n bigint")
    found = {(r["h"], r["cell_x"]): r["level"] for r in density_levels(grid, "h").collect()}
    for h, ns in counts.items():
        lines = []
        for p in (0.05, 0.525, 1.0):
            lines.append(max(c for c in ns if sum(x for x in ns if x >= c) >= (1 - p) * sum(ns)))
        for i, n in enumerate(ns):
            assert found[(h, i)] == sum(n >= line for line in lines)


def test_grid_leaves_out_points_without_coordinates(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("a", 0.1, 0.2), ("a", -0.01, 0.2)], "h string, x double, y double")
    assert rows(density_grid(df, "x", "y", 0.1, 0.1, "h")) == [("a", -1, 2, 1), ("a", 1, 2, 1)]


@pytest.mark.parametrize("n", [0, 1, 7, 100, 5000])
@pytest.mark.parametrize("bounds", [(0.0, 1.0), (0.2, 0.3), (-5.0, 50.0)])
def test_pruned_top_n_equals_plain(spark, n, bounds):
    # a third of the rows share one value, some have none
    value = F.when(F.col("id") % 3 == 0, 0.25).when(F.col("id") % 50 == 1, None).otherwise(F.rand(3))
    df = spark.range(2000).select("id", value.alias("v")).cache()
    assert rows_in_order(top_n(df, "v", n, ["id"], bounds=bounds)) == rows_in_order(top_n(df, "v", n, ["id"]))


def rows_in_order(df):
    return [tuple(r) for r in df.collect()]


def test_profile(spark):
    df = spark.createDataFrame([("#NULO#", 1), ("a", None), ("a" * 100, 1)], "s string, n int")
    found = {r["column_name"]: tuple(r)[4:] for r in schema_profile(df, distinct="all").collect()}
    assert found == {"s": (3, 0, 1, 3), "n": (3, 1, 0, 1)}
    declared = T.StructType.fromDDL("s string, n bigint, z int")
    assert schema_differences(df, declared) == ["missing z", "n: int instead of bigint"]


def blobs(spark):
    a = spark.range(400).select(
        "id",
        (F.randn(1) + F.when(F.col("id") % 2 == 0, 10.0).otherwise(0.0)).alias("x"),
        F.randn(2).alias("y"),
    )
    return a.cache()


def test_mixture_finds_blobs_and_reloads(spark, tmp_path):
    df = blobs(spark)
    fit = fit_mixture(df, ["x", "y"], ["id"], k=2, partitions=4)
    labels = fit.assign(df).groupBy((F.col("id") % 2).alias("side"), "prediction").count()
    assert labels.count() == 2 and fit.n_rows == 400
    save_mixture(fit, str(tmp_path / "m"))
    again = load_mixture(str(tmp_path / "m")).transform(df)
    assert rows(again.select("id", "prediction")) == rows(fit.assign(df).select("id", "prediction"))


def test_mixture_is_the_same_for_any_input_partitioning(spark):
    df = blobs(spark)
    fits = [fit_mixture(df.repartition(n), ["x", "y"], ["id"], k=3, partitions=4, max_iter=10) for n in (1, 7)]
    # partial sums of tasks merge in the order the tasks end, so the last digits may differ
    assert fits[0].log_likelihood == pytest.approx(fits[1].log_likelihood, rel=1e-9)
    assert rows(fits[0].assign(df).select("id", "prediction")) == rows(fits[1].assign(df).select("id", "prediction"))


def test_scaling_keeps_the_groups(spark):
    df = blobs(spark)
    raw = fit_mixture(df, ["x", "y"], ["id"], k=2, partitions=4)
    scaled = fit_mixture(df, ["x", "y"], ["id"], k=2, partitions=4, scaled=True)
    assert rows(raw.assign(df).select("id", "prediction")) == rows(scaled.assign(df).select("id", "prediction"))


def test_sweep_and_null_features(spark):
    df = blobs(spark)
    fits = k_sweep(df, ["x", "y"], ["id"], ks=[2, 3], partitions=4)
    assert [f.k for f in fits] == [2, 3] and fits[0].bic < fits[1].bic
    assert bic(-10.0, 1, 2, 100) == pytest.approx(20 + 5 * 4.605170185988092)
    holes = df.withColumn("x", F.when(F.col("id") > 0, F.col("x")))
    with pytest.raises(Exception):
        fit_mixture(holes, ["x", "y"], ["id"], k=2, partitions=2)
    fit = fit_mixture(holes, ["x", "y"], ["id"], k=2, partitions=2, invalid="skip")
    assert fit.n_rows == 399
    labelled = fit.assign(holes)
    assert labelled.count() == holes.count() and labelled.where("prediction is null").count() == holes.count() - 399


def test_standard_scale(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, x double")
    scaled = [v for _, v in rows(standard_scale(df, ["x"], ["id"]))]
    assert scaled == pytest.approx([0.5**0.5, 3 * 0.5**0.5])


def test_hot_key_is_folded_in_the_map_tasks(spark):
    """A third of all rows under one key: what is shuffled is one row per key and map task."""
    df = spark.range(0, 90000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("c"), F.lit(1).alias("n")
    )
    wide = wide_tally(df, ["k"], "c", "n", {0: "even", 1: "odd"})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")
    hot = wide.where("k = 0").first()
    assert hot["even"] + hot["odd"] == 30000
    assert wide.agg(F.sum("even") + F.sum("odd")).first()[0] == 90000


@pytest.mark.parametrize("extra_key", ["g", "k"])
def test_hot_join_key_is_split(spark, extra_key):
    """The detail join splits the partition of a hot key at run time and keeps every row."""
    from tallyloom.operators import enrich_detail

    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        base = spark.range(0, 120000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
            (F.col("id") % 1000).alias("g"),
            F.sha2(F.col("id").cast("string"), 256).alias("x"),
        )
        side = spark.range(120000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
        extra = side.withColumnRenamed("k", extra_key)
        out = enrich_detail(base, side, ["k"], extra, [extra_key], {"v": "v"}, {"w": "v"})
        assert len(out.collect()) == 120000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("value", ["id % 7", "CAST(pow(1.001D, id) AS DOUBLE)", "IF(id % 3 = 0, CAST('NaN' AS DOUBLE), id)", "CAST(NULL AS DOUBLE)", "CAST(id % 90 AS DECIMAL(9, 2))"])
def test_top_n_finds_its_own_cut(spark, monkeypatch, value):
    from tallyloom.operators import topn

    df = spark.range(0, 3000, 1, 5).selectExpr("id", f"IF(id % 10 = 1, NULL, {value}) AS v")
    want = {n: [r["id"] for r in top_n(df, "v", n, ["id"]).collect()] for n in (1, 40, 700, 2999, 5000)}
    monkeypatch.setattr(topn, "TAKE", 0)
    for n, ids in want.items():
        assert [r["id"] for r in top_n(df, "v", n, ["id"]).collect()] == ids


def test_cut_off_leaves_few_rows(spark):
    from tallyloom.operators.topn import cut_off

    df = spark.range(100_000).selectExpr("CAST(exp(id % 1000 / 100D) AS DOUBLE) AS v")
    for n in (50, 1000, 20_000):
        cut = cut_off(df, "v", n)
        assert n <= df.where(F.col("v") >= cut).count() <= 2.2 * n + 100
    assert cut_off(df, "v", 90_000) is None
    assert cut_off(df.limit(0), "v", 1) is None


def test_em_partitions_stay_few(spark):
    """Every pass sends two task results per partition to the driver."""
    assert [partitions_for(n) for n in (0, 1, 20_001, 640_000, 8_000_000)] == [1, 1, 2, 32, 32]
    assert partitions_for(54_000_000) == 216 and partitions_for(100, 10) == 10


def test_sweep_keeps_the_order_of_sizes(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.rand(1).alias("y"))
    fits = k_sweep(df, ["x", "y"], ["id"], ks=[3, 2, 4, 3], max_iter=3)
    assert [(f.k, f.model.getK()) for f in fits] == [(3, 3), (2, 2), (4, 4), (3, 3)]
    alone = fit_mixture(df, ["x", "y"], ["id"], k=4, max_iter=3)
    assert fits[2].log_likelihood == pytest.approx(alone.log_likelihood)
