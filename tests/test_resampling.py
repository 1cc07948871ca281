"""Plans, random resampling, encoders and recipes: properties and errors."""

import pytest
from pyspark.sql import functions as F

from evenkeel import FeatureSpec
from evenkeel.functions.draws import normal, uniform
from evenkeel.operators import columns, encode, levels, resample, splits
from evenkeel.plans import sampling
from evenkeel.spec import check_feature_order, reject_nulls


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("y"), (F.col("id") * 0.5).alias("a"),
        F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("c")).cache()


def test_plan_errors(spark, rows):
    with pytest.raises(ValueError, match="below"):
        sampling.sampling_plan(rows, "y", {1: 5})
    with pytest.raises(ValueError, match="not in the table"):
        sampling.sampling_plan(rows, "y", {7: 5})
    with pytest.raises(ValueError, match="two classes"):
        sampling.sampling_plan(rows, "c", 0.5)
    with pytest.raises(ValueError, match="empty"):
        sampling.sampling_plan(rows.limit(0), "y")
    with pytest.raises(ValueError, match="unknown strategy"):
        sampling.sampling_plan(rows, "y", "most")


def test_counts_equal_the_plan_and_real_rows_stay(rows):
    plan = sampling.sampling_plan(rows, "y", {1: 333})
    out = resample.oversample_random(rows, "y", "id", plan).cache()
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 900, 1: 333}
    real = out.filter("not is_synthetic").drop("is_synthetic")
    assert real.exceptAll(rows).count() == 0 and rows.exceptAll(real).count() == 0
    under = resample.undersample_random(rows, "y", "id", sampling.undersampling_plan(rows, "y"))
    assert {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {0: 100, 1: 100}


def test_draw_table_is_cut_at_class_borders(spark, rows):
    plan = sampling.sampling_plan(rows, "c", {"l0": 3, "l1": 0, "l2": 5}, mode="new")
    draws = resample.draw_table(spark, plan).groupBy("c").agg(F.count("*").alias("n"), F.max("draw_id").alias("m"))
    assert {r["c"]: (r["n"], r["m"]) for r in draws.collect()} == {"l0": (3, 2), "l2": (5, 4)}


def test_weighted_sample_evens_out_classes(rows):
    half = resample.balanced_sample(rows, "y", "id", 150)
    got = {r["y"]: r["count"] for r in half.groupBy("y").count().collect()}
    assert sum(got.values()) == 150 and got[1] > 45
    every = resample.balanced_sample(rows, "y", "id")
    assert every.count() == 1000 and every.select("id").distinct().count() == 1000
    again = resample.balanced_sample(rows, "y", "id", 1000, replace=True)
    got = {r["y"]: r["count"] for r in again.groupBy("y").count().collect()}
    assert sum(got.values()) == 1000 and abs(got[1] - 500) < 80


def test_draws_look_like_their_law(spark):
    r = spark.range(20_000).select(uniform("id", 1).alias("u"), normal("id", 1).alias("z")).agg(
        F.avg("u"), F.var_pop("u"), F.avg("z"), F.var_pop("z")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and r[1] == pytest.approx(1 / 12, abs=0.003)
    assert r[2] == pytest.approx(0, abs=0.03) and r[3] == pytest.approx(1, abs=0.03)


def test_inverse_restores_the_input(rows):
    spec = FeatureSpec("y", "id", ["a"], ["c"])
    prep = encode.Preprocess(spec, [(encode.MinMax, ["a"]), (encode.OneHot, ["c"])])
    df = columns.order_features(rows, spec)
    prep.fit(df)
    back = prep.inverse(prep.transform(df).drop("c"))
    assert back.columns == spec.columns
    assert back.withColumn("a", F.round("a", 9)).exceptAll(df.withColumn("a", F.round("a", 9))).count() == 0


def test_unseen_level_is_all_zeros(spark, rows):
    enc = encode.OneHot.fit(rows, ["c"])
    new = spark.createDataFrame([("l9",), ("l1",)], "c string")
    got = {r["c"]: r["c_onehot"] for r in enc.transform(new).collect()}
    assert sum(got["l9"]) == 0 and got["l1"] == [0.0, 1.0, 0.0, 0.0]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    for kind in (encode.MinMax, encode.Standard):
        assert {r["a"] for r in kind.fit(df, ["a"]).transform(df).collect()} == {0.0}


def test_pooling_is_strict_and_covers_unseen(spark):
    train = spark.createDataFrame([("x",)] * 60 + [("r",)] * 59, "c string")
    test = spark.createDataFrame([("x",), ("r",), ("new",)], "c string")
    _, out = levels.pool_levels(train, test, ["c"])
    assert sorted(r["c"] for r in out.collect()) == ["___", "___", "x"]


def test_spec_checks(spark, rows):
    spec = FeatureSpec("y", "id", ["a"], ["c"])
    with pytest.raises(ValueError, match="ordered"):
        check_feature_order(["c", "a"], spec)
    with pytest.raises(ValueError, match="not in the table"):
        columns.order_features(rows.drop("a"), spec)
    with pytest.raises(ValueError, match="two roles"):
        FeatureSpec("y", "id", ["a"], ["a"])
    with pytest.raises(ValueError, match="null"):
        reject_nulls(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), spec)
    assert FeatureSpec.infer(rows, "y", "id") == spec


def test_dates_and_fills(spark):
    from evenkeel.plans.recipe import delivery_features

    df = spark.createDataFrame(
        [("2020-01-10", "2020-01-01", None, "2020-01-15"), ("2020-01-10", "2020-01-01", None, None)],
        "o string, c string, p string, d string")
    df = df.select(*[F.to_timestamp(x).alias(x) for x in df.columns])
    a, b = delivery_features(df, "o", "c", "p", "d").collect()
    assert (a["delivery_delay"], a["account_age"], a["order_delay"]) == (0, 14, 9)
    assert b["d"] == b["o"] and b["delivered_weekday"] == 4


def test_ladders(rows):
    thin = splits.thin_minority(rows, "y", 0.05, "id")
    got = {r["y"]: r["count"] for r in thin.groupBy("y").count().collect()}
    assert got[1] / sum(got.values()) == pytest.approx(0.05, abs=0.01)
    with pytest.raises(ValueError, match="two classes"):
        splits.thin_minority(rows, "c", 0.1, "id")
    with pytest.raises(ValueError, match="present"):
        splits.thin_majority(rows, "y", 0.01, "id")


def test_drop_constant(rows):
    df = rows.select("id", F.lit(0).alias("z"), F.lit(5).alias("k"))
    assert columns.drop_constant(df, ["z", "k"], value=0).columns == ["id", "k"]
    assert columns.drop_constant(df, ["z", "k"]).columns == ["id"]


def test_class_filter_needs_the_label(rows):
    with pytest.raises(ValueError):
        columns.filter_classes(rows, ["y", "c"], [1])
    with pytest.raises(ValueError):
        columns.filter_classes(rows, "nope", [1])
