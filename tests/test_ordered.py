"""Ranks, running sums and quantiles with hot values, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators.metrics import auc, tail_lift, top_lift
from evenkeel.operators.ordered import cumulative_by_value, quantile_table, rank_by_hash, rank_rows
from evenkeel.operators.splits import stratified_folds


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows share one value, and one class holds most rows."""
    return spark.range(20_000).select(
        "id", F.when(F.col("id") % 2 == 0, 7.0).otherwise((F.col("id") % 1000).cast("double")).alias("v"),
        F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("y")).cache()


def test_rank_is_a_permutation_in_value_order(hot):
    pdf = rank_rows(hot, "v", "id").toPandas().sort_values("rank")
    assert list(pdf["rank"]) == list(range(1, 20_001))
    assert (np.diff(pdf["v"]) >= 0).all()


def test_hot_value_is_spread_over_tasks(spark, hot):
    from evenkeel.operators import ordered

    seen = {}
    real = ordered._number

    def spy(df, by, buckets, *rest):
        seen["largest"] = df.groupBy(*buckets).count().agg(F.max("count")).first()[0]
        return real(df, by, buckets, *rest)

    ordered._number = spy
    try:
        rank_rows(hot, "v", "id").count()
    finally:
        ordered._number = real
    assert seen["largest"] < 20_000 / 8


def test_rank_repeats_under_other_partitioning(hot):
    a = rank_by_hash(hot, "id", "s", by=["y"]).toPandas().set_index("id")["rank"]
    b = rank_by_hash(hot.repartition(13), "id", "s", by=["y"]).toPandas().set_index("id")["rank"]
    assert a.sort_index().equals(b.sort_index())


def test_no_row_level_window_in_one_task(hot):
    plan = rank_rows(hot, "v", "id")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [row_number" in x]
    assert windows and all("__b" in w for w in windows)


def test_folds_are_balanced_and_disjoint(hot):
    sizes = stratified_folds(hot, "y", 7, "id").groupBy("y", "fold").count().toPandas()
    for _, g in sizes.groupby("y"):
        assert len(g) == 7 and g["count"].max() - g["count"].min() <= 1


def test_running_sums(hot):
    pdf = cumulative_by_value(hot, "v", {"n": F.lit(1)}, next_value=True).toPandas().sort_values("value")
    assert list(pdf["n_below"]) == [0, *np.cumsum(pdf["n"])[:-1]]
    assert list(pdf["next_value"])[:-1] == list(pdf["value"])[1:]


def test_quantiles_match_numpy(spark, hot):
    got = {r["q"]: r["value"] for r in quantile_table(hot, ["v"], [0.0, 0.13, 0.5, 0.999, 1.0]).collect()}
    v = hot.toPandas()["v"].to_numpy()
    for q, value in got.items():
        assert value == pytest.approx(np.quantile(v, q))


def test_edge_scores(spark):
    kinds = "id bigint, y int, s double"
    tied = spark.createDataFrame([(i, i % 2, 0.5) for i in range(10)], kinds)
    assert auc(tied, "y", "s").first()["auc"] == 0.5
    none = spark.createDataFrame([(i, 0, float(i)) for i in range(10)], kinds)
    assert auc(none, "y", "s").first()["auc"] is None
    assert top_lift(none, "y", "s", "id", 0.2).first()["top_lift"] is None
    best = spark.createDataFrame([(i, int(i >= 8), float(i)) for i in range(10)], kinds)
    assert top_lift(best, "y", "s", "id", 0.2).first()["top_lift"] == pytest.approx(5.0)
    assert tail_lift(best, "y", "s", "id", 0.1).first()["tail_lift"] == pytest.approx(1 / 0.9)
    with pytest.raises(ValueError):
        top_lift(best, "y", "s", "id", 0.0)
