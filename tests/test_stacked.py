"""Logistic regressions of many training sets against Spark ML, and resampling inside sets."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenkeel import FeatureSpec
from evenkeel.operators import neighbors, synthetic
from evenkeel.operators.neighbors import links_within
from evenkeel.plans import evaluate, stacked
from evenkeel.plans.evaluate import SAMPLERS
from evenkeel.plans.sampling import sampling_plan
from evenkeel.plans.stacked import CLASS, ROW, SET, SetStack, StackedLogistic, fit_logistic

SPEC = FeatureSpec("y", "id", ["a", "b"], ["c"])
NUMBERS = FeatureSpec("y", "id", ["a", "b"])


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(400).select(
        "id", (F.rand(1) * 50).alias("a"), F.rand(2).alias("b"),
        F.element_at(F.array(F.lit("u"), F.lit("v"), F.lit("w")), (F.col("id") % 3 + 1).cast("int")).alias("c")).withColumn(
        "y", ((F.col("a") / 50 + 0.4 * F.rand(3) + 0.2 * (F.col("c") == "u").cast("int")) > 1.1).cast("int")).cache()


@pytest.fixture(scope="module")
def sets():
    return {0: F.col("id") % 4 != 0, 3: F.col("id") % 4 != 1, 5: F.col("id") < 250}


def test_coefficients_equal_spark_ml(spark, df, sets):
    models = StackedLogistic(df, SPEC, sets)
    models.add([models.resampled("unbalanced", {}), models.resampled("random", {})]).fit([0.05, 1, 100])
    assert len(models.thetas) == 18
    table = models.table
    for s in (0, 5, models.step + 3):
        rows = table.filter(F.col(SET) == s).select("y", array_to_vector("x").alias("x")).cache()
        n = rows.count()
        for i, c in enumerate([0.05, 1, 100]):
            want = LogisticRegression(labelCol="y", featuresCol="x", regParam=1 / (c * n), standardization=False,
                                      tol=1e-14, maxIter=2000).fit(rows)
            want = [*want.coefficients, want.intercept]
            assert models.thetas[s, i] == pytest.approx(want, abs=1e-6 * max(1, c))
        rows.unpersist()


def test_steps_that_overshoot_are_halved(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 30, (200, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(0, 5, 200) > 0).astype(float)  # steep and nearly separable
    table = spark.createDataFrame([(7, float(a), b.tolist()) for a, b in zip(y, x)], f"{SET} int, y double, x array<double>")
    theta = fit_logistic(table, 3, {7: [1000.0]})[7, 0]
    z = np.hstack([x, np.ones((200, 1))]) @ theta
    gradient = np.hstack([x, np.ones((200, 1))]).T @ (1 / (1 + np.exp(-z)) - y) + np.append(theta[:3], 0) / 1000
    assert np.abs(gradient).max() < 1e-5


def test_unseen_levels_and_single_classes(spark, df):
    sets = {0: F.col("c") != "w", 1: F.col("y") == 0, 2: F.col("y") == 1}
    models = StackedLogistic(df, SPEC, sets)
    models.add([models.resampled("unbalanced", {})]).fit([1.0])
    assert models.thetas[0, 0][4] == 0  # level w
    assert models.thetas[1, 0].tolist() == [0, 0, 0, 0, 0, -math.inf]
    scored = models.score(df, {s: F.lit(True) for s in sets}).collect()
    assert {r["score"] for r in scored if r[SET] == 1} == {0.0}
    assert {r["score"] for r in scored if r[SET] == 2} == {1.0}
    assert len(scored) == 3 * df.count()


def test_too_wide_fits_are_refused(spark, df):
    with pytest.raises(ValueError, match="too many sums"):
        fit_logistic(df, 5000, {0: [1.0]})


def _rows(table):
    return sorted(tuple(r) for r in table.collect())


def test_cleaning_inside_sets_equals_cleaning_each(spark, df, sets):
    stack = SetStack(df, SPEC, sets)
    both = stacked.cleaned(stack, stack.rows).select(CLASS, *SPEC.features)
    each = None
    for s, c in sets.items():
        one = stack.rows.filter(F.col(SET) == s)
        part = synthetic.clean_tomek(one, stack.inner).select(CLASS, *SPEC.features)
        each = part if each is None else each.unionByName(part)
    assert _rows(both) == _rows(each) and both.count() < stack.rows.count()


@pytest.mark.parametrize("spec", [SPEC, NUMBERS])
@pytest.mark.parametrize("sampler", ["SMOTE", "ADASYN", "generator", "random"])
def test_new_rows_stay_inside_their_set(spark, df, sampler, spec):
    """Sets that lie apart: a neighbour from another set would give a row between them."""
    apart = df.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")).otherwise(F.col("a") + 1000)).withColumn(
        "y", (F.col("id") % 7 < 2).cast("int"))
    sets = {0: F.col("id") % 2 == 0, 1: F.col("id") % 2 == 1}
    stack = SetStack(apart, spec, sets, scale=False)
    made = stacked.STACKED[sampler](stack, "auto", 0).select(stacked._set_of(CLASS).alias("s"), CLASS, "a").collect()
    assert {r["s"] for r in made} == {0, 1}
    for r in made:
        assert (r["a"] > 500) == (r["s"] == 1)
    for s in (0, 1):
        sizes = [sum(r[CLASS] == f"{s}|{y}" for r in made) for y in (0, 1)]
        assert abs(sizes[0] - sizes[1]) <= (0 if sampler != "ADASYN" else 25)


def test_other_samplers_are_called_for_each_set(spark, df, sets):
    stack = SetStack(df, SPEC, sets)
    seen = []

    def sampler(t, spec, strategy, seed):
        seen.append((t.count(), spec.key, strategy))
        return t

    rows = stacked.one_by_one(stack, sampler, "auto", 0)
    assert [n for n, *_ in seen] == [300, 300, 250] and {k for _, k, _ in seen} == {ROW}
    assert _rows(rows.select(CLASS, *SPEC.features)) == _rows(stack.rows.select(CLASS, *SPEC.features))


def test_adasyn_takes_categories_as_codes(spark, df):
    plan = sampling_plan(df, "y", "auto")
    out = synthetic.adasyn(df, SPEC, plan, 5, 0)
    new = out.filter("is_synthetic").collect()
    assert new and {r["c"] for r in new} <= {"u", "v", "w", None} and any(r["c"] is None for r in new)
    assert out.filter("not is_synthetic").count() == df.count()
    assert SAMPLERS["ADASYN"](df, SPEC, "auto", 0).count() == out.count()


def test_links_inside_sets_equal_brute_force(spark):
    """Copies, ties, repeated distances and sets of three classes; each set keeps its own smallest class."""
    rng = np.random.default_rng(11)
    n = 420
    pdf = pd.DataFrame({"id": [f"r{i:04d}" for i in range(n)], "a": rng.integers(0, 14, n) * 1.0, "b": rng.integers(0, 14, n) * 1.0,
                        "c": rng.choice(list("uv"), n), "of": rng.integers(0, 3, n)})
    pdf["y"] = [f"{s}|{v}" for s, v in zip(pdf["of"], np.where(rng.random(n) < 0.6, 0, rng.integers(1, 3, n)))]
    want = set()
    for _, one in pdf.groupby("of"):
        x, ids, y = one[["a", "b"]].to_numpy(), one["id"].to_numpy(), one["y"].to_numpy()
        d2 = ((x[:, None] - x[None]) ** 2).sum(2) + 2.25 * (one["c"].to_numpy()[:, None] != one["c"].to_numpy()[None])
        np.fill_diagonal(d2, np.inf)
        to = [int(np.lexsort((ids, d))[0]) for d in d2]
        want |= {(ids[i], ids[j], y[i], y[j]) for i, j in enumerate(to) if to[j] == i and ids[i] < ids[j] and y[i] != y[j]}
    asking = [f"{s}|{v}" for s in range(3) for v in (1, 2)]
    spec = FeatureSpec("y", "id", ["a", "b"], ["c"])
    for sizes in ({}, {"block_points": 20}):
        got = links_within(spark.createDataFrame(pdf), spec, "of", asking, 1.5, **sizes)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def _written(monkeypatch, name, size):
    """Sizes of the scratch tables of a name, in the order of writing."""
    sizes, plain = [], neighbors.write_scratch

    def spy(df, what):
        out = plain(df, what)
        if what == name:
            sizes.append(size(out))
        return out

    for module in (neighbors, stacked):
        monkeypatch.setattr(module, "write_scratch", spy)
    return sizes


def test_only_rows_that_matter_ask_for_neighbours(spark, monkeypatch):
    """The larger class asks neither in ADASYN nor, beyond the rows that were named, in Tomek links."""
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 256)
    rows = spark.range(3000).select("id", (F.rand(5) * 9).alias("a"), F.rand(6).alias("b"),
                                    (F.col("id") % 10 == 0).cast("int").alias("y")).cache()
    stack = SetStack(rows, NUMBERS, {0: F.lit(True), 1: F.col("id") < 2500})
    asked = _written(monkeypatch, "queries", lambda t: t.agg(F.sum(F.size("points"))).first()[0])
    stacked.STACKED["ADASYN"](stack, "auto", 0).count()
    assert asked and max(asked) <= 550
    asked.clear()
    stacked.STACKED["tomek"](stack, "auto", 0).count()
    assert len(asked) == 2 and asked[0] == 550 and asked[1] <= 550


def test_settings_of_smote_share_a_search(spark, df, sets, monkeypatch):
    models = StackedLogistic(df, SPEC, sets)
    alone = {k: _rows(models.resampled("SMOTE", {"k_neighbors": k}).select(CLASS, "c", F.round("a", 9), F.round("b", 9)))
             for k in (2, 4)}
    models, searches = StackedLogistic(df, SPEC, sets), _written(monkeypatch, "points", lambda t: 1)
    evaluate._resample_all(models, [("SMOTE", {"k_neighbors": 2}), ("SMOTE", {"k_neighbors": 4})], 0, None)
    assert len(searches) == 1
    together = [_rows(models.resampled("SMOTE", {"k_neighbors": k}).select(CLASS, "c", F.round("a", 9), F.round("b", 9)))
                for k in (2, 4)]
    assert together == [alone[2], alone[4]] and len(searches) == 1


def test_rows_of_several_resamplings_are_packed_once(spark, df, sets, monkeypatch):
    packed = _written(monkeypatch, "stacked", lambda t: t.agg(F.sum("n")).first()[0])
    models = StackedLogistic(df, SPEC, sets)
    names = ("unbalanced", "random", "SMOTE", "tomek")
    models.add([models.resampled(s, {}) for s in names]).fit([1.0])
    rows = {i: sum(n for s, (n, _) in models.sizes.items() if s // models.step == i) for i in range(len(names))}
    real = models.stack.rows.count()
    assert packed == [rows[1] + rows[2] - real + rows[3]]
    assert rows[0] == real and [r["n"] for r in models.table.groupBy((F.col(SET) / models.step).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("p").collect()] == list(rows.values())
