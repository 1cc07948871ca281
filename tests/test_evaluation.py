"""Classifier tests, chains, configs and file formats."""

import json
import math
import threading

import pytest
from pyspark.sql import functions as F

from evenkeel import FeatureSpec, session
from evenkeel.plans import evaluate as ev
from evenkeel.plans.grid import candidate_folds, expand_grid, experiment_table
from evenkeel.sources.files import read_column_json, read_delimited, read_experiment, write_report

SPEC = FeatureSpec("y", "id", ["a", "b"], ["c"])


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(600).select(
        "id", F.rand(1).alias("a"), F.rand(2).alias("b"),
        F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c")).withColumn(
        "y", ((F.col("a") + 0.3 * F.rand(3)) > 0.95).cast("int")).cache()


def test_nested_cv(df):
    config = {"models": {"LR": {"C": [1, 100]}}, "samplers": {"unbalanced": {}, "SMOTE": {"k_neighbors": [3]}}}
    scores, tuning = ev.nested_cv(df, SPEC, config, outer=2, inner=2)
    rows = scores.collect()
    assert {(r["sampler"], r["fold"]) for r in rows} == {(s, f) for s in ("unbalanced", "SMOTE") for f in (0, 1)}
    assert all(r["auc"] > 0.8 for r in rows)
    assert tuning.count() == 8
    assert {r["params"]["classifier__C"] for r in tuning.collect()} == {"1", "100"}


def test_nested_cv_chooses_by_the_inner_folds(df):
    config = {"models": {"LR": {"C": [1e-4, 10]}}, "samplers": {"unbalanced": {}, "SMOTE": {"k_neighbors": [2, 3]}}}
    scores, tuning = ev.nested_cv(df, SPEC, config, outer=3, inner=2, train_scores=True)
    held = {}
    for r in tuning.collect():
        assert r["scored_folds"] == 2 and 0 < r["auc_sd"] < 0.5
        held.setdefault((r["sampler"], r["fold"]), []).append((-round(r["auc"], 9), r["candidate"]))
    assert {k: len(v) for k, v in held.items()} == {(s, f): n for s, n in (("unbalanced", 2), ("SMOTE", 4)) for f in range(3)}
    for r in scores.collect():
        assert r["candidate"] == min(held[r["sampler"], r["fold"]])[1]
        assert r["auc"] > 0.8 and abs(r["train_auc"] - r["auc"]) < 0.15
    sizes = {r["train_rows"] for r in scores.filter("sampler = 'unbalanced'").collect()}
    assert sizes <= {399, 400, 401}


def test_registered_functions(df):
    seen = []

    def sampler(t, spec, strategy, seed):
        seen.append(t.count())
        return t

    ev.register_sampler("mine", sampler)
    ev.register_scorer("rows", lambda t, y, score, key, by: t.groupBy(*by).agg(F.count("*").cast("double").alias("rows")))
    train, test = df.filter("id < 400"), df.filter("id >= 400")
    chain = ev.ResampleChain(SPEC, "mine").fit(train)
    scored = chain.transform(test)
    assert seen == [400]  # resampling happens while fitting only
    assert ev.score_with(scored, SPEC, ["rows"]) == {"rows": 200.0}
    with pytest.raises(ValueError):
        ev.score_with(scored, SPEC, ["nope"])
    with pytest.raises(ValueError):
        ev.ResampleChain(SPEC, "nope")
    with pytest.raises(ValueError):
        ev.fit_classifier(train, SPEC, "LR", {"depth": 1})


def test_discriminator_knows_nothing_about_equal_tables(df):
    got = ev.discriminator_eval(df, df, SPEC, "RF", {"n_estimators": 5, "max_depth": 4})
    assert abs(got["auc"] - 0.5) < 0.12
    assert got["auc"] == pytest.approx(0.5) and got["p_value"] == pytest.approx(1.0)


def test_discriminator_tells_tables_apart(df):
    half = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    same = ev.discriminator_eval(*half, SPEC, "LR")
    assert abs(same["auc"] - 0.5) < 0.12 and same["p_value"] > 0.001
    moved = ev.discriminator_eval(half[0], half[1].withColumn("a", F.col("a") + 0.5), SPEC, "RF", {"max_depth": 4})
    assert moved["auc"] > 0.8 and moved["p_value"] < 1e-6


def test_p_values_of_exchangeable_scores_are_uniform(spark):
    from evenkeel.operators.metrics import rank_test

    rows = spark.range(300 * 80).select(
        (F.col("id") % 300).alias("g"), F.round(F.rand(5), 1).alias("score"), (F.rand(6) < 0.3).cast("int").alias("y"))
    z = [r["z"] for r in rank_test(rows, "y", "score", ["g"]).collect()]
    p = sorted(math.erfc(abs(x) / 2 ** 0.5) for x in z)
    assert max(abs((i + 0.5) / len(p) - v) for i, v in enumerate(p)) < 1.6 / len(p) ** 0.5
    assert abs(sum(x * x for x in z) / len(z) - 1) < 0.3


def test_importance(df):
    model = ev.fit_classifier(df, SPEC, "RF", {"n_estimators": 5})
    top = ev.rank_importance(model, SPEC, 2).collect()
    assert top[0]["feature"] == "a" and len(top) == 2


def test_grid():
    assert len(expand_grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    with pytest.raises(ValueError, match="unknown"):
        expand_grid({"z": [1]}, allowed=["a"])


def test_config_keeps_numbers(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"models": {"LR": {"C": [10]}}, "samplers": {"SMOTE": {"n": [100000, 50000]}}}))
    table = experiment_table(spark, read_experiment(spark, str(path)))
    n = [r["number"] for r in table.filter("parameter = 'sampler__n'").orderBy("number").collect()]
    assert n == [50000.0, 100000.0]
    assert candidate_folds(table, [0, 1]).count() == 2 * table.count()
    path.write_text("{}")
    with pytest.raises(ValueError):
        read_experiment(spark, str(path))


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"Y": [[1, -1, 1]], "Xcat": [[5, 6, 7], [1, 2, 3]]}))
    got = read_column_json(spark, str(tmp_path / "x.json")).orderBy("pos").collect()
    assert [(r["label"], r["f0"], r["f1"]) for r in got] == [(1, 5, 1), (-1, 6, 2), (1, 7, 3)]
    (tmp_path / "t.txt").write_text("01;2.5\n02;3.5\n")
    rows = read_delimited(spark, str(tmp_path / "t.txt"), "code string, v double", sep=";").collect()
    assert [r["code"] for r in rows] == ["01", "02"]
    write_report({"one": spark.range(3)}, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "one")).count() == 3


def test_scorers_start_together(spark, monkeypatch):
    meeting = threading.Barrier(2, timeout=60)

    def waits(df, y, score, key, by):
        meeting.wait()
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("name"))

    for name in ("first", "second"):
        monkeypatch.setitem(ev.SCORERS, name, lambda *a, name=name: waits(*a).withColumnRenamed("name", name))
    scored = spark.createDataFrame([(1, 0, 0.2, 0), (2, 1, 0.7, 0)], "id int, y int, score double, part int")
    found = ev.score_parts(scored, FeatureSpec("y", "id", ["score"]), ["first", "second"])
    assert found == {0: {"first": 2, "second": 2}}


def test_overlapping_writes_leave_the_setting(spark):
    spark.conf.unset(session.FREE_SHUFFLES)
    session._free_shuffles(spark, 1)
    session._free_shuffles(spark, 1)
    session._free_shuffles(spark, -1)
    assert spark.conf.get(session.FREE_SHUFFLES) == "true"
    session._free_shuffles(spark, -1)
    assert spark.conf.get(session.FREE_SHUFFLES, None) in (None, "false")
