"""Generator, mergeable state and stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel import FeatureSpec
from evenkeel.operators import generator as gen
from evenkeel.operators.metrics import ks_two_sample
from evenkeel.operators.resample import label_origin
from evenkeel.plans.sampling import sampling_plan
from evenkeel.streaming import class_counts_of, read_state, stream_update

SPEC = FeatureSpec("y", "id", ["a", "b"], ["c"])


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(0)
    n = 6000
    y = (rng.random(n) < 0.4).astype(int)
    a = rng.normal(size=n) + 3 * y
    b = np.exp(0.8 * a / 3 + 0.3 * rng.normal(size=n))
    c = np.where(a > 1.5, "high", np.where(rng.random(n) < 0.1, "rare", "low"))
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def test_counts_levels_and_moments(spark, df, pdf):
    plan = sampling_plan(df, "y", {0: 4000, 1: 3000}, mode="new")
    new = gen.ConditionalGenerator.fit(df, SPEC).sample(plan, seed=3).toPandas()
    assert new.groupby("y").size().to_dict() == {0: 4000, 1: 3000}
    for y, part in new.groupby("y"):
        real = pdf[pdf["y"] == y]
        assert set(part["c"]) <= set(real["c"])
        for c in ("a", "b"):
            assert part[c].mean() == pytest.approx(real[c].mean(), abs=0.08 * real[c].std())
            assert part[c].std() == pytest.approx(real[c].std(), rel=0.12)
        assert part[["a", "b"]].corr(method="spearman").iloc[0, 1] == pytest.approx(
            real[["a", "b"]].corr(method="spearman").iloc[0, 1], abs=0.06)
        for level, share in real["c"].value_counts(normalize=True).items():
            assert (part["c"] == level).mean() == pytest.approx(share, abs=0.04)


def test_marginals_pass_a_ks_check(spark, df):
    plan = sampling_plan(df, "y", {0: 3000}, mode="new")
    new = gen.ConditionalGenerator.fit(df, SPEC).sample(plan)
    both = label_origin(df.filter("y = 0").select("a"), new.select("a"))
    assert ks_two_sample(both, "a", "origin", 0, 1).first()["ks"] < 0.04


def test_same_seed_same_rows(spark, df):
    plan = sampling_plan(df, "y", {1: 50}, mode="new")
    made = gen.ConditionalGenerator.fit(df, SPEC)
    a, b = (made.sample(plan, seed=1).orderBy("draw_id").toPandas() for _ in range(2))
    assert a.equals(b)
    assert not a.equals(made.sample(plan, seed=2).orderBy("draw_id").toPandas())


def test_errors(spark, df):
    only = gen.ConditionalGenerator.fit(df, SPEC, classes=[1])
    with pytest.raises(ValueError, match="not fitted"):
        only.sample(sampling_plan(df, "y", {0: 5}, mode="new"))
    with pytest.raises(ValueError, match="features"):
        only.fit_resample(df.drop("c"))


def test_state_round_trip(spark, df, tmp_path):
    made = gen.ConditionalGenerator.fit(df, SPEC)
    made.write(spark, str(tmp_path / "g"))
    back = gen.ConditionalGenerator.read(spark, str(tmp_path / "g"))
    plan = sampling_plan(df, "y", {1: 20}, mode="new")
    assert made.sample(plan).orderBy("draw_id").collect() == back.sample(plan).orderBy("draw_id").collect()


def test_updates_add_up(spark, df):
    whole, ranges = gen.fit_state(df, SPEC)
    first, _ = gen.fit_state(df.filter("id % 3 = 0"), SPEC, ranges)
    both = gen.update_state(first, df.filter("id % 3 <> 0"), SPEC, ranges)
    key = ["g", "kind", "a", "b"]
    gap = whole.join(both.withColumnRenamed("value", "v2"), key, "full").select(
        F.max(F.abs(F.col("value") - F.col("v2"))), F.count_if(F.expr("v2 is null or value is null"))).first()
    assert gap[0] < 1e-6 and gap[1] == 0
    made = gen.generator_from_state(both, SPEC, df.select(*SPEC.columns).schema, ranges)
    out = made.sample(sampling_plan(df, "y", {1: 2000}, mode="new")).toPandas()
    real = df.filter("y = 1").toPandas()
    assert out["a"].mean() == pytest.approx(real["a"].mean(), abs=0.15)


def test_stream_equals_batch_and_survives_a_replay(spark, df, tmp_path):
    spec = FeatureSpec("y", "id", ["a"])
    rows = df.select(*spec.columns)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    ranges = {"a": (-5.0, 8.0)}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "state")
    stream_update(stream, spec, path, ranges, checkpoint=str(tmp_path / "cp")).awaitTermination()
    want = {str(r["y"]): r["count"] for r in df.groupBy("y").count().collect()}

    def got():
        return {r["label"]: r["n"] for r in class_counts_of(read_state(spark, path)).collect()}

    assert got() == want
    # the last batch runs again: forget its commit
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_update(stream, spec, path, ranges, checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert got() == want
