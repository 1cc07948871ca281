"""Exact neighbours against brute force, with copies, ties and hot cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel import FeatureSpec
from evenkeel.operators import neighbors
from evenkeel.operators.neighbors import knn, tomek_links
from evenkeel.operators.synthetic import adasyn, clean_tomek, smote, smote_nc
from evenkeel.plans.sampling import sampling_plan

SPEC = FeatureSpec("y", "id", ["a", "b"])
MIXED = FeatureSpec("y", "id", ["a", "b"], ["c"])


def table(n=400, copies=0.35, seed=1):
    """Points on a coarse grid, so distances tie; a third are copies of one point."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 25, n) * 1.0,
                        "b": rng.integers(0, 25, n) * 1.0, "c": rng.choice(list("uvw"), n),
                        "y": (rng.random(n) < 0.3).astype(int)})
    pdf.loc[rng.random(n) < copies, ["a", "b", "c"]] = [3.0, 4.0, "u"]
    return pdf


def brute(pdf, k, within, penalty=0.0, cats=()):
    x = pdf[["a", "b"]].to_numpy()
    out = {}
    for i in range(len(pdf)):
        d2 = ((x - x[i]) ** 2).sum(1)
        for c in cats:
            d2 = d2 + penalty**2 * (pdf[c] != pdf[c].iloc[i]).to_numpy()
        ok = np.arange(len(pdf)) != i
        if within:
            ok &= (pdf["y"] == pdf["y"].iloc[i]).to_numpy()
        idx = np.flatnonzero(ok)
        out[pdf["id"].iloc[i]] = list(pdf["id"].to_numpy()[idx[np.lexsort((pdf["id"].to_numpy()[idx], d2[idx]))][:k]])
    return out


def lists(df):
    pdf = df.toPandas().sort_values(["id", "rank"])
    return pdf.groupby("id")["neighbor"].apply(list).to_dict()


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("sizes", [{}, {"block_points": 20}])
def test_numeric_neighbours(spark, within, sizes):
    pdf = table()
    assert lists(knn(spark.createDataFrame(pdf), SPEC, 4, within, **sizes)) == brute(pdf, 4, within)


@pytest.mark.parametrize("sizes", [{}, {"block_points": 20}])
def test_mixed_neighbours(spark, sizes):
    pdf = table(seed=2)
    got = lists(knn(spark.createDataFrame(pdf), MIXED, 3, False, penalty=2.5, **sizes))
    assert got == brute(pdf, 3, False, 2.5, ["c"])


def test_query_classes_only_limit_who_asks(spark):
    pdf = table(seed=3)
    got = lists(knn(spark.createDataFrame(pdf), SPEC, 3, False, query_classes=[1], block_points=30))
    want = {i: v for i, v in brute(pdf, 3, False).items() if pdf["y"].iloc[i] == 1}
    assert got == want


def test_k_at_least_class_size(spark):
    pdf = table(60, seed=4)
    got = lists(knn(spark.createDataFrame(pdf), SPEC, 50, True))
    sizes = pdf["y"].value_counts()
    assert all(len(v) == min(50, sizes[pdf["y"].iloc[i]] - 1) for i, v in got.items())


def test_nulls_are_refused(spark):
    bad = spark.createDataFrame([(1, 1.0, None, "u", 0), (2, 1.0, 2.0, "u", 1)], "id int, a double, b double, c string, y int")
    with pytest.raises(ValueError, match="null"):
        knn(bad, SPEC, 1)


def test_tomek_links_by_brute_force(spark):
    pdf = table(seed=5, copies=0.05)
    one = {i: v[0] for i, v in brute(pdf, 1, False).items()}
    y = pdf.set_index("id")["y"]
    want = {(i, j) for i, j in one.items() if i < j and one[j] == i and y[i] != y[j]}
    df = spark.createDataFrame(pdf)
    assert {(r["a"], r["b"]) for r in tomek_links(df, SPEC, block_points=40).collect()} == want
    gone = {i if y[i] == 0 else j for i, j in want}
    kept = {r["id"] for r in clean_tomek(df, SPEC, minority=1).collect()}
    assert kept == set(pdf["id"]) - gone


def test_smote_rows_lie_on_segments(spark):
    pdf = table(seed=6, copies=0.1)
    df = spark.createDataFrame(pdf)
    plan = sampling_plan(df, "y", {1: int((pdf["y"] == 1).sum()) + 100})
    out = smote(df, SPEC, plan, 4).toPandas()
    real, new = out[~out["is_synthetic"]], out[out["is_synthetic"]]
    assert len(new) == 100 and set(new["y"]) == {1}
    assert sorted(real["id"]) == sorted(pdf["id"])
    near, x = brute(pdf, 4, True), pdf.set_index("id")[["a", "b"]]
    ends = [(x.loc[i].to_numpy(), x.loc[j].to_numpy()) for i in x.index if pdf["y"].iloc[i] == 1 for j in near[i]]

    def on_segment(p):
        return any(abs(np.linalg.norm(p - u) + np.linalg.norm(p - v) - np.linalg.norm(u - v)) < 1e-9 for u, v in ends)

    assert all(on_segment(p) for p in new[["a", "b"]].to_numpy())


def test_smote_nc_takes_the_most_frequent_level(spark):
    pdf = table(seed=7)
    df = spark.createDataFrame(pdf)
    new = smote_nc(df, MIXED, sampling_plan(df, "y"), 5, only_new=True).toPandas()
    assert len(new) == abs((pdf["y"] == 0).sum() - (pdf["y"] == 1).sum())
    assert set(new["c"]) <= set("uvw")


def test_adasyn_follows_other_class_neighbours(spark):
    pdf = table(seed=8, copies=0.0)
    df = spark.createDataFrame(pdf)
    plan = sampling_plan(df, "y")
    n_new = plan.filter("y = 1").first()["n_new"]
    made = adasyn(df, SPEC, plan, 5, only_new=True).count()
    near, y = brute(pdf, 5, False), pdf["y"].to_numpy()
    other = {i: sum(y[j] == 0 for j in near[i]) for i in pdf["id"] if y[i] == 1}
    assert made == sum(int(np.rint(v * n_new / sum(other.values()))) for v in other.values())


def test_one_row_class_is_refused(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 1.0, 0), (3, 2.0, 1.0, 0)], "id int, a double, b double, y int")
    with pytest.raises(ValueError, match="two rows"):
        smote(df, SPEC, sampling_plan(df, "y"))


def test_blocks_stay_small(spark):
    """A cell that holds every point is searched in many blocks."""
    df = spark.range(3000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("int").alias("y")).cache()
    pdf = df.toPandas()
    assert lists(knn(df, SPEC, 2, False, block_points=500)) == brute(pdf, 2, False)


@pytest.mark.parametrize("within", [True, False])
def test_many_blocks_of_small_cells_name_each_neighbour_once(spark, monkeypatch, within):
    monkeypatch.setattr(neighbors, "BLOCK_POINTS", 256)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(2400), "y": rng.integers(0, 2, 2400), "a": rng.integers(0, 60, 2400) / 4.0,
                        "b": rng.normal(0, 9, 2400).round(1), "c": rng.choice(list("uvw"), 2400)})
    got = lists(knn(spark.createDataFrame(pdf), MIXED, 4, within, 1.5, block_points=25))
    assert got == brute(pdf, 4, within, 1.5, ["c"])


def test_small_cells_do_not_send_a_vector_to_a_task_for_each_cell(spark, monkeypatch):
    sent, search = [], neighbors._search

    def spy(queries, blocks, pairs, *rest):
        sizes = blocks.select("g", F.col("z").alias("mz"), F.size("points").alias("n"))
        sent.append(pairs.join(sizes, ["g", "mz"]).agg(F.sum("n")).first()[0])
        return search(queries, blocks, pairs, *rest)

    monkeypatch.setattr(neighbors, "_search", spy)
    spec = FeatureSpec("y", "id", [f"x{i}" for i in range(16)])
    pdf = pd.DataFrame(np.random.default_rng(5).normal(0, 1, (2560, 16)), columns=spec.continuous)
    df = spark.createDataFrame(pdf.assign(id=range(2560), y=0))
    knn(df, spec, 3, within_class=False, block_points=64).count()
    # each vector used to go to nearly every one of the 40 cells
    assert sum(sent) <= 4 * 2560


def test_search_compares_few_members_at_once_and_rules_out_far_leaves(monkeypatch):
    held = []
    distances = neighbors._square_distances

    def spy(xa, ca, xb, cb, penalty2):
        held.append(len(xa) * len(xb))
        return distances(xa, ca, xb, cb, penalty2)

    monkeypatch.setattr(neighbors, "_square_distances", spy)
    rng = np.random.default_rng(6)
    for width, share in ((2, 0.1), (20, 1.2)):
        held.clear()
        x, none = rng.normal(0, 1, (9000, width)), np.zeros((9000, 0), int)
        found = list(neighbors._nearest_in_block(
            x, none, x, none, np.arange(9000), 1, 0.0, np.full(9000, np.inf)))
        assert sorted(zip(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))) == [
            (i, i) for i in range(9000)]
        assert max(held) <= 256 * 8192 and sum(held) <= share * 9000 ** 2


def test_bounds_are_kept_by_point_and_not_by_pair(spark, monkeypatch):
    """No table on the way has more rows than there are points; each bound holds k + 1 rows of the block."""
    counts, plain = {}, neighbors.write_scratch

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(neighbors, "write_scratch", counted)
    pdf = table(600, copies=0.2, seed=5)
    got = lists(knn(spark.createDataFrame(pdf), MIXED, 4, False, penalty=2.5, block_points=60))
    assert got == brute(pdf, 4, False, 2.5, ["c"])
    assert max(counts.values()) <= counts["points"]


def test_running_sums_start_anew_with_each_number():
    got = neighbors._running(np.array([3, 3, 1, 1, 1, 7]), np.array([2, 1, 5, 1, 1, 4]))
    assert got.tolist() == [2, 3, 5, 6, 7, 4]
    assert neighbors._running(np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_search_in_many_columns_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, none = rng.normal(size=(8192, 64)), np.zeros((8192, 0), int)
    tracemalloc.start()
    found = list(neighbors._nearest_in_block(
        x[:512], none[:512], x, none, np.arange(8192), 2, 0.0, np.full(512, np.inf)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    to = np.concatenate([t for _, t, _ in found]).reshape(-1, 2)
    assert sorted(to[:, 0].tolist()) == list(range(512))
    assert peak < 16 << 20
