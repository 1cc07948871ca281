"""Class-conditional row generator: a Gaussian copula fitted with aggregates.

Per class it keeps a quantile grid of each continuous column, the level shares
of each category and the correlation of normal scores. A new row is a
correlated normal draw, pushed through the normal distribution function and
read off the grids and shares. Fitting is three aggregations; sampling is a
distributed range with column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.draws import normal, uniform
from evenkeel.functions.scalars import normal_cdf, sample_category
from evenkeel.operators.columns import filter_classes
from evenkeel.operators.ordered import take_lowest
from evenkeel.operators.profile import bin_of, cross_sums, quantiles, value_range
from evenkeel.operators.resample import append_synthetic, draw_table
from evenkeel.plans.sampling import plan_rows, sampling_plan
from evenkeel.session import SMALL_ROWS, collect_small
from evenkeel.spec import FeatureSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 101
RIDGE = 1e-6
EVERY = "every class"


def _cholesky(corr: np.ndarray) -> np.ndarray:
    """Lower factor of a correlation matrix, with a larger ridge if it needs one."""
    ridge = RIDGE
    while True:
        try:
            damped = (corr + ridge * np.eye(len(corr))) / (1.0 + ridge)
            return np.linalg.cholesky(damped)
        except np.linalg.LinAlgError:
            ridge *= 10.0


def _normal_points(halves: int) -> np.ndarray:
    """Normal scores of 0, 1/halves, .. 1, the ends moved inside."""
    law = NormalDist()
    spots = np.clip(np.arange(halves + 1) / halves, 0.5 / halves, 1 - 0.5 / halves)
    return np.array([law.inv_cdf(u) for u in spots])


@dataclass(frozen=True)
class ClassState:
    """What is known about one class."""

    n: int
    grids: list[list[float]]
    levels: list[list[str]]
    shares: list[list[float]]
    factor: list[list[float]]


@dataclass(frozen=True)
class ConditionalGenerator:
    spec: FeatureSpec
    schema: T.StructType
    conditional: bool
    states: dict

    # ---- fit -----------------------------------------------------------------

    @classmethod
    def fit(cls, df: DataFrame, spec: FeatureSpec, classes: Sequence | None = None,
            conditional: bool = True, grid: int = GRID, exact: bool = False,
            correlation: bool = True) -> "ConditionalGenerator":
        rows = spec.require(df)
        if classes is not None:
            rows = filter_classes(rows, spec.label, classes)
        group = F.col(spec.label) if conditional else F.lit(EVERY)
        rows = rows.withColumn("g", group.cast("string"))
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["g"]: r["n"] for r in collect_small(sizes, "classes")}
        if not counts or None in counts:
            raise ValueError("the fit needs rows, all with a label")
        probs = [i / (grid - 1) for i in range(grid)]
        grids = {g: {} for g in counts}
        if spec.continuous:
            for r in quantiles(rows, spec.continuous, probs, ["g"], exact=exact).orderBy("q").collect():
                grids[r["g"]].setdefault(r["col"], []).append(r["value"])
        shares = {g: {c: {} for c in spec.categorical} for g in counts}
        if spec.categorical:
            for r in collect_small(_level_table(rows, spec), "levels per class"):
                shares[r["g"]][r["col"]][r["level"]] = r["n"] / counts[r["g"]]
        states = {}
        for g, n in counts.items():
            level_lists = [sorted(shares[g][c]) for c in spec.categorical]
            states[g] = ClassState(
                n, [grids[g][c] for c in spec.continuous], level_lists,
                [[shares[g][c][v] for v in lv] for c, lv in zip(spec.categorical, level_lists)],
                np.eye(len(spec.features)).tolist(),
            )
        made = cls(spec, df.select(*spec.columns).schema, conditional, states)
        return made._with_correlation(rows) if correlation and len(spec.features) > 1 else made

    def _with_correlation(self, rows: DataFrame) -> "ConditionalGenerator":
        """Second pass: sums of products of normal scores, per class, in numpy blocks."""
        spec, p = self.spec, len(self.spec.features)
        lookup = {}
        for g, s in self.states.items():
            cuts = []
            for values in s.grids:
                cuts.append((np.array(values), _normal_points(2 * len(values))))
            for levels, share in zip(s.levels, s.shares):
                ends = np.cumsum(share)
                mid = np.clip(ends - np.array(share) / 2, 1e-9, 1 - 1e-9)
                cuts.append({v: NormalDist().inv_cdf(m) for v, m in zip(levels, mid)})
            lookup[g] = cuts
        shared = rows.sparkSession.sparkContext.broadcast(lookup)
        continuous, categorical = spec.continuous, spec.categorical
        upper = np.triu_indices(p + 1)

        def products(batches):
            held = {}
            for batch in batches:
                for g, part in batch.groupby("g"):
                    cuts = shared.value[g]
                    z = np.ones((len(part), p + 1))
                    for j, c in enumerate(continuous):
                        grid, scores = cuts[j]
                        v = part[c].to_numpy(dtype=float)
                        z[:, j] = scores[np.searchsorted(grid, v, "left") + np.searchsorted(grid, v, "right")]
                    for j, c in enumerate(categorical, len(continuous)):
                        z[:, j] = part[c].astype(str).map(cuts[j]).to_numpy(dtype=float)
                    held[g] = held.get(g, 0.0) + z.T @ z
            for g, total in held.items():
                yield pd.DataFrame({"g": g, "i": upper[0], "j": upper[1], "v": total[upper]})

        slim = rows.select(
            "g", *[F.col(c).cast("double").alias(c) for c in continuous],
            *[F.col(c).cast("string").alias(c) for c in categorical])
        sums = slim.mapInPandas(products, "g string, i int, j int, v double").groupBy(
            "g", "i", "j").agg(F.sum("v").alias("v")).collect()
        grams = {g: np.zeros((p + 1, p + 1)) for g in self.states}
        for r in sums:
            grams[r["g"]][r["i"], r["j"]] = grams[r["g"]][r["j"], r["i"]] = r["v"]
        states = {g: _with_factor(s, grams[g]) for g, s in self.states.items()}
        return ConditionalGenerator(spec, self.schema, self.conditional, states)

    # ---- sample --------------------------------------------------------------

    def sample(self, plan: DataFrame, seed: int = 0, correlation: bool = True) -> DataFrame:
        """``n_new`` rows of each class: label, features and ``draw_id``."""
        spec, label = self.spec, self.spec.label
        if plan.columns[0] != label:
            raise ValueError(f"the plan is for {plan.columns[0]}, the generator for {label}")
        spark = plan.sparkSession
        wanted = [str(c) for c, *_, new in plan_rows(plan) if new > 0]
        missing = [g for g in wanted if self.conditional and g not in self.states]
        if missing:
            raise ValueError(f"classes {missing} were not fitted but rows of them are asked for")
        draws = draw_table(spark, plan).withColumn("g", F.col(label).cast("string")).drop("class_n")
        table = self._state_table(spark, wanted)
        keys = [label, "draw_id"]
        p = len(spec.features)
        # the states come from the driver; joined by shuffle, all draws of a class would be one task
        if correlation:
            eps = F.array(*[normal(keys, f"gen{seed}.{i}") for i in range(p)])
            rows = draws.select(label, "draw_id", "g", eps.alias("eps")).join(F.broadcast(table), "g")
            z = F.transform("factor", lambda row: F.aggregate(
                F.zip_with(row, F.col("eps"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
            rows = rows.withColumn("z", z).withColumn("u", F.transform("z", normal_cdf))
        else:
            u = F.array(*[uniform(keys, f"gen{seed}.{i}") for i in range(p)])
            rows = draws.select(label, "draw_id", "g", u.alias("u")).join(F.broadcast(table), "g")
        made = {}
        for i, c in enumerate(spec.continuous):
            made[c] = _read_grid(F.col("grids")[i], F.col("u")[i])
        for j, c in enumerate(spec.categorical):
            u = F.col("u")[len(spec.continuous) + j]
            made[c] = F.col("levels")[j][sample_category(F.col("shares")[j], u)]
        return rows.select("draw_id", label, *[
            _to_type(made[c], self.schema[c].dataType).alias(c) for c in spec.features])

    def _state_table(self, spark: SparkSession, groups: list[str]) -> DataFrame:
        schema = ("g string, grids array<array<double>>, levels array<array<string>>, "
                  "shares array<array<double>>, factor array<array<double>>")
        held = {g: self.states[g if self.conditional else EVERY] for g in groups}
        rows = [(g, s.grids, s.levels, s.shares, s.factor) for g, s in held.items()]
        return spark.createDataFrame(rows, schema)

    def fit_resample(self, df: DataFrame, strategy="auto", seed: int = 0) -> DataFrame:
        """Append the rows that the plan asks for to the rows of ``df``."""
        self.check_columns(df)
        plan = sampling_plan(df, self.spec.label, strategy)
        real = df.select(*self.spec.columns)
        new = self.sample(plan, seed).withColumn(
            self.spec.key, F.lit(None).cast(real.schema[self.spec.key].dataType))
        return append_synthetic(real, new)

    def check_columns(self, df: DataFrame) -> None:
        """The table must have exactly the features the generator was fitted on."""
        features = [c for c in df.columns if c not in (self.spec.key, self.spec.label)]
        if sorted(features) != sorted(self.spec.features):
            raise ValueError(
                f"generator makes {len(self.spec.features)} features {self.spec.features}, "
                f"the table has {len(features)}: {features}")

    # ---- store ---------------------------------------------------------------

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(g, s.n, s.grids, s.levels, s.shares, s.factor, self.conditional,
                 list(self.spec.continuous), list(self.spec.categorical), self.spec.label,
                 self.spec.key, self.schema.json()) for g, s in self.states.items()]
        spark.createDataFrame(rows, STATE_SCHEMA).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "ConditionalGenerator":
        import json

        rows = spark.read.parquet(path).collect()
        r = rows[0]
        spec = FeatureSpec(r["label"], r["key"], tuple(r["continuous"]), tuple(r["categorical"]))
        states = {r["g"]: ClassState(r["n"], r["grids"], r["levels"], r["shares"], r["factor"])
                  for r in rows}
        return cls(spec, T.StructType.fromJson(json.loads(r["schema"])), r["conditional"], states)


STATE_SCHEMA = (
    "g string, n bigint, grids array<array<double>>, levels array<array<string>>, "
    "shares array<array<double>>, factor array<array<double>>, conditional boolean, "
    "continuous array<string>, categorical array<string>, label string, key string, schema string"
)


def _with_factor(state: ClassState, gram: np.ndarray) -> ClassState:
    """Cholesky factor from sums of products; the last row and column hold plain sums."""
    n = max(gram[-1, -1], 1.0)
    mean = gram[-1, :-1] / n
    cov = gram[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(sd > 1e-12, sd, 1.0)
    corr = cov / np.outer(scale, scale)
    corr[sd <= 1e-12, :] = 0.0
    corr[:, sd <= 1e-12] = 0.0
    np.fill_diagonal(corr, 1.0)
    return ClassState(state.n, state.grids, state.levels, state.shares, _cholesky(corr).tolist())


def _level_table(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level"))
        for c in spec.categorical])
    return rows.select("g", F.explode(cells).alias("c")).select("g", "c.*").groupBy(
        "g", "col", "level").agg(F.count(F.lit(1)).alias("n"))


def _read_grid(grid: Column, u: Column) -> Column:
    """Value at level ``u`` of an even quantile grid."""
    spot = u * (F.size(grid) - 1)
    low = F.least(F.floor(spot), F.size(grid) - 2).cast("int")
    return grid[low] + (grid[low + 1] - grid[low]) * (spot - low)


def _to_type(c: Column, kind: T.DataType) -> Column:
    return F.round(c).cast(kind) if isinstance(kind, T.IntegralType) else c.cast(kind)


def fit_resample(df: DataFrame, spec: FeatureSpec, strategy="auto", seed: int = 0,
                 **fit_options) -> DataFrame:
    """Fit on the table, draw what the plan asks for, append."""
    made = ConditionalGenerator.fit(df, spec, **fit_options)
    return made.fit_resample(df.select(*spec.columns), strategy, seed)


def select_realistic(scored: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` generated rows that a discriminator finds most like real ones (lowest score)."""
    return take_lowest(scored, F.col(score), key, n)


def most_realistic(real: DataFrame, fake: DataFrame, spec: FeatureSpec, n: int,
                   params: dict | None = None, seed: int = 0) -> DataFrame:
    """The ``n`` rows of ``fake`` that a forest takes for real ones, with all their columns and ``score``.

    The generated rows are halved by ``draw_id``; each half is scored by a forest
    trained on the other half and as many real rows, so no row is judged by a
    model that has seen it.
    """
    from evenkeel.plans.evaluate import apply_classifier, fit_classifier

    origin = FeatureSpec("origin", "__row", spec.continuous, spec.categorical)
    half = F.floor(uniform([spec.label, "draw_id"], f"half{seed}") * 2)
    made = fake.withColumn("__row", F.concat_ws(":", spec.label, "draw_id")).withColumn("__half", half)
    both = real.select(F.concat(F.lit("r"), F.col(spec.key).cast("string")).alias("__row"),
                       F.lit(0).alias("origin"), *spec.features)
    scored = None
    for side in (0, 1):
        other = made.filter(F.col("__half") != side).select("__row", F.lit(1).alias("origin"), *spec.features)
        model = fit_classifier(both.unionByName(other), origin, "RF", params)
        mine = made.filter(F.col("__half") == side)
        scores = apply_classifier(model, mine.withColumn("origin", F.lit(1)), origin).select("__row", "score")
        part = mine.join(scores, "__row")
        scored = part if scored is None else scored.unionByName(part)
    return select_realistic(scored.drop("__half"), "score", "__row", n).drop("__row")


# ---- mergeable state ---------------------------------------------------------

STATE_COLUMNS = ("g", "kind", "a", "b", "value")


def fit_state(df: DataFrame, spec: FeatureSpec, ranges: dict[str, tuple[float, float]] | None = None,
              bins: int = 64) -> tuple[DataFrame, dict]:
    """Counts, sums, products, fixed bins and level counts: ``(g, kind, a, b, value)``.

    Every value is a sum over rows, so states of two tables add up. The bins are
    fixed by ``ranges``; later values outside go to the end bins.
    """
    ranges = ranges or value_range(df, spec.continuous)
    g = F.col(spec.label).cast("string").alias("g")
    rows = df.select(g, *[F.col(c).cast("double").alias(c) for c in spec.continuous],
                     *[F.col(c).cast("string").alias(c) for c in spec.categorical])
    names = list(spec.continuous)
    held = rows.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        "g", F.lit("n").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), "value")
    sums = held
    if names:
        name = F.array(*[F.lit(c) for c in names])
        products = cross_sums(rows, names, ["g"])
        cross = products.select("g", F.lit("cross").alias("kind"), name[F.col("i")].alias("a"),
                                name[F.col("j")].alias("b"), F.col("xy").alias("value"))
        single = products.filter("i = j").select(
            "g", F.lit("sum").alias("kind"), name[F.col("i")].alias("a"), F.lit("").alias("b"),
            F.col("x").alias("value"))
        sums = held.unionByName(single).unionByName(cross)
    spots = [F.struct(F.lit("bin").alias("kind"), F.lit(c).alias("a"),
                      bin_of(c, *ranges[c], bins).cast("string").alias("b")) for c in names]
    spots += [F.struct(F.lit("level").alias("kind"), F.lit(c).alias("a"), F.col(c).alias("b"))
              for c in spec.categorical]
    counts = rows.select("g", F.explode(F.array(*spots)).alias("x")).select("g", "x.*").groupBy(
        "g", "kind", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sums.unionByName(counts), ranges


def merge_state(*states: DataFrame) -> DataFrame:
    """Add states cell by cell."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("g", "kind", "a", "b").agg(F.sum("value").alias("value"))


def update_state(state: DataFrame, df: DataFrame, spec: FeatureSpec, ranges: dict,
                 bins: int = 64) -> DataFrame:
    """State of the rows seen so far plus new rows."""
    return merge_state(state, fit_state(df, spec, ranges, bins)[0])


def generator_from_state(state: DataFrame, spec: FeatureSpec, schema: T.StructType, ranges: dict,
                         bins: int = 64) -> ConditionalGenerator:
    """Generator of a merged state: grids from the bins, correlation from the products."""
    cells: dict = {}
    for r in collect_small(state, "cells of the state", 10 * SMALL_ROWS):
        cells.setdefault(r["g"], {})[r["kind"], r["a"], r["b"]] = r["value"]
    states = {}
    p, names = len(spec.features), list(spec.continuous)
    probs = np.linspace(0, 1, GRID)
    for g, found in cells.items():
        n = found["n", "", ""]
        grids = []
        for c in names:
            low, high = ranges[c]
            mass = np.array([found.get(("bin", c, str(i)), 0.0) for i in range(bins)])
            ends = np.concatenate([[0.0], np.cumsum(mass) / max(mass.sum(), 1.0)])
            grids.append(np.interp(probs, ends, np.linspace(low, high, bins + 1)).tolist())
        levels = [sorted(b for (kind, a, b) in found if kind == "level" and a == c) for c in spec.categorical]
        shares = [[found["level", c, v] / n for v in lv] for c, lv in zip(spec.categorical, levels)]
        gram = np.zeros((p + 1, p + 1))
        gram[-1, -1] = n
        for i, a in enumerate(names):
            gram[i, -1] = gram[-1, i] = found["sum", a, ""]
            for j, b in enumerate(names[i:], i):
                gram[i, j] = gram[j, i] = found["cross", a, b]
        states[g] = _with_factor(ClassState(int(n), grids, levels, shares, []), gram)
    return ConditionalGenerator(spec, schema, True, states)
