"""Counts, moments, covariances, quantiles and histograms in long format."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.ordered import quantile_table
from evenkeel.spec import FeatureSpec

# Width rule for a category with L levels, min(15, ceil(L / 2)).
WIDTH_CAP = 15
QUARTILES = (0.25, 0.5, 0.75)
#: Cells of sums that a task holds before it gives them out.
HELD_CELLS = 4_000_000

# send the helpers below with the task, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _long(row: DataFrame, by: Sequence[str], cells: list[Column]) -> DataFrame:
    """Turn the many aggregates of one row per group into one row per cell."""
    return row.select(*by, F.explode(F.array(*cells)).alias("__cell")).select(*by, "__cell.*")


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, share, ratio)``; ratio is the class size over the largest class size."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.select(
        label, "n",
        (F.col("n") / F.sum("n").over(whole)).alias("share"),
        (F.col("n") / F.max("n").over(whole)).alias("ratio"),
    )


def column_profile(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per feature: role, distinct levels, kind and width of its embedding.

    Distinct values are found by grouping (col, value) pairs, which spreads a
    column with many values over all tasks.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
        for c in spec.features
    ])
    pairs = df.select(F.explode(cells).alias("__c")).select("__c.*").filter("value is not null")
    counts = pairs.groupBy("col", "value").agg(F.lit(1).alias("one")).groupBy("col").agg(
        F.sum("one").cast("bigint").alias("n_levels")
    )
    categorical = F.col("col").isin(list(spec.categorical)) if spec.categorical else F.lit(False)
    kind = (
        F.when(~categorical, F.lit("continuous"))
        .when(F.col("n_levels") <= 2, F.lit("binary"))
        .otherwise(F.lit("multi-level"))
    )
    width = F.least(F.lit(WIDTH_CAP), F.ceil(F.col("n_levels") / 2)).cast("int")
    return counts.select(
        "col", F.when(categorical, F.lit("categorical")).otherwise(F.lit("continuous")).alias("role"),
        "n_levels", kind.alias("kind"), F.when(categorical, width).alias("width"),
    )


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and central moments 2, 3 and 4 of each column.

    Spark's skewness and kurtosis are m3/m2^1.5 and m4/m2^2 - 3 over the whole
    group, merged from partial results, so one pass gives all four moments.
    """
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"mean_{c}"), F.var_pop(v).alias(f"var_{c}"),
                 F.skewness(v).alias(f"skew_{c}"), F.kurtosis(v).alias(f"kurt_{c}")]
    wide = df.groupBy(*by).agg(*aggs)
    cells = []
    for c in columns:
        m2 = F.col(f"var_{c}")
        flat = m2 == 0
        cells.append(F.struct(
            F.lit(c).alias("col"), F.col(f"mean_{c}").alias("mean"), m2.alias("m2"),
            F.when(flat, 0.0).otherwise(F.col(f"skew_{c}") * F.pow(m2, 1.5)).alias("m3"),
            F.when(flat, 0.0).otherwise((F.col(f"kurt_{c}") + 3) * m2 * m2).alias("m4"),
        ))
    return _long(wide, by, cells)


def compare_means(sets: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Column means of several tables: ``(set, col, mean)``."""
    stacked = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("set"), *columns)
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("set").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"mean_{c}").alias("mean")) for c in columns]
    return _long(wide, ["set"], cells)


def cross_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
               centre: dict[str, float] | None = None) -> DataFrame:
    """Sums over the rows that have both columns, for every pair i <= j.

    ``(by, i, j, xy, x, y, n)``: products, each column's sum and the rows. A task
    multiplies whole blocks and adds them up; it gives one row for each pair.
    """
    columns, by = list(columns), list(by)
    p, upper = len(columns), np.triu_indices(len(columns))
    mean = np.array([(centre or {}).get(c) or 0.0 for c in columns])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([
        *[T.StructField(c, kinds[c]) for c in by], T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("xy", "x", "y", "n")]])

    def rows_of(held: dict) -> Iterator[pd.DataFrame]:
        for key, (xy, x, n) in held.items():
            yield pd.DataFrame({
                **dict(zip(by, key, strict=True)), "i": upper[0], "j": upper[1], "xy": xy[upper],
                "x": x[upper], "y": x.T[upper], "n": n[upper]})[[f.name for f in schema.fields]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            parts = batch.groupby(by, dropna=False) if by else [((), batch)]
            for key, part in parts:
                z = part[[f"__{i}" for i in range(p)]].to_numpy(dtype=float) - mean
                there = ~np.isnan(z)
                z, there = np.where(there, z, 0.0), there.astype(float)
                new = (z.T @ z, z.T @ there, there.T @ there)
                old = held.get(key)
                held[key] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
            if len(held) * p * p > HELD_CELLS:
                yield from rows_of(held)
                held.clear()
        yield from rows_of(held)

    slim = df.select(*by, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    return slim.mapInPandas(work, schema).groupBy(*by, "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])


def covariance(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance of every pair i <= j: ``(by, a, b, cov)``; centred on the means first."""
    columns = list(columns)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    sums = cross_sums(df, columns, by, {c: means[i] for i, c in enumerate(columns)})
    names = F.array(*[F.lit(c) for c in columns])
    n = F.col("n")
    cov = F.when(n > 1, (F.col("xy") - F.col("x") * F.col("y") / n) / (n - 1))
    return sums.select(*by, names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), cov.alias("cov"))


def covariance_diff(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Covariance of the left table minus that of the right table, cell by cell."""
    l = covariance(left, columns)
    r = covariance(right, columns).withColumnRenamed("cov", "__cov")
    return l.join(r, ["a", "b"]).select("a", "b", (F.col("cov") - F.col("__cov")).alias("cov_diff"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quantile grid ``(by, col, q, value)``: exact by order, or one-pass approximate."""
    if exact:
        return quantile_table(df, columns, probs, by)
    wide = df.groupBy(*by).agg(*[
        F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(f"q_{c}")
        for c in columns
    ])
    cells = [
        F.struct(F.lit(c).alias("col"), F.lit(float(q)).alias("q"), F.col(f"q_{c}")[i].alias("value"))
        for c in columns for i, q in enumerate(probs)
    ]
    return _long(wide, by, cells)


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max: one row per column."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"mean_{c}"),
                 F.stddev_samp(v).alias(f"sd_{c}"), F.min(v).alias(f"lo_{c}"),
                 F.max(v).alias(f"hi_{c}")]
    basic = _long(df.agg(*aggs), [], [
        F.struct(F.lit(c).alias("col"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"),
                 F.col(f"sd_{c}").alias("sd"), F.col(f"lo_{c}").alias("min"),
                 F.col(f"hi_{c}").alias("max"))
        for c in columns
    ])
    cuts = quantile_table(df, columns, QUARTILES).groupBy("col").agg(*[
        F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{int(q * 100)}") for q in QUARTILES
    ])
    return basic.join(cuts, "col", "left").select(
        "col", "n", "mean", "sd", "min", "q25", "q50", "q75", "max"
    )


def value_range(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each column, one row brought back."""
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def bin_of(column: str, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1; values outside the range go to the end bins."""
    if low is None or high is None or math.isclose(low, high, rel_tol=0.0, abs_tol=0.0):
        return F.when(F.col(column).isNotNull(), F.lit(0))
    spot = F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit((high - low) / bins))
    return F.greatest(F.least(spot, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count and density per bin; groups share the bins, empty bins have no row."""
    low, high = value_range(df, [column])[column]
    width = ((high - low) / bins or 1.0) if low is not None else 1.0
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, bin_of(column, low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*by))
    start = F.lit(float(low or 0.0)) + F.col("bin") * F.lit(width)
    return counts.select(*by, "bin", start.alias("bin_start"), "n",
                         (F.col("n") / (total * F.lit(width))).alias("density"))


def histogram2d(df: DataFrame, a: str, b: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each cell of a two-way binning: the data of a pair plot."""
    edges = value_range(df, [a, b])
    counts = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*by, bin_of(a, *edges[a], bins).alias("bin_a"), bin_of(b, *edges[b], bins).alias("bin_b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        *by, "bin_a", "bin_b", "n",
        (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("share"),
    )


def tuning_summary(results: DataFrame, params: Sequence[str], scores: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Mean scores of each full parameter set, parameters keep their type."""
    return results.groupBy(*by, *params).agg(*[F.avg(s).alias(f"mean_{s}") for s in scores])


def tuning_by_parameter(results: DataFrame, params: Sequence[str], scores: Sequence[str],
                        by: Sequence[str] = ()) -> DataFrame:
    """Mean scores of each single parameter value: ``(by, parameter, value, ...)``."""
    long = results.unpivot(
        [*by, *scores], [F.col(p).cast("string").alias(p) for p in params], "parameter", "value"
    )
    return long.groupBy(*by, "parameter", "value").agg(
        *[F.avg(s).alias(f"mean_{s}") for s in scores]
    )


def score_summary(scores: DataFrame, by: Sequence[str], metrics: Sequence[str],
                  sd: str = "pop") -> DataFrame:
    """Mean and spread of each metric over folds or repeats."""
    spread = {"pop": F.stddev_pop, "samp": F.stddev_samp}
    if sd not in spread:
        raise ValueError(f"sd must be 'pop' or 'samp', not {sd!r}")
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), spread[sd](m).alias(f"{m}_sd")]
    return scores.groupBy(*by).agg(*aggs)


def weighted_embedding(df: DataFrame, weight: str, vector: str, by: Sequence[str]) -> DataFrame:
    """Average of level vectors weighted by a probability: ``(by, pos, value)``."""
    cells = df.select(*by, F.col(weight).cast("double").alias("__w"),
                      F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "__v"))
    return cells.groupBy(*by, "pos").agg(
        (F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("value"))
