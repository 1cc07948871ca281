"""Exact scoring metrics; each returns one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.ordered import (
    TIE_SALT,
    bucket_count,
    cumulative_by_value,
    rank_by_hash,
    running_sums,
    split_points,
    with_bucket,
)

KS_TERMS = 100


def _is(column: str, value) -> Column:
    return F.when(F.col(column) == F.lit(value), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def cumulative_by_score(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it, below it and in total."""
    out = cumulative_by_value(
        df, score, {"pos": _is(y, 1), "neg": F.lit(1).cast("bigint") - _is(y, 1)}, by
    )
    return out.withColumnRenamed("value", score)


def auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; a tie counts one half, a single class gives null."""
    c = cumulative_by_score(df, y, score, by)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg")))
    pairs = F.sum("pos") * F.lit(1.0) * F.sum("neg")
    return c.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def rank_test(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs that the positive row wins (a tie counts one half) and their variance under permutation.

    Returns ``n_pos``, ``n_neg``, ``won``, ``variance`` and ``z``, how many standard
    deviations ``won`` lies above half of all pairs; z is null when all scores tie
    or a class is missing. One sorted pass; tied scores lower the variance.
    """
    c = cumulative_by_score(df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()), y, score, by)
    tied = (F.col("pos") + F.col("neg")).cast("double")
    got = c.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg"))).alias("won"),
        F.sum(tied * tied * tied - tied).alias("__tied"))
    n = F.col("n_pos") + F.col("n_neg")
    pairs = F.col("n_pos") * F.lit(1.0) * F.col("n_neg")
    variance = F.when(n > 1, pairs / 12 * (n + 1 - F.col("__tied") / (n * F.lit(1.0) * (n - 1)))).otherwise(0.0)
    got = got.withColumn("variance", variance)
    return got.withColumn("z", F.when(F.col("variance") > 0, (F.col("won") - pairs / 2) / F.sqrt("variance"))).drop(
        "__tied")


def rank_by_score(df: DataFrame, score: str, key: str, n: int, best: bool = True) -> DataFrame:
    """The ``n`` rows with the highest (or lowest) score, ties by key."""
    order = F.col(score).desc() if best else F.col(score).asc()
    return df.orderBy(order, F.col(key)).limit(n)


def top_lift(df: DataFrame, y: str, score: str, key: str, p: float,
             by: Sequence[str] = ()) -> DataFrame:
    """Positive share of the floor(n * p) highest scores over the overall share."""
    return _lift_table(df, y, score, key, p, by, True, "top_lift")


def tail_lift(df: DataFrame, y: str, score: str, key: str, p: float,
              by: Sequence[str] = ()) -> DataFrame:
    """Positive share of all rows above the lowest floor(n * p) scores over the overall share.

    This is the rule behind the published lift figures: p = 0.1 keeps the upper 90 %.
    """
    return _lift_table(df, y, score, key, p, by, False, "tail_lift")


def _lift_table(df, y, score, key, p, by, top: bool, out: str) -> DataFrame:
    """Counts by score place the cut; rows are ordered only inside the one score it falls into."""
    if not 0 < p <= 1:
        raise ValueError(f"p must be above 0 and at most 1, not {p}")
    by = list(by)
    slim = df.filter(F.col(score).isNotNull()).select(
        *by, F.col(key).alias("__key"), F.col(score).alias("__score"), _is(y, 1).alias("is_pos"))
    runs = cumulative_by_value(slim, "__score", {"n": F.lit(1), "pos": F.col("is_pos")}, by)
    share = F.floor(F.col("n_total") * F.lit(p))
    # rows up to this position are left out
    cut = (F.col("n_total") - share if top else share).cast("bigint")
    runs = runs.withColumn("cut", cut)
    end = F.col("n_below") + F.col("n")
    # the cut falls into one score of a group at most
    here = (F.col("n_below") < F.col("cut")) & (F.col("cut") < end)
    # a table without groups is one group, not a total: it is read again below
    whole = runs.groupBy(*(by or [F.lit(0).alias("__all")])).agg(
        F.max("n_total").alias("n"), F.max("pos_total").alias("pos"), F.max("cut").alias("cut"),
        F.coalesce(F.sum(F.when(F.col("n_below") >= F.col("cut"), F.col("pos"))), F.lit(0)).alias("sure"),
        F.max(F.when(here, F.col("value"))).alias("__score"),
        F.max(F.when(here, F.col("cut") - F.col("n_below"))).alias("__skip"))
    split = whole.filter(F.col("__skip").isNotNull()).select(*by, "__score", "__skip")
    whole = whole.drop("__score", "__skip", "__all")
    tied = slim.join(split, [*by, "__score"]) if by else slim.join(split, "__score")
    inside = rank_by_hash(tied, "__key", TIE_SALT, by=by, out="at").filter(F.col("at") > F.col("__skip"))
    rest = inside.groupBy(*by).agg(F.sum("is_pos").alias("rest"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("n", "pos", "cut", "sure")]
    both = whole.withColumn("rest", F.lit(0).cast("bigint")).unionByName(
        rest.select(*by, *none, "rest")).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("n", "pos", "cut", "sure")], F.sum("rest").alias("rest"))
    kept = F.col("n") - F.col("cut")
    hit = F.col("sure") + F.coalesce("rest", F.lit(0))
    base = F.col("pos") / F.col("n")
    return both.select(*by, F.when((F.col("pos") > 0) & (kept > 0), hit / kept / base).alias(out))


def _judged(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rows with a label and a score; others can be neither right nor wrong."""
    return df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())


def accuracy(df: DataFrame, y: str, score: str, threshold: float = 0.5,
             by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with label and score whose score falls on the right side of the threshold."""
    df = _judged(df, y, score)
    guess = F.when(F.col(score) > F.lit(threshold), 1).otherwise(0)
    return df.groupBy(*by).agg(
        F.avg(F.when(guess == F.col(y), 1.0).otherwise(0.0)).alias("accuracy")
    )


def f1(df: DataFrame, y: str, score: str, threshold: float | Column,
       by: Sequence[str] = ()) -> DataFrame:
    """F1 of the rows with label and score above the threshold; null without any positive."""
    df = _judged(df, y, score)
    guess = F.when(F.col(score) > (threshold if isinstance(threshold, Column) else F.lit(threshold)), 1).otherwise(0)
    hit = F.sum(F.when((guess == 1) & (F.col(y) == 1), 1).otherwise(0))
    wrong = F.sum(F.when(guess != F.col(y), 1).otherwise(0))
    both = F.lit(2.0) * hit + wrong
    return df.groupBy(*by).agg(F.when(both > 0, F.lit(2.0) * hit / both).alias("f1"))


def _two_groups(df: DataFrame, col: str, group: str, a, b, by, next_value=False) -> DataFrame:
    two = df.filter(F.col(group).isin([a, b]))
    return cumulative_by_value(two, col, {"a": _is(group, a), "b": _is(group, b)}, by,
                               next_value=next_value)


def _share(name: str) -> Column:
    return (F.col(f"{name}_below") + F.col(name)) / F.col(f"{name}_total")


def ks_two_sample(df: DataFrame, col: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Largest distance of the two distribution functions and its asymptotic p-value."""
    c = _two_groups(df, col, group, a, b, by)
    stat = c.groupBy(*by).agg(
        F.max(F.abs(_share("a") - _share("b"))).alias("ks"),
        F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"),
    )
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = root * F.col("ks")
    terms = F.transform(F.sequence(F.lit(1), F.lit(KS_TERMS)), lambda j: (
        F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * j * j * lam * lam)
    ))
    series = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    p = F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))
    return stat.withColumn("p_value", p)


def wasserstein_1d(df: DataFrame, col: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Area between the two distribution functions of a column."""
    c = _two_groups(df, col, group, a, b, by, next_value=True)
    step = F.abs(_share("a") - _share("b")) * (F.col("next_value") - F.col("value"))
    return c.groupBy(*by).agg(F.sum(step).alias("wasserstein"))


def two_sample_table(df: DataFrame, columns: Sequence[str], group: str, a, b) -> DataFrame:
    """Both distances for many columns in one pass: ``(col, ks, wasserstein)``."""
    columns = list(columns)
    two = df.filter(F.col(group).isin([a, b]))
    points = split_points(two, columns, bucket_count(df))
    for i, c in enumerate(columns):
        two = with_bucket(two, c, points[c], f"__b{i}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value"),
                 F.col(f"__b{i}").alias("__b"))
        for i, c in enumerate(columns)])
    long = two.select(_is(group, a).alias("a"), _is(group, b).alias("b"), F.explode(cells).alias("__c"))
    counts = (
        long.select("a", "b", "__c.*").filter(F.col("value").isNotNull())
        .groupBy("col", "__b", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    c = running_sums(counts, ["col"], "value", ["a", "b"], next_value=True)
    gap = F.abs(_share("a") - _share("b"))
    return c.groupBy("col").agg(
        F.max(gap).alias("ks"),
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("wasserstein"))


def score_gap(df: DataFrame, score: str, origin: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean score of real rows (origin 0) minus that of synthetic rows (origin 1)."""
    real, fake = (F.avg(F.when(F.col(origin) == o, F.col(score))) for o in (0, 1))
    return df.groupBy(*by).agg((real - fake).alias("score_gap"))


def fisher_gap(df: DataFrame, score: str, origin: str, by: Sequence[str] = ()) -> DataFrame:
    """Score gap with its second-moment constraint, half the sum of both mean squares."""
    square = F.col(score) * F.col(score)
    real, fake = (F.avg(F.when(F.col(origin) == o, F.col(score))) for o in (0, 1))
    real2, fake2 = (F.avg(F.when(F.col(origin) == o, square)) for o in (0, 1))
    return df.groupBy(*by).agg(
        (real - fake).alias("score_gap"),
        (F.lit(0.5) * real2 + F.lit(0.5) * fake2).alias("constraint"),
    )
