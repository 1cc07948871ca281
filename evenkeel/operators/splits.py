"""Class weights, folds, train/test splits and imbalance ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.draws import uniform
from evenkeel.operators.ordered import rank_by_hash, rank_rows


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """``(label, class_n)``; how it is joined is left to the planner."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight 1 / (rows of the same class) for every row."""
    return df.join(class_sizes(df, label), label).select(
        *df.columns, (F.lit(1.0) / F.col("class_n")).alias(out)
    )


def class_index(df: DataFrame, label: str, key: str, out: str = "idx") -> DataFrame:
    """Dense position 1..n of each row within its class, in key order (numeric key)."""
    return rank_rows(df, key, key, by=[label], out=out)


def stratified_folds(df: DataFrame, label: str, k: int, key: str, seed: int = 0,
                     out: str = "fold") -> DataFrame:
    """Shuffled fold id 0..k-1; fold sizes differ by at most one row in each class."""
    ranked = rank_by_hash(df, key, f"fold{seed}", by=[label], out="__pos")
    return ranked.select(*df.columns, ((F.col("__pos") - 1) % k).cast("int").alias(out))


def repeated_folds(df: DataFrame, label: str, k: int, key: str, repeats: int,
                   seed: int = 0) -> DataFrame:
    """Stratified folds with a new shuffle for each repeat; one row per row and repeat."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = rank_by_hash(many, ["repeat", key], f"fold{seed}", by=[label, "repeat"], out="__pos")
    return ranked.select(*df.columns, "repeat", ((F.col("__pos") - 1) % k).cast("int").alias("fold"))


def nested_folds(df: DataFrame, label: str, outer: int, inner: int, key: str,
                 seed: int = 0) -> DataFrame:
    """Outer fold, and inside each outer fold an inner one with its own shuffle."""
    first = stratified_folds(df, label, outer, key, seed, out="outer_fold")
    ranked = rank_by_hash(first, key, f"inner{seed}", by=[label, "outer_fold"], out="__pos")
    return ranked.select(
        *df.columns, "outer_fold", ((F.col("__pos") - 1) % inner).cast("int").alias("inner_fold")
    )


def stratified_split(df: DataFrame, label: str, test: float, key: str, seed: int = 0) -> DataFrame:
    """Flag ``is_test`` on round(n * test) rows of each class."""
    ranked = rank_by_hash(df, key, f"split{seed}", by=[label], out="__pos", total="__n")
    return ranked.select(
        *df.columns, (F.col("__pos") <= F.round(F.col("__n") * F.lit(test))).alias("is_test")
    )


def random_split(df: DataFrame, test: float, key: str, seed: int = 0) -> DataFrame:
    """Flag ``is_test`` on about a share ``test`` of the rows; no shuffle."""
    return df.withColumn("is_test", uniform(key, f"split{seed}") < F.lit(test))


def _keep_first(df: DataFrame, label: str, key: str, wanted: dict, seed: int) -> DataFrame:
    """The first rows of each listed class in a shuffled order; other classes whole."""
    ranked = rank_by_hash(df, key, f"thin{seed}", by=[label], out="__pos")
    keep = F.lit(True)
    for value, n in wanted.items():
        keep = keep & ((F.col(label) != F.lit(value)) | (F.col("__pos") <= n))
    return ranked.filter(keep).select(*df.columns)


def _two_sizes(df: DataFrame, label: str, positive) -> tuple[object, int, int]:
    sizes = {r[label]: r["class_n"] for r in class_sizes(df, label).collect()}
    if len(sizes) != 2 or positive not in sizes:
        raise ValueError(f"need two classes and {positive!r} among them, found {sorted(map(str, sizes))}")
    other = next(v for v in sizes if v != positive)
    return other, sizes[positive], sizes[other]


def thin_minority(df: DataFrame, label: str, share: float, key: str, total: int | None = None,
                  positive=1, seed: int = 0) -> DataFrame:
    """Constant total, a share ``share`` of minority rows.

    Without ``total`` the largest total that both classes can fill is used.
    """
    other, minority, majority = _two_sizes(df, label, positive)
    if total is None:
        total = int(min(minority / share, majority / (1.0 - share)))
    wanted = {positive: round(total * share), other: total - round(total * share)}
    if wanted[positive] > minority or wanted[other] > majority:
        raise ValueError(f"the table cannot fill {wanted}")
    return _keep_first(df, label, key, wanted, seed)


def thin_majority(df: DataFrame, label: str, share: float, key: str, positive=1,
                  seed: int = 0) -> DataFrame:
    """All minority rows, and as many majority rows as make the minority share ``share``."""
    other, minority, majority = _two_sizes(df, label, positive)
    want = round(minority * (1.0 - share) / share)
    if want > majority:
        raise ValueError(f"{want} rows of the larger class asked for, {majority} present")
    return _keep_first(df, label, key, {other: want}, seed)


def prefix_ratio(df: DataFrame, label: str, ratio: float, key: str, positive=1,
                 seed: int = 0) -> DataFrame:
    """First p + p/ratio rows of the rows sorted by label, p positives in the table.

    The sort puts the smaller label first; inside a class the order is shuffled.
    """
    other, p, n_other = _two_sizes(df, label, positive)
    size = p + int(p / ratio)
    first, n_first = (other, n_other) if other < positive else (positive, p)
    second = positive if first == other else other
    return _keep_first(df, label, key, {first: min(size, n_first), second: max(size - n_first, 0)}, seed)
