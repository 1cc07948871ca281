"""How many rows each class should have: ``(label, n_current, n_target, n_new)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.session import SMALL_ROWS


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class on the driver; a plan is made for a bounded number of classes."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"{label} has more than {SMALL_ROWS} values; it is not a class label")
    if any(r[label] is None for r in rows):
        raise ValueError(f"label {label} has null values")
    return {r[label]: r["n"] for r in rows}


def plan_table(spark: SparkSession, label: T.StructField, rows: list[tuple]) -> DataFrame:
    schema = T.StructType([
        T.StructField(label.name, label.dataType),
        *[T.StructField(c, T.LongType()) for c in ("n_current", "n_target", "n_new")],
    ])
    return spark.createDataFrame(rows, schema)


def class_targets(counts: dict, strategy="auto", mode: str = "total") -> dict:
    """Rows that each class shall have; see ``sampling_plan``."""
    if not counts:
        raise ValueError("cannot plan an empty table")
    largest = max(counts.values())
    if strategy == "auto":
        target = {c: largest for c in counts}
    elif isinstance(strategy, dict):
        unknown = [c for c in strategy if c not in counts and mode != "new"]
        if unknown:
            raise ValueError(f"classes {unknown} are not in the table")
        if mode == "new":
            if any(n < 0 for n in strategy.values()):
                raise ValueError("the number of new rows cannot be negative")
            target = dict(counts) | {c: counts.get(c, 0) + n for c, n in strategy.items()}
        else:
            target = dict(counts) | strategy
    elif isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        if len(counts) != 2:
            raise ValueError("a ratio needs a label with two classes")
        if not 0 < strategy <= 1:
            raise ValueError(f"a ratio is above 0 and at most 1, not {strategy}")
        small = min(counts, key=lambda c: (counts[c], str(c)))
        target = dict(counts) | {small: int(largest * strategy)}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    short = {c: n for c, n in target.items() if n < counts.get(c, 0)}
    if short:
        raise ValueError(f"targets {short} are below the rows present")
    return target


def sampling_plan(df: DataFrame, label: str, strategy="auto", mode: str = "total") -> DataFrame:
    """Plan for making classes larger.

    ``'auto'`` lifts every class to the size of the largest one. A number is the
    wanted ratio minority / majority of a binary label. A dict gives target
    totals, or with ``mode='new'`` the number of rows to add; classes it does
    not list stay as they are.
    """
    counts = class_counts(df, label)
    target = class_targets(counts, strategy, mode)
    rows = [
        (c, counts.get(c, 0), target[c], target[c] - counts.get(c, 0))
        for c in sorted(target, key=str)
    ]
    return plan_table(df.sparkSession, df.schema[label], rows)


def plan_multiple(df: DataFrame, label: str, factor: float) -> DataFrame:
    """Add ``factor`` times the smallest class to the smallest class."""
    counts = class_counts(df, label)
    small = min(counts, key=lambda c: (counts[c], str(c)))
    return sampling_plan(df, label, {small: int(counts[small] * factor)}, mode="new")


def plan_share(df: DataFrame, label: str, share: float) -> DataFrame:
    """Add ``share`` times the largest class to the smallest class."""
    counts = class_counts(df, label)
    small = min(counts, key=lambda c: (counts[c], str(c)))
    return sampling_plan(df, label, {small: int(max(counts.values()) * share)}, mode="new")


def undersampling_plan(df: DataFrame, label: str, strategy="auto") -> DataFrame:
    """Plan for making classes smaller; ``n_new`` is zero or negative."""
    counts = class_counts(df, label)
    least = min(counts.values())
    if strategy == "auto":
        target = {c: least for c in counts}
    elif isinstance(strategy, dict):
        target = dict(counts) | strategy
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    over = {c: n for c, n in target.items() if n > counts.get(c, 0)}
    if over:
        raise ValueError(f"targets {over} are above the rows present")
    rows = [(c, counts[c], target[c], target[c] - counts[c]) for c in sorted(target, key=str)]
    return plan_table(df.sparkSession, df.schema[label], rows)


def plan_rows(plan: DataFrame) -> list[tuple]:
    """The plan as driver rows ``(label, n_current, n_target, n_new)``; one row per class."""
    return [tuple(r) for r in plan.collect()]
