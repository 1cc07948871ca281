"""Joins on labels and category levels: attach, compare, pool, encode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import write_scratch

RARE_MARKER = "___"
RARE_BELOW = 60


def attach_label(x: DataFrame, y: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Features with their labels, rows without a partner dropped."""
    return x.join(y, on, "inner")


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level: ``(level, n)``."""
    return df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct levels, missing values left out."""
    return df.select(F.col(column).alias("level")).filter(F.col("level").isNotNull()).distinct()


def unseen_levels(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Levels of the test table that the training table does not have."""
    return levels(test, column).join(levels(train, column), "level", "left_anti")


def pool_levels(train: DataFrame, test: DataFrame, columns: Sequence[str],
                min_count: int = RARE_BELOW, marker: str = RARE_MARKER) -> tuple[DataFrame, DataFrame]:
    """Replace levels with fewer than ``min_count`` training rows, and unseen ones, by a marker.

    Only the frequent levels are looked up; at most rows / min_count of them exist.
    """
    for c in columns:
        kept = write_scratch(
            train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") >= min_count).select(c, F.lit(True).alias("__kept")),
            "levels")
        train, test = (_pool(df, c, kept, marker) for df in (train, test))
    return train, test


def _pool(df: DataFrame, column: str, kept: DataFrame, marker: str) -> DataFrame:
    pooled = F.when(
        F.col("__kept").isNotNull() | F.col(column).isNull(), F.col(column)
    ).otherwise(F.lit(marker))
    return df.join(kept, column, "left").select(
        *[pooled.alias(c) if c == column else F.col(c) for c in df.columns]
    )


def apply_codes(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace a level by its code from a ``(level, code)`` table; an unknown level gives null."""
    out = out or column
    table = codes.select(F.col("level").alias(column), F.col("code").alias("__code"))
    joined = df.join(table, column, "left")
    kept = [c for c in df.columns if c != out]
    order = df.columns if out in df.columns else [*df.columns, out]
    named = {c: F.col(c) for c in kept} | {out: F.col("__code").alias(out)}
    return joined.select(*[named[c] for c in order])
