"""Column and row selection: order, cast, drop, fill, recode, class filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.draws import uniform
from evenkeel.operators.ordered import rank_by_hash, rank_rows, take_lowest
from evenkeel.spec import FeatureSpec


def order_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Key, continuous columns, categorical columns, label; nothing else."""
    return spec.require(df)


def split_label(df: DataFrame, spec: FeatureSpec, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and labels as two tables that share the key; spent columns are dropped."""
    return df.drop(spec.label, *drop), df.select(spec.key, spec.label)


def cast_features(df: DataFrame, spec: FeatureSpec, label_type: str = "int") -> DataFrame:
    """Continuous columns to double, categorical ones to text, the label to a code type."""
    casts = {c: F.col(c).cast("double") for c in spec.continuous}
    casts |= {c: F.col(c).cast("string") for c in spec.categorical}
    casts[spec.label] = F.col(spec.label).cast(label_type)
    return df.withColumns(casts)


def take_features(df: DataFrame, spec: FeatureSpec, k: int) -> tuple[DataFrame, FeatureSpec]:
    """The first ``k`` features, continuous ones first."""
    kept = spec.features[:k]
    smaller = spec.with_features(
        [c for c in spec.continuous if c in kept], [c for c in spec.categorical if c in kept]
    )
    return df.select(*smaller.columns), smaller


def vector_columns(df: DataFrame, vector: str, width: int, prefix: str = "x") -> DataFrame:
    """The first ``width`` entries of an array column as double columns."""
    rest = [c for c in df.columns if c != vector]
    return df.selectExpr(
        *[f"`{c}`" for c in rest],
        *[f"cast(`{vector}`[{i}] as double) as `{prefix}{i}`" for i in range(width)])


def drop_constant(df: DataFrame, columns: Sequence[str], value: float | None = None) -> DataFrame:
    """Drop columns with a single value; with ``value``, only those constant at it."""
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    spent = [
        c for c in columns
        if row[f"lo_{c}"] == row[f"hi_{c}"] and (value is None or row[f"lo_{c}"] == value)
    ]
    return df.drop(*spent)


def fill_level(df: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Replace missing text by a marker, column by column."""
    return df.fillna(markers)


def recode(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Replace listed values, keep the others."""
    c: Column = F.col(column)
    for old, new in mapping.items():
        c = F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(c)
    return df.withColumn(column, c.cast(df.schema[column].dataType))


def filter_classes(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Rows of the listed classes."""
    if not isinstance(label, str):
        raise ValueError("a class filter needs exactly one label column")
    if label not in df.columns:
        raise ValueError(f"label column {label} is not in the table")
    return df.filter(F.col(label).isin(list(classes)))


def split_by_class(df: DataFrame, label: str, positive=1) -> tuple[DataFrame, DataFrame]:
    """Rows of the minority class and rows of every other class."""
    return df.filter(F.col(label) == F.lit(positive)), df.filter(F.col(label) != F.lit(positive))


def row_range(df: DataFrame, order: str, key: str, lo: int, hi: int) -> DataFrame:
    """Rows at positions lo..hi-1 (from 0) of an ascending numeric order.

    Negative bounds count from the end, as in a slice.
    """
    ranked = rank_rows(df, order, key, out="__pos", total="__n")
    spot = F.col("__pos") - 1

    def edge(b: int) -> Column:
        return F.lit(b).cast("bigint") if b >= 0 else F.col("__n") + F.lit(b)

    return ranked.filter((spot >= edge(lo)) & (spot < edge(hi))).drop("__pos", "__n")


def prefix_split(df: DataFrame, order: str, key: str, n: int) -> DataFrame:
    """Flag the first ``n`` rows of a numeric order as ``is_train``."""
    ranked = rank_rows(df, order, key, out="__pos")
    return ranked.select(*df.columns, (F.col("__pos") <= n).alias("is_train"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0, replace: bool = False) -> DataFrame:
    """``n`` rows drawn evenly; with replacement, a row can come back several times."""
    if not replace:
        return take_lowest(df, uniform(key, f"sample{seed}"), key, n)
    ranked = rank_by_hash(df, key, f"sample{seed}", out="__pos")
    total = df.count()
    if total == 0:
        raise ValueError("cannot draw rows from an empty table")
    picks = df.sparkSession.range(n).select(
        F.col("id").alias("draw_id"),
        (F.floor(uniform("id", f"pick{seed}") * total) + 1).cast("bigint").alias("__pos"),
    )
    return picks.join(ranked, "__pos").select("draw_id", *df.columns)


def with_norm(df: DataFrame, columns: Sequence[str], out: str = "norm", digits: int = 4) -> DataFrame:
    """Root of the sum of squares, rounded."""
    total: Column = F.lit(0.0)
    for c in columns:
        total = total + F.col(c).cast("double") * F.col(c).cast("double")
    return df.withColumn(out, F.round(F.sqrt(total), digits))
