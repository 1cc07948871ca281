"""Scalers, one-hot, codes and bins: fit on one table, apply to any.

A fitted encoder is a small set of numbers or levels; it turns into literal
expressions or a lookup join, and can be written as a parquet table.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.scalars import level_code, onehot, onehot_to_label
from evenkeel.operators.levels import apply_codes, levels
from evenkeel.operators.ordered import quantile_table, rank_rows, rank_text
from evenkeel.operators.profile import value_range
from evenkeel.session import collect_small
from evenkeel.spec import FeatureSpec, check_feature_order

MAX_ONEHOT = 10_000


def _level_text(value) -> str:
    """A level as text that keeps its type."""
    kinds = {datetime.datetime: "timestamp", datetime.date: "date", Decimal: "decimal"}
    kind = kinds.get(type(value))
    return json.dumps({kind: str(value)} if kind else value)


def _level_of(text: str):
    value = json.loads(text)
    if isinstance(value, dict):
        (kind, body), = value.items()
        read = {"timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat,
                "decimal": Decimal}
        return read[kind](body)
    return value


@dataclass(frozen=True)
class MinMax:
    """Map the fitted range to [0, 1]; other values may leave it, a constant column gives 0."""

    ranges: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "MinMax":
        return cls(value_range(df, columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.col(c) * 0.0
            for c, (lo, hi) in self.ranges.items()
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.col(c) * F.lit(hi - lo) + F.lit(lo) for c, (lo, hi) in self.ranges.items()
        })

    def rows(self) -> list[tuple]:
        return [("minmax", c, i, None, float(v)) for c, r in self.ranges.items() for i, v in enumerate(r)]


@dataclass(frozen=True)
class Standard:
    """Subtract the mean and divide by the population sd; a constant column gives 0."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Standard":
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).first()
        return cls({c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s) if s > 0 else F.col(c) * 0.0
            for c, (m, s) in self.stats.items()
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.stats.items()})

    def rows(self) -> list[tuple]:
        return [("standard", c, i, None, float(v)) for c, r in self.stats.items() for i, v in enumerate(r)]


@dataclass(frozen=True)
class OneHot:
    """Array of 0/1 per category over its sorted levels; an unseen level gives zeros."""

    table: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "OneHot":
        table = {}
        for c in columns:
            found = [r["level"] for r in collect_small(levels(df, c), f"levels of {c}", MAX_ONEHOT)]
            table[c] = sorted(found)
        return cls(table)

    def transform(self, df: DataFrame, suffix: str = "_onehot") -> DataFrame:
        return df.withColumns({
            f"{c}{suffix}": onehot(F.coalesce(level_code(c, lv), F.lit(-1)), len(lv))
            if lv else F.array().cast("array<double>")
            for c, lv in self.table.items()
        })

    def indicator_columns(self, df: DataFrame) -> DataFrame:
        """One 0/1 column per level instead of an array."""
        return df.withColumns({
            f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
            for c, lv in self.table.items() for v in lv
        })

    def inverse(self, df: DataFrame, suffix: str = "_onehot") -> DataFrame:
        def back(c: str, lv: list) -> Column:
            arr = F.col(f"{c}{suffix}")
            hot = F.array_max(arr) > 0
            return F.when(hot, F.array(*[F.lit(v) for v in lv])[onehot_to_label(arr)])

        out = df.withColumns({c: back(c, lv) for c, lv in self.table.items() if lv})
        return out.drop(*[f"{c}{suffix}" for c in self.table])

    def rows(self) -> list[tuple]:
        return [("onehot", c, -1, None, None) for c in self.table] + [
            ("onehot", c, i, _level_text(v), None) for c, lv in self.table.items() for i, v in enumerate(lv)]


@dataclass(frozen=True)
class QuantileBins:
    """Ordinal bin of each value between quantiles of the fitted table."""

    edges: dict[str, list[float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], bins: int = 5) -> "QuantileBins":
        probs = [i / bins for i in range(1, bins)]
        rows = quantile_table(df, columns, probs).collect()
        edges = {c: sorted({r["value"] for r in rows if r["col"] == c}) for c in columns}
        return cls(edges)

    def transform(self, df: DataFrame) -> DataFrame:
        def code(c: str, cuts: list[float]) -> Column:
            out: Column = F.lit(0)
            for cut in cuts:
                out = out + F.when(F.col(c) >= F.lit(cut), 1).otherwise(0)
            return F.when(F.col(c).isNotNull(), out)

        return df.withColumns({c: code(c, cuts) for c, cuts in self.edges.items()})

    def rows(self) -> list[tuple]:
        return [("bins", c, -1, None, None) for c in self.edges] + [
            ("bins", c, i, None, float(v)) for c, e in self.edges.items() for i, v in enumerate(e)]

    def inverse(self, df: DataFrame) -> DataFrame:
        """A value of the bin: the middle between its edges, the edge itself at both ends."""
        def middle(c: str, cuts: list[float]) -> Column:
            if not cuts:
                return F.lit(None).cast("double")
            ends = [cuts[0], *cuts, cuts[-1]]
            values = [(a + b) / 2 for a, b in zip(ends, ends[1:], strict=False)]
            return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(c).cast("int"))

        return df.withColumns({c: middle(c, cuts) for c, cuts in self.edges.items()})


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """``(level, code)``: codes 0.. by the levels sorted as text."""
    lv = levels(df.select(F.col(column).cast("string").alias(column)), column)
    return rank_text(lv, "level").select("level", (F.col("rank") - 1).cast("int").alias("code"))


def appearance_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(level, code)``: codes 0.. by the first row each level appears in (unique numeric order)."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(
        F.min(order).alias("first"))
    return rank_rows(first, "first", "level").select(
        "level", (F.col("rank") - 1).cast("int").alias("code"))


@dataclass
class Preprocess:
    """Column-wise steps in order: fit each on the output of the one before."""

    spec: FeatureSpec
    steps: list = field(default_factory=list)
    fitted: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> "Preprocess":
        check_feature_order([c for c in df.columns if c in self.spec.features], self.spec)
        self.fitted = []
        for kind, columns in self.steps:
            step = kind.fit(df, columns)
            df = step.transform(df)
            self.fitted.append(step)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.fitted:
            df = step.transform(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        """Undo the steps in reverse order and restore the column order of the spec."""
        for step in reversed(self.fitted):
            df = step.inverse(df)
        return df.select(*[c for c in self.spec.columns if c in df.columns])

    def write(self, spark: SparkSession, path: str) -> None:
        schema = "step int, kind string, col string, pos int, level string, number double"
        rows = [(i, *r) for i, s in enumerate(self.fitted) for r in s.rows()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, spec: FeatureSpec) -> "Preprocess":
        rows = spark.read.parquet(path).orderBy("step", "col", "pos").collect()
        kinds = {"minmax": MinMax, "standard": Standard, "onehot": OneHot, "bins": QuantileBins}
        grouped: dict[int, tuple[str, dict]] = {}
        for r in rows:
            _, content = grouped.setdefault(r["step"], (r["kind"], {}))
            values = content.setdefault(r["col"], [])
            if r["pos"] >= 0:
                values.append(_level_of(r["level"]) if r["kind"] == "onehot" else r["number"])
        out = cls(spec)
        for _, (kind, content) in sorted(grouped.items()):
            pair = kind in ("minmax", "standard")
            out.fitted.append(kinds[kind]({c: tuple(v) if pair else v for c, v in content.items()}))
        return out


__all__ = [
    "MinMax", "OneHot", "Preprocess", "QuantileBins", "Standard", "appearance_codes",
    "apply_codes", "ordinal_codes",
]
