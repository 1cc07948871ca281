"""Parameter grids as tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand_grid(values: dict[str, list], allowed: list[str] | None = None) -> list[dict]:
    """Every combination of the listed parameter values; an unknown name is an error."""
    unknown = sorted(set(values) - set(allowed)) if allowed is not None else []
    if unknown:
        raise ValueError(f"unknown parameters {unknown}")
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def grid_table(df: DataFrame, params: list[str], keep: list[str] = ()) -> DataFrame:
    """Open array columns of parameter values into one row per combination."""
    missing = [p for p in params if p not in df.columns]
    if missing:
        raise ValueError(f"unknown parameters {missing}")
    out = df.select(*keep, *params)
    for p in params:
        out = out.withColumn(p, F.explode(p))
    return out


def experiment_table(spark: SparkSession, config: dict) -> DataFrame:
    """A config as typed rows ``(sampler, model, candidate, parameter, number, text)``."""
    rows = []
    for sampler, s_values in config["samplers"].items():
        for model, m_values in config["models"].items():
            values = {f"sampler__{k}": v for k, v in s_values.items()}
            values |= {f"classifier__{k}": v for k, v in m_values.items()}
            for i, combo in enumerate(expand_grid(values)):
                for name, v in (combo or {"": None}).items():
                    number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
                    text = None if number is not None or v is None else str(v)
                    rows.append((sampler, model, i, name or None, number, text))
    return spark.createDataFrame(
        rows, "sampler string, model string, candidate int, parameter string, number double, text string")


def candidate_folds(grid: DataFrame, folds: list[int]) -> DataFrame:
    """Each candidate with each fold id; folds are few by nature, so they sit in an array."""
    return grid.withColumn("fold", F.explode(F.array(*[F.lit(int(f)) for f in folds])))
