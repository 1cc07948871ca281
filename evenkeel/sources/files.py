"""Scans and sinks: parquet, delimited text, JSON of column arrays, reports, configs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Positions of a JSON object's arrays that are zipped at once.
SLICE = 4096


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t",
                   header: bool = False) -> DataFrame:
    """Delimited text with given names and types; text codes stay text when the schema says so."""
    return (
        spark.read.schema(schema).option("sep", sep).option("header", header)
        .option("mode", "FAILFAST").csv(path)
    )


def read_column_json(spark: SparkSession, path: str, label: str = "Y", features: str = "Xcat",
                     multi_line: bool = True) -> DataFrame:
    """JSON objects with one array per column: ``(block, pos, label, f0, f1, ...)``.

    A file may be one object or, with ``multi_line=False``, one object per line;
    ``block`` tells the objects apart. The arrays of an object are cut into
    slices of positions, zipped and opened into rows where they are read, so a
    row carries its own cells only. ``label`` may be nested once; a label or
    column that is shorter than the longest gives nulls.
    """
    raw = spark.read.option("multiLine", multi_line).json(path)
    kind = raw.schema[label].dataType
    y = F.flatten(label) if isinstance(kind.elementType, T.ArrayType) else F.col(label)
    width = raw.agg(F.max(F.size(features))).first()[0] or 0
    cells = ["label", *[f"f{i}" for i in range(width)]]
    whole = raw.select(
        F.monotonically_increasing_id().alias("block"), y.alias("label"),
        *[F.get(F.col(features), F.lit(i)).alias(f"f{i}") for i in range(width)])
    long = F.coalesce(F.greatest(*[F.size(c) for c in cells], F.lit(0)), F.lit(0))
    starts = F.when(long > 0, F.sequence(F.lit(0), long - 1, F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
    cut = whole.select("*", F.explode(starts).alias("start")).select("block", "start", F.arrays_zip(
        *[F.slice(c, F.col("start") + 1, SLICE).alias(c) for c in cells]).alias("rows"))
    return cut.select("block", "start", F.posexplode("rows").alias("at", "row")).select(
        "block", (F.col("start") + F.col("at")).alias("pos"), *[F.col("row")[c].alias(c) for c in cells])


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each result table as CSV with a header in its own sub-folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def read_experiment(spark: SparkSession, path: str) -> dict:
    """Experiment config: ``{"models": {name: {param: [..]}}, "samplers": {...}}``."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    config = json.loads(text)
    for part in ("models", "samplers"):
        if not isinstance(config.get(part), dict) or not config[part]:
            raise ValueError(f"the config needs a non-empty {part!r} object")
    return config
