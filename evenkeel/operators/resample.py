"""Random and weighted resampling, and putting real and new rows together."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.draws import uniform
from evenkeel.operators.ordered import rank_by_hash, take_lowest
from evenkeel.operators.splits import class_sizes
from evenkeel.plans.sampling import class_counts, plan_rows

ROWS_PER_TASK = 1_000_000


def draw_table(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """One row per new row of the plan: ``(label, draw_id, class_n)``.

    The ids come from a distributed range that is cut at the class borders, so
    the table grows with the plan and never passes through the driver.
    """
    label = plan.schema.fields[0]
    wanted = [(c, current, new) for c, current, _, new in plan_rows(plan) if new > 0]
    total = sum(new for *_, new in wanted)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))
    ids = spark.range(0, total, 1, parts)
    ends = list(accumulate(new for *_, new in wanted))
    if not wanted:
        empty = F.lit(None).cast(label.dataType)
        return ids.select(empty.alias(label.name), F.col("id").alias("draw_id"),
                          F.lit(0).cast("bigint").alias("class_n"))

    def pick(lo: int, hi: int, values: list) -> Column:
        """Balanced comparison tree over the class borders."""
        if hi - lo == 1:
            return F.lit(values[lo])
        mid = (lo + hi) // 2
        return F.when(F.col("id") < ends[mid - 1], pick(lo, mid, values)).otherwise(
            pick(mid, hi, values))

    n = len(wanted)
    starts = [0, *ends[:-1]]
    return ids.select(
        pick(0, n, [c for c, *_ in wanted]).cast(label.dataType).alias(label.name),
        (F.col("id") - pick(0, n, starts)).alias("draw_id"),
        pick(0, n, [current for _, current, _ in wanted]).cast("bigint").alias("class_n"),
    )


def shuffled_index(df: DataFrame, label: str, key: str, seed) -> DataFrame:
    """Dense position of each row within its class in a shuffled order (``__idx``)."""
    return rank_by_hash(df, key, f"idx{seed}", by=[label], out="__idx")


def pick_base(draws: DataFrame, label: str, seed) -> DataFrame:
    """Give every draw an even pick among the rows of its class (``__idx``)."""
    u = uniform([label, "draw_id"], f"base{seed}")
    return draws.withColumn("__idx", (F.floor(u * F.col("class_n")) + 1).cast("bigint"))


def oversample_random(df: DataFrame, label: str, key: str, plan: DataFrame, seed: int = 0,
                      only_new: bool = False) -> DataFrame:
    """Add copies of rows until each class reaches its plan."""
    draws = pick_base(draw_table(df.sparkSession, plan), label, seed)
    growing = [c for c, *_, new in plan_rows(plan) if new > 0]
    base = shuffled_index(df.filter(F.col(label).isin(growing)), label, key, seed)
    new = draws.join(base, [label, "__idx"]).select(*df.columns)
    return mark_synthetic(new, df) if only_new else append_synthetic(df, new)


def undersample_random(df: DataFrame, label: str, key: str, plan: DataFrame,
                       seed: int = 0) -> DataFrame:
    """Keep a shuffled choice of ``n_target`` rows in each class that has more."""
    ranked = rank_by_hash(df, key, f"under{seed}", by=[label], out="__pos")
    keep = F.lit(True)
    for c, current, target, _ in plan_rows(plan):
        if target < current:
            keep = keep & ((F.col(label) != F.lit(c)) | (F.col("__pos") <= target))
    return ranked.filter(keep).select(*df.columns)


def balanced_sample(df: DataFrame, label: str, key: str, n: int | None = None, seed: int = 0,
                    replace: bool = False) -> DataFrame:
    """``n`` rows, each class weighted by one over its size (``n`` defaults to all rows).

    Without replacement the rows with the smallest -ln(1-u) * class size are
    taken, which is a weighted sample in one pass; ``n`` of all rows returns
    every row once. With replacement a class is drawn evenly, then a row of it.
    """
    if not replace:
        sized = df.join(class_sizes(df, label), label)
        arrival = -F.log(F.lit(1.0) - uniform(key, f"weight{seed}")) * F.col("class_n")
        return (sized if n is None else take_lowest(sized, arrival, key, n)).select(*df.columns)
    counts = class_counts(df, label)
    if not counts:
        raise ValueError("cannot draw rows from an empty table")
    n = sum(counts.values()) if n is None else n
    classes = sorted(counts, key=str)
    spot = F.floor(uniform("draw_id", f"class{seed}") * len(classes)).cast("int")
    ids = df.sparkSession.range(0, n, 1, max(1, -(-n // ROWS_PER_TASK)))
    draws = ids.select(
        F.col("id").alias("draw_id"),
        F.array(*[F.lit(c) for c in classes])[spot].cast(df.schema[label].dataType).alias(label),
        F.array(*[F.lit(counts[c]) for c in classes])[spot].cast("bigint").alias("class_n"),
    )
    base = shuffled_index(df, label, key, seed)
    return pick_base(draws, label, seed).join(base, [label, "__idx"]).select("draw_id", *df.columns)


def identity(df: DataFrame) -> DataFrame:
    """The baseline sampler: nothing added, nothing removed."""
    return df.withColumn("is_synthetic", F.lit(False))


def mark_synthetic(new: DataFrame, real: DataFrame) -> DataFrame:
    """New rows in the columns, order and types of the real table, flagged."""
    return new.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in real.schema.fields],
        F.lit(True).alias("is_synthetic"),
    )


def append_synthetic(real: DataFrame, new: DataFrame) -> DataFrame:
    """Real rows followed by new rows cast to the real schema, with ``is_synthetic``."""
    return identity(real).unionByName(mark_synthetic(new, real))


def label_origin(real: DataFrame, synthetic: DataFrame, out: str = "origin") -> DataFrame:
    """Stack both tables; 0 marks a real row, 1 a synthetic one."""
    return real.withColumn(out, F.lit(0)).unionByName(synthetic.withColumn(out, F.lit(1)))


def swap_class(real: DataFrame, synthetic: DataFrame, label: str, value) -> DataFrame:
    """Real rows of the other classes and synthetic rows of one class."""
    return real.filter(F.col(label) != F.lit(value)).unionByName(
        synthetic.filter(F.col(label) == F.lit(value)).select(*real.columns)
    )
