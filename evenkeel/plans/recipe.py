"""The order-table recipe: dates, delays, pooled levels and codes learned on train."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalars import date_parts, day_diff, fallback
from evenkeel.operators.levels import RARE_BELOW, RARE_MARKER
from evenkeel.operators.ordered import rank_rows
from evenkeel.session import write_scratch


def delivery_features(df: DataFrame, ordered: str, created: str, promised: str,
                      delivered: str) -> DataFrame:
    """Repair delivery dates from each other and the order date, then derive parts and delays.

    The fills run one after the other, so the delivered date sees the repaired
    promised date. The weekday is taken from the promised date, as published.
    """
    df = df.withColumn(promised, fallback(promised, delivered))
    df = df.withColumn(delivered, fallback(delivered, promised))
    df = df.withColumns({promised: fallback(promised, ordered), delivered: fallback(delivered, ordered)})
    real = date_parts(delivered)
    return df.withColumns({
        "first_order_month": date_parts(ordered)["month"],
        "delivered_month": real["month"],
        "delivered_day": real["day"],
        "delivered_weekday": date_parts(promised)["weekday"],
        "account_age": day_diff(delivered, created),
        "order_delay": day_diff(ordered, created),
        "delivery_delay": day_diff(delivered, promised),
    })


def order_features_recipe(train: DataFrame, test: DataFrame, dates: dict[str, str],
                          missing: dict[str, str], pooled: Sequence[str], coded: Sequence[str],
                          order: str, spent: Sequence[str] = (), min_count: int = RARE_BELOW,
                          ) -> tuple[DataFrame, DataFrame]:
    """Fill, derive, pool and encode two tables with what the first one teaches.

    ``dates`` names the columns of ``delivery_features``; ``order`` is the row
    order in which codes are handed out. All level columns are learned in one
    pass over train. A level unknown to train counts as rare in a pooled column
    and gets a null code in any other.
    """
    train, test = (delivery_features(df.fillna(missing), **dates) for df in (train, test))
    columns = list(dict.fromkeys([*pooled, *coded]))
    table = level_table(train, columns, pooled, order, min_count)
    drop = [*dates.values(), *spent]
    return tuple(
        _apply_levels(df, table, columns, pooled, coded).drop(*drop) for df in (train, test))


def level_table(train: DataFrame, columns: Sequence[str], pooled: Sequence[str], order: str,
                min_count: int) -> DataFrame:
    """``(col, level, code)`` of every level kept; rare ones share the marker's row."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in columns])
    found = (
        train.select(order, F.explode(cells).alias("__c")).select(order, "__c.*")
        .filter(F.col("level").isNotNull()).groupBy("col", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    )
    rare = F.col("col").isin(list(pooled)) & (F.col("n") < min_count)
    kept = found.withColumn("level", F.when(rare, F.lit(RARE_MARKER)).otherwise(F.col("level")))
    kept = kept.groupBy("col", "level").agg(F.min("first").alias("first"))
    ranked = rank_rows(kept, "first", "level", by=["col"])
    return write_scratch(ranked.select("col", "level", (F.col("rank") - 1).cast("int").alias("code")), "levels")


def _apply_levels(df: DataFrame, table: DataFrame, columns: Sequence[str], pooled: Sequence[str],
                  coded: Sequence[str]) -> DataFrame:
    rare = {r["col"]: r["code"] for r in table.filter(
        (F.col("level") == RARE_MARKER) & F.col("col").isin(list(pooled))).collect()}
    for c in columns:
        one = table.filter(F.col("col") == c).select(
            F.col("level").alias("__level"), F.col("code").alias("__code"))
        joined = df.withColumn("__key", F.col(c).cast("string")).join(
            one, F.col("__key") == F.col("__level"), "left")
        unknown = F.col("__level").isNull() & F.col("__key").isNotNull()
        if c in coded:
            value = F.col("__code")
            if c in pooled:
                value = F.when(unknown, F.lit(rare.get(c)).cast("int")).otherwise(value)
        else:
            value = F.when(unknown, F.lit(RARE_MARKER)).otherwise(F.col("__key"))
        df = joined.select(*[value.alias(x) if x == c else F.col(x) for x in df.columns])
    return df
