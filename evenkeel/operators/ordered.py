"""Order, ranks and running sums without a one-task window.

Rows are cut into buckets that follow the order, every bucket is numbered on
its own, and the small table of bucket totals gives the offset of each bucket.
Buckets are fixed by literal bounds, so a retried task sees the same buckets.
A value that alone fills more than a bucket is cut again by a hash of the key.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.draws import uniform

TIE_SALT = "tie"
FRACTIONS = (T.FloatType, T.DoubleType)
#: Sampled rows for each bucket, and at most: bounds need no more.
SAMPLED, SAMPLE_ROWS, SAMPLE_SEED = 20, 400_000, 17
#: Cells in which ``take_lowest`` counts, and rows that it orders at the end.
BAND_CELLS, BAND_ROWS = 200, 20_000


def bucket_count(df: DataFrame) -> int:
    """A few buckets for each shuffle partition of the session."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, columns: Sequence[str], buckets: int) -> dict[str, list]:
    """Bounds of buckets of each column, from a sample of bounded size.

    They only balance the work; no result depends on them. A value that fills a
    bucket or more is a bound more than once.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    total = df.count()
    share = min(1.0, min(SAMPLE_ROWS, SAMPLED * buckets) / max(total, 1))
    picked = df.select(*columns)
    rows = (picked if share == 1.0 else picked.sample(False, share, SAMPLE_SEED)).collect()
    found = {}
    for i, c in enumerate(columns):
        values = sorted(
            v for v in (r[i] for r in rows)
            if v is not None and not (isinstance(kinds[c], FRACTIONS) and not math.isfinite(v)))
        found[c] = [values[len(values) * q // buckets] for q in range(1, buckets)] if values else []
    return found


def with_bucket(df: DataFrame, column: str, points: list[float], out: str) -> DataFrame:
    """Bucket number that never decreases with the value (NaN last)."""
    bounds = sorted({float(p) for p in points})
    if not bounds:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(
        splits=[-math.inf, *bounds, math.inf], inputCol=column, outputCol=out, handleInvalid="keep"
    )
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def _number(df: DataFrame, by: Sequence[str], buckets: Sequence[str], order: Sequence,
            out: str, total: str | None) -> DataFrame:
    place = [*by, *buckets]
    sizes = df.groupBy(*place).agg(F.count(F.lit(1)).alias("__size"))
    run = Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    keep = [F.coalesce(F.sum("__size").over(run), F.lit(0)).cast("bigint").alias("__before")]
    if total:
        keep.append(F.sum("__size").over(Window.partitionBy(*by)).alias("__total"))
    offsets = sizes.select(*place, *keep)
    inside = Window.partitionBy(*place).orderBy(*order)
    numbered = df.withColumn("__in", F.row_number().over(inside).cast("bigint"))
    names = [c for c in df.columns if not c.startswith("__")]
    extra = [F.col("__total").alias(total)] if total else []
    return numbered.join(offsets, place).select(
        *names, (F.col("__before") + F.col("__in")).alias(out), *extra
    )


def rank_by_hash(df: DataFrame, key: str | Sequence[str], salt, by: Sequence[str] = (),
                 out: str = "rank", total: str | None = None) -> DataFrame:
    """Shuffled position 1..n within ``by``: order by the keyed draw, then the key.

    Draws are uniform, so equal slices of [0, 1) hold equal shares of any group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    drawn = df.withColumn("__u", uniform(keys, salt))
    cut = drawn.withColumn("__b", F.floor(F.col("__u") * bucket_count(df)).cast("int"))
    return _number(cut, by, ["__b"], ["__u", *keys], out, total)


def rank_rows(df: DataFrame, value: str | Column, key: str, by: Sequence[str] = (),
              out: str = "rank", total: str | None = None) -> DataFrame:
    """Ascending position 1..n by a numeric value; ties in the order of a keyed draw."""
    valued = df.withColumn("__v", F.col(value) if isinstance(value, str) else value)
    buckets = bucket_count(df)
    points = split_points(valued, ["__v"], buckets)["__v"]
    bounds = sorted({float(p) for p in points})
    hot = {bisect_right(bounds, float(p)): p for p, n in Counter(points).items() if n > 1}
    cut = with_bucket(valued, "__v", points, "__b").withColumn("__t", uniform(key, TIE_SALT))
    v = F.col("__v")
    odd = F.isnan(v) if isinstance(valued.schema["__v"].dataType, FRACTIONS) else F.lit(False)
    common = F.lit(None).cast(valued.schema["__v"].dataType)
    if hot:
        table = F.create_map(*[F.lit(x) for b, p in hot.items() for x in (b, p)])
        common = F.element_at(table, F.col("__b")).cast(valued.schema["__v"].dataType)
    # nulls come before NaN in the last bucket; a hot value stands between lower and higher ones
    side = (F.when(v.isNull(), 0).when(odd, 1).when(v == common, 1).when(v > common, 2).otherwise(0))
    alike = v.isNull() | odd | F.coalesce(v == common, F.lit(False))
    cut = cut.withColumn("__s", F.when(alike, F.floor(F.col("__t") * buckets).cast("int")).otherwise(0))
    cut = cut.withColumn("__b", 3 * F.col("__b") + side)
    return _number(cut, by, ["__b", "__s"], ["__v", "__t", key], out, total)


def rank_text(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Position 1..n of distinct texts in byte order; buckets lie between sampled texts."""
    bounds = np.array(sorted(set(split_points(df, [column], bucket_count(df))[column])), dtype=object)

    @F.pandas_udf("int")
    def bucket(texts: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, texts.to_numpy(dtype=object), side="right")).astype("int32")

    known = df.filter(F.col(column).isNotNull())
    return _number(known.withColumn("__b", bucket(column)), (), ["__b"], [column], out, None)


def take_lowest(df: DataFrame, value: Column, key: str | Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows with the lowest value, ties by key, without ranking the table.

    Counts between sampled bounds narrow the place of the n-th row down to a few
    thousand rows; only those are ordered. Rows without a value are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    valued = df.withColumn("__v", value).filter(F.col("__v").isNotNull())
    v, band, below, floor = F.col("__v"), valued, 0, None
    while True:
        points = sorted(set(split_points(band, ["__v"], BAND_CELLS)["__v"]))
        cells = dict(with_bucket(band, "__v", points, "__b").groupBy("__b").count().collect()) if points else {}
        start, chosen = below, None
        for b in sorted(cells):
            if start + cells[b] >= n:
                chosen = b
                break
            start += cells[b]
        if chosen is None:
            return valued.drop("__v")
        low = points[chosen - 1] if chosen else None
        high = points[chosen] if chosen < len(points) else None
        narrowed = cells[chosen] < sum(cells.values())
        below, floor = start, floor if low is None else low
        if low is not None:
            band = band.filter(v >= F.lit(low))
        if high is not None:
            band = band.filter(v < F.lit(high))
        if cells[chosen] <= BAND_ROWS or not narrowed:
            break
    edge = band.orderBy(v, *keys).limit(n - below)
    sure = valued.filter(v < F.lit(floor)) if floor is not None else valued.limit(0)
    return sure.unionByName(edge).drop("__v")


def cumulative_by_value(df: DataFrame, value: str, measures: dict[str, Column],
                        by: Sequence[str] = (), points: list[float] | None = None,
                        next_value: bool = False) -> DataFrame:
    """One row for each distinct value with its sums and the sums of all lower values.

    ``measures`` maps a name to a row-level number. Output columns: ``value``,
    each measure, ``<name>_below``, ``<name>_total`` and, if asked for, the next
    higher value. Equal values are added up before any ordering.
    """
    names = list(measures)
    slim = df.select(
        *by, F.col(value).alias("value"), *[m.alias(n) for n, m in measures.items()]
    ).filter(F.col("value").isNotNull())
    if points is None:
        points = split_points(slim, ["value"], bucket_count(df))["value"]
    grouped = slim.groupBy(*by, "value").agg(*[F.sum(n).alias(n) for n in names])
    return running_sums(with_bucket(grouped, "value", points, "__b"), by, "value", names, next_value)


def running_sums(cut: DataFrame, by: Sequence[str], value: str, names: Sequence[str],
                 next_value: bool = False) -> DataFrame:
    """Running sums over bucketed rows (``__b``) that are unique by value within ``by``."""
    place = [*by, "__b"]
    sizes = cut.groupBy(*place).agg(
        *[F.sum(n).alias(f"__sum_{n}") for n in names], F.min(value).alias("__low")
    )
    whole = Window.partitionBy(*by)
    order = whole.orderBy("__b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    keep = []
    for n in names:
        keep.append(F.sum(f"__sum_{n}").over(before).alias(f"__before_{n}"))
        keep.append(F.sum(f"__sum_{n}").over(whole).alias(f"{n}_total"))
    if next_value:
        keep.append(F.lead("__low").over(order).alias("__next_low"))
    offsets = sizes.select(*place, *keep)
    inside = Window.partitionBy(*place).orderBy(value)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        *place, value, *names,
        *[F.sum(n).over(prior).alias(f"__in_{n}") for n in names],
        *([F.lead(value).over(inside).alias("__next_in")] if next_value else []),
    )
    out = [*by, value, *names]
    below = [
        (F.coalesce(F.col(f"__before_{n}"), F.lit(0)) + F.coalesce(F.col(f"__in_{n}"), F.lit(0)))
        .alias(f"{n}_below")
        for n in names
    ]
    tail = [F.coalesce("__next_in", "__next_low").alias("next_value")] if next_value else []
    return local.join(offsets, place).select(*out, *below, *[f"{n}_total" for n in names], *tail)


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, long format ``(by, col, q, value)``.

    Values are counted, ordered in buckets and looked up by position, so no
    task holds the values of a whole column.
    """
    columns = list(columns)
    points = split_points(df, columns, bucket_count(df))
    cut = df
    for i, c in enumerate(columns):
        cut = with_bucket(cut, c, points[c], f"__b{i}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value"),
                 F.col(f"__b{i}").alias("__b"))
        for i, c in enumerate(columns)
    ])
    long = cut.select(*by, F.explode(cells).alias("__cell")).select(*by, "__cell.*")
    group = [*by, "col"]
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy(*group, "__b", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    runs = running_sums(counts, group, "value", ["n"])
    last = F.col("n_total") - 1
    end = F.col("n_below") + F.col("n")
    wanted = F.array(*[F.lit(float(q)) for q in probs])
    hits = F.filter(
        wanted,
        lambda q: (F.floor(q * last) >= F.col("n_below")) & (F.floor(q * last) < end)
        | (F.ceil(q * last) >= F.col("n_below")) & (F.ceil(q * last) < end),
    )
    near = runs.select(
        *group, "value", "n_below", last.alias("last"), end.alias("end"), F.explode(hits).alias("q")
    )
    spot = F.col("q") * F.col("last")
    low_here = (F.floor(spot) >= F.col("n_below")) & (F.floor(spot) < F.col("end"))
    high_here = (F.ceil(spot) >= F.col("n_below")) & (F.ceil(spot) < F.col("end"))
    ends = near.groupBy(*group, "q", "last").agg(
        F.max(F.when(low_here, F.col("value"))).alias("low"),
        F.max(F.when(high_here, F.col("value"))).alias("high"),
    )
    part = F.col("q") * F.col("last") - F.floor(F.col("q") * F.col("last"))
    return ends.select(
        *group, "q", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("value")
    )
