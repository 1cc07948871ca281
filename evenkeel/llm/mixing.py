"""Mix sources to target weights: capped water-filling, then whole and fractional repeats.

The targets share out the size of all documents by weight, but none exceeds
``MAX_EPOCHS`` times its source; what is cut off is shared by weight among the
others until none is above its cap. Every document of a source is then taken as
often as whole epochs fit. What is left of the target is filled once more in an
order drawn from ``doc_id``: documents are taken while they fit. The first one
that does not fit is passed over, and the filling goes on behind it with those
no larger than what is left, ``FILLS`` times in all. In the end the smallest
document left is taken as well and those that make up its excess are given back,
found in the same way, if that brings the source nearer to its target. Reruns agree.

Cases: a null text has size 0; null sources form one source, the last; ids that
are null come last in the draw; equal rows are interchangeable; documents of
size 0 are taken like their neighbours in the draw and add nothing; an empty
table gives an empty mix; all columns stay.

Sources are ranked and documents summed in slices that Spark deals out, so
neither a long list of sources nor a hot source is one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.draws import uniform
from evenkeel.llm.text import WORD, row_hash, row_id, whole_row
from evenkeel.session import write_scratch

MAX_EPOCHS = 3
WEIGHTS = 3
SALT = "mix"
#: Times that a source is filled with documents no larger than what is left of its target.
FILLS = 4
#: Rounding of a target, in words.
EDGE = 1e-6
#: Documents of a source whose sizes one task adds up.
SLICE_ROWS = 20_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    dealt = write_scratch(sources.repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn(
        "__part", F.spark_partition_id()), "sources")
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *(sizes[p] for p in parts)]), strict=False))
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long")
    return dealt.join(offsets, "__part").withColumn("rank", F.col("__before") + F.row_number().over(
        Window.partitionBy("__part").orderBy(order)) - 1).drop("__part", "__before")


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``n`` and ``target`` from rows of ``source`` and ``size``."""
    sources = _ranked(sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))).withColumn(
        "weight", 1 + F.col("rank") % WEIGHTS).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    sources = write_scratch(sources, "weights")
    level, last = 0.0, -1
    while True:
        capped = F.col("cap") < F.col("weight") * F.lit(level)
        total, cut, free, held = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0)),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0)),
            F.sum(F.when(capped, 1).otherwise(0))).first()
        if not free or held == last:
            break
        level, last = (total - cut) / free, held
    return sources.select("source", "source_size", "n", F.least(
        F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``id``, ``h``, ``size``, ``source_size``, ``target``, ``times`` and ``taken``."""
    rows = write_scratch(docs.select(
        F.col("doc_id"), row_id().alias("id"),
        row_hash().alias("h"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    plan = targets(rows)
    a = rows.withColumn("u", uniform("id", SALT)).withColumn("row", F.monotonically_increasing_id()).alias("a")
    b = plan.withColumnRenamed("source", "s").alias("b")
    df = a.join(b, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    df = write_scratch(df.select(
        "row", "doc_id", "id", "h", "u", "size", "source_size", "target", whole.alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
        F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("none"),
        F.floor(F.col("u") * F.ceil(F.col("n") / SLICE_ROWS)).alias("slice")), "draw")
    hits = _filled(df)
    times = (F.col("whole") + F.coalesce("hit", F.lit(0))).cast("int")
    return df.join(hits, "row", "left").select(
        "doc_id", "id", "h", "size", "source_size", "target", times.alias("times"),
        (times * F.col("size")).cast("long").alias("taken"))


def _fitting(df: DataFrame) -> DataFrame:
    """The rows that fit into ``left`` one after another in the order of the draw."""
    before = F.sum("size").over(Window.partitionBy("k", "none", "slice").orderBy("u", "id", "h", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    ahead = df.groupBy("k", "none", "slice").agg(F.sum("size").alias("held")).withColumn(
        "ahead", F.coalesce(F.sum("held").over(Window.partitionBy("k", "none").orderBy("slice").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    return df.withColumn("before", before).join(ahead, ["k", "none", "slice"]).filter(
        F.col("ahead") + F.col("before") <= F.col("left") + EDGE).select("row", "k", "none", "size")


def _less(left: DataFrame, hit: DataFrame) -> DataFrame:
    """What is left of each source after the rows of ``hit``."""
    used = hit.groupBy("k", "none").agg(F.sum("size").alias("used"))
    return write_scratch(left.join(used, ["k", "none"], "left").select(
        "k", "none", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), "left")


def _fill(spare: DataFrame, left: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that fill ``left``, what they leave of it, and the rows not taken.

    ``whole`` starts with a prefix of the draw; otherwise rows larger than what is left are never looked at.
    """
    found = None
    for turn in range(FILLS):
        near = spare.join(left, ["k", "none"])
        if turn or not whole:
            near = near.filter((F.col("size") > 0) & (F.col("size") <= F.col("left") + EDGE))
        hit = write_scratch(_fitting(near), "fill")
        left = _less(left, hit)
        spare = spare.join(hit.select("row"), "row", "left_anti")
        found = hit if found is None else found.unionByName(hit)
    return found, left, spare


def _filled(df: DataFrame) -> DataFrame:
    """``row`` and ``hit`` (1) of the documents that are taken once more."""
    rest = write_scratch(df.groupBy("k", "none").agg(F.max("rest").alias("left")).filter(F.col("left") > EDGE), "left")
    draw = df.select("row", "k", "none", "slice", "u", "id", "h", "size")
    found, left, spare = _fill(draw, rest, True)
    last = write_scratch(spare.filter("size > 0").join(left, ["k", "none"]).groupBy("k", "none").agg(
        F.min(F.struct("size", "u", "id", "h", "row")).alias("m"), F.max("left").alias("short")).select(
        "m.row", "k", "none", "short", (F.col("m.size") - F.col("short")).alias("left")), "last")
    back, over, _ = _fill(draw.join(found.select("row"), "row", "left_semi"), last.select("k", "none", "left"), False)
    better = over.withColumnRenamed("left", "over").join(last, ["k", "none"]).filter(F.col("over") < F.col("short") - EDGE)
    dropped = back.join(better.select("k", "none"), ["k", "none"], "left_semi").select("row")
    return found.select("row").join(dropped, "row", "left_anti").unionByName(better.select("row")).select(
        "row", F.lit(1).alias("hit"))


def repeated(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    often = mix(docs).select("id", "h", "times").groupBy("id", "h").agg(
        F.max("times").alias("times")).filter("times > 0")
    # the row travels as one column, so that no name of its columns can clash
    df = docs.select(whole_row(docs), row_id().alias("id"), row_hash().alias("h"))
    return df.join(often, ["id", "h"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
