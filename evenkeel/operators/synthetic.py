"""New rows between neighbours (SMOTE family) and removal of ambiguous pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.draws import uniform
from evenkeel.operators.neighbors import knn, links_within, median_sd, neighbor_lists, tomek_links
from evenkeel.operators.resample import (
    append_synthetic,
    draw_table,
    pick_base,
    shuffled_index,
)
from evenkeel.plans.sampling import class_counts, plan_rows
from evenkeel.session import collect_small, write_scratch
from evenkeel.spec import FeatureSpec

DRAWS_PER_BLOCK = 4096


def _growing(plan: DataFrame) -> list:
    rows = [r for r in plan_rows(plan) if r[3] > 0]
    lonely = [c for c, n, *_ in rows if n < 2]
    if lonely:
        raise ValueError(f"classes {lonely} need two rows at least to have neighbours")
    return [c for c, *_ in rows]


def _draws(df: DataFrame, spec: FeatureSpec, plan: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each new row's place of its base in the class, rank of the neighbour and gap; and the rows by place."""
    label = spec.label
    base = shuffled_index(
        df.filter(F.col(label).isin(_growing(plan))).select(label, F.col(spec.key).alias("base")),
        label, "base", seed)
    key = [label, "draw_id"]
    slots = F.least(F.lit(k).cast("bigint"), F.col("class_n") - 1)
    slot = (F.floor(uniform(key, f"slot{seed}") * slots) + 1).cast("int")
    return pick_base(draw_table(df.sparkSession, plan), label, seed).select(
        *key, "__idx", slot.alias("rank"), uniform(key, f"gap{seed}").alias("gap")), base


def draw_pairs(df: DataFrame, spec: FeatureSpec, plan: DataFrame, neighbors: DataFrame, k: int,
               seed: int = 0) -> DataFrame:
    """Base row, neighbour and gap of each new row: ``(label, draw_id, base, neighbor, gap)``.

    Base rows are picked evenly in the class, then one of the row's neighbours.
    """
    draws, base = _draws(df, spec, plan, k, seed)
    near = neighbors.select(F.col(spec.key).alias("base"), "rank", "neighbor")
    return draws.join(base, [spec.label, "__idx"]).join(near, ["base", "rank"]).select(
        spec.label, "draw_id", "base", "neighbor", "gap")


def _with_ends(df: DataFrame, spec: FeatureSpec, near: DataFrame, votes: Sequence[str] = ()) -> DataFrame:
    """Each base row with its numbers, those of its neighbours and the most frequent level among these.

    New rows are made of this table alone, so a base row meets its neighbours
    once, however many new rows it gets.
    """
    own = df.selectExpr(f"`{spec.key}` as base", *[f"`{c}` as `a_{c}`" for c in spec.continuous])
    other = df.selectExpr(f"`{spec.key}` as neighbor", *[f"`{c}` as `b_{c}`" for c in spec.continuous],
                          *[f"`{c}`" for c in votes])
    ends = F.collect_list(F.struct("rank", "neighbor", *[f"b_{c}" for c in spec.continuous]))
    return near.select(F.col(spec.key).alias("base"), "rank", "neighbor").join(other, "neighbor").groupBy("base").agg(
        ends.alias("__ends"), *[F.mode(c, True).alias(c) for c in votes]).join(own, "base")


def _between(draws: DataFrame, spec: FeatureSpec, votes: Sequence[str] = ()) -> DataFrame:
    """base + gap * (neighbour - base) on the continuous columns, for draws that hold ``_with_ends``."""
    chosen = F.filter("__ends", lambda e: e["rank"] == F.col("rank"))
    return draws.withColumn("__end", F.explode(chosen)).selectExpr(
        f"`{spec.label}`", "draw_id", "base", "__end.neighbor as neighbor",
        *[f"`a_{c}` + gap * (__end.`b_{c}` - `a_{c}`) as `{c}`" for c in spec.continuous], *[f"`{c}`" for c in votes])


def _new_rows(df: DataFrame, spec: FeatureSpec, plan: DataFrame, near: DataFrame, k: int, seed: int,
              votes: Sequence[str] = ()) -> DataFrame:
    """The new rows of a plan; ``near`` holds the neighbours inside the growing classes."""
    draws, base = _draws(df, spec, plan, k, seed)
    growing = df.filter(F.col(spec.label).isin(_growing(plan)))
    return _between(draws.join(base.join(_with_ends(growing, spec, near, votes), "base"), [spec.label, "__idx"]),
                    spec, votes)


def _finish(df: DataFrame, spec: FeatureSpec, new: DataFrame, only_new: bool) -> DataFrame:
    """New rows have no key of their own; ``draw_id`` numbers them within the class."""
    real = df.select(*spec.columns)
    keyed = new.withColumn(spec.key, F.lit(None).cast(df.schema[spec.key].dataType))
    if not only_new:
        return append_synthetic(real, keyed)
    rest = [f for f in real.schema.fields if f.name != spec.key]
    return new.select("draw_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in rest],
                      F.lit(True).alias("is_synthetic"))


def smote(df: DataFrame, spec: FeatureSpec, plan: DataFrame, k: int = 5, seed: int = 0,
          only_new: bool = False, **options) -> DataFrame:
    """Rows on the segment between a row and one of its k nearest rows of the same class."""
    if spec.categorical:
        raise ValueError("smote takes continuous features; use smote_nc for mixed ones")
    classes = _growing(plan)
    near = knn(df, spec, k, query_classes=classes, **options)
    return _finish(df, spec, _new_rows(df, spec, plan, near, k, seed), only_new)


def smote_nc(df: DataFrame, spec: FeatureSpec, plan: DataFrame, k: int = 5, seed: int = 0,
             only_new: bool = False, penalty: float | None = None, near: DataFrame | None = None,
             **options) -> DataFrame:
    """SMOTE for mixed features.

    A differing category counts like ``penalty``, by default the median sd of the
    continuous columns in the growing classes; the new category is the most frequent one among the k
    neighbours (the smallest level on a tie). ``near`` gives neighbours that were searched before.
    """
    if not spec.categorical or not spec.continuous:
        raise ValueError("smote_nc needs continuous and categorical features")
    classes = _growing(plan)
    if near is None:
        penalty = median_sd(df, spec, classes) if penalty is None else penalty
        near = knn(df, spec, k, penalty=penalty, query_classes=classes, **options)
    return _finish(df, spec, _new_rows(df, spec, plan, near, k, seed, spec.categorical), only_new)


def adasyn_shares(df: DataFrame, spec: FeatureSpec, minority, n_new: int, k: int = 5,
                  **options) -> DataFrame:
    """New rows per minority row: ``(key, other, n_new)``.

    ``other`` counts the row's k nearest rows of all classes that belong to
    another class; ``n_new`` is the rounded part of the total in that proportion.
    """
    return _shares(_other_class_counts(df, spec, [minority], k, **options), spec, {minority: n_new}).drop(
        spec.label)


def _other_class_counts(df: DataFrame, spec: FeatureSpec, classes: list, k: int, within: str | None = None,
                        **options) -> DataFrame:
    """Neighbours of another class for each row of the given classes, from one search.

    With ``within`` they are looked for among the rows of equal value there only.
    """
    lists = neighbor_lists(df, spec, k, within, query_classes=classes, **options).filter(F.size("list") > 0)
    other = F.size(F.filter("list", lambda e: e["lab"] != F.col("__lab")))
    # a key that comes twice meets its own copies
    return write_scratch(lists.groupBy(F.col("__key").alias(spec.key), F.col("__lab").alias(spec.label)).agg(
        (F.sum(other) * F.count(F.lit(1))).alias("other")), "others")


def _shares(others: DataFrame, spec: FeatureSpec, wanted: dict) -> DataFrame:
    """``(key, label, other, n_new)``: each class's new rows in proportion to ``other``."""
    totals = {r[0]: r[1] for r in others.groupBy(spec.label).agg(F.sum("other")).collect()}
    if not all(totals.get(c) for c in wanted):
        raise ValueError("no row of the class has a neighbour of another class")
    kind = others.schema[spec.label].dataType
    rate = others.sparkSession.createDataFrame(
        [(c, float(n), float(totals[c])) for c, n in wanted.items()],
        T.StructType([T.StructField(spec.label, kind), T.StructField("__n", T.DoubleType()),
                      T.StructField("__all", T.DoubleType())]))
    share = F.rint(F.col("other") * F.col("__n") / F.col("__all"))
    return others.join(rate, spec.label).select(
        spec.key, spec.label, "other", share.cast("bigint").alias("n_new"))


def adasyn(df: DataFrame, spec: FeatureSpec, plan: DataFrame, k: int = 5, seed: int = 0,
           only_new: bool = False, within: str | None = None, **options) -> DataFrame:
    """SMOTE rows placed where other classes are near. Rounded counts may miss the plan slightly.

    Categories take part as codes, the places of their sorted levels: codes that
    differ are as far apart as their numbers, and a new row between two codes has
    no level (null), which one-hot encoding turns into zeros. ``within`` names a
    column whose values are tables of their own: other classes are looked for
    among the rows of the same value only.
    """
    if spec.categorical:
        return _adasyn_on_codes(df, spec, plan, k, seed, only_new, within, **options)
    classes = _growing(plan)
    if classes:
        sizes = {c: (current, n_new) for c, current, _, n_new in plan_rows(plan) if n_new > 0}
        others = _other_class_counts(df, spec, classes, k, within, **options)
        shares = _shares(others, spec, {c: n for c, (_, n) in sizes.items()}).filter(F.col("n_new") > 0)
        near = knn(df, spec, k, query_classes=classes, **options)
        held = others.groupBy(spec.label).agg(F.count(F.lit(1)).alias("class_n"))
        ends = _with_ends(df.filter(F.col(spec.label).isin(classes)), spec, near)
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_new") - 1) / DRAWS_PER_BLOCK)))
        start = F.col("block") * DRAWS_PER_BLOCK
        bases = shares.join(held, spec.label).select(
            spec.label, "class_n", F.col(spec.key).alias("base"), "n_new").join(ends, "base").withColumn("block", block)
        draws = bases.withColumn("draw_id", F.explode(F.sequence(
            start, F.least(start + DRAWS_PER_BLOCK, F.col("n_new")) - 1)))
        slots = F.least(F.lit(k).cast("bigint"), F.col("class_n") - 1)
        slot = (F.floor(uniform(["base", "draw_id"], f"slot{seed}") * slots) + 1).cast("int")
        made = _between(draws.withColumns({"rank": slot, "gap": uniform(["base", "draw_id"], f"gap{seed}")}), spec)
    else:
        made = df.limit(0).select(
            spec.label, F.lit(0).cast("bigint").alias("draw_id"), F.col(spec.key).alias("base"),
            F.col(spec.key).alias("neighbor"), *spec.continuous)
    return _finish(df, spec, made, only_new)


def _adasyn_on_codes(df: DataFrame, spec: FeatureSpec, plan: DataFrame, k: int, seed: int, only_new: bool,
                     within: str | None, **options) -> DataFrame:
    lists = {}
    for c in spec.categorical:
        rows = collect_small(df.select(c).distinct(), f"levels of {c}")
        lists[c] = F.array(*[F.lit(v) for v in sorted(r[c] for r in rows if r[c] is not None)])
    coded = df.withColumns({c: (F.array_position(a, F.col(c)) - 1).cast("double") for c, a in lists.items()})
    numeric = spec.with_features([*spec.continuous, *spec.categorical], [])
    new = adasyn(coded, numeric, plan, k, seed, True, within, **options)
    new = new.withColumns({c: F.when(F.col(c) == F.rint(c), F.get(a, F.col(c).cast("int"))) for c, a in lists.items()})
    return _finish(df, spec, new.drop("is_synthetic"), only_new)


def clean_tomek(df: DataFrame, spec: FeatureSpec, minority=None, within: str | None = None,
                penalty: float | None = None, asking: list | None = None, **options) -> DataFrame:
    """Drop the rows of every Tomek link that are not of the smallest class.

    Mixed features use the category distance of ``smote_nc``. ``within`` names a
    column whose values are tables of their own; ``minority`` then lists the
    class to keep and ``asking`` all classes but the largest of each of them.
    """
    if minority is None:
        counts = class_counts(df, spec.label)
        minority = min(counts, key=lambda c: (counts[c], str(c)))
    kept = minority if isinstance(minority, list) else [minority]
    if penalty is None:
        penalty = median_sd(df, spec, kept) if spec.categorical else 0.0
    links = tomek_links(df, spec, penalty, **options) if within is None else links_within(
        df, spec, within, asking, penalty, **options)
    ends = F.array(F.struct(F.col("a").alias("key"), F.col("label_a").alias("lab")),
                   F.struct(F.col("b").alias("key"), F.col("label_b").alias("lab")))
    spent = links.select(F.explode(ends).alias("e")).filter(
        ~F.col("e.lab").isin(kept)).select(F.col("e.key").alias(spec.key))
    return df.join(spent, spec.key, "left_anti").select(*df.columns)
