"""Many training sets side by side in one table, resampled and fitted together.

The training sets of a cross-validation are rows of one table, told apart by a
set number. Every resampling runs once for all sets: a class of a set is a class
of its own, neighbours are searched inside a set, and columns are scaled by the
set's own range. Logistic regressions of all sets and penalties are then fitted
by one Newton method: a step is one job in which each task adds up loss,
gradient and Hessian of every model over its rows, and the driver, which holds
one small system of equations for each model, moves all of them at once. A model
whose loss rose goes half its step back; one that stands still is left out of
later steps.

What a model minimises is the sum of the losses plus ``|w|^2 / (2 C)``, without
the intercept. A level that a set has not seen keeps the coefficient 0, so all
sets share one list of levels. A set with one class gets the constant 0 or 1.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import resample, synthetic
from evenkeel.operators.generator import ConditionalGenerator
from evenkeel.operators.neighbors import ranked, searched_lists
from evenkeel.plans.sampling import class_targets, plan_table
from evenkeel.session import collect_small, write_scratch
from evenkeel.spec import FeatureSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SET, CLASS, ROW = "stack_set", "stack_class", "stack_row"
#: Largest number of sums that all models of a fit may have together; the driver holds them.
MOST_SUMS = 20_000_000
STEPS, HALVINGS, TOLERANCE = 100, 30, 1e-10
#: Rows in a packed block, in all blocks that a task has begun, and rows whose sums are added at once.
BLOCK_ROWS, HELD_ROWS, SUM_ROWS = 32_768, 1_000_000, 4096


# ---- many logistic regressions -----------------------------------------------------

def _upper(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def _sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Rows, positives, loss, gradient and upper half of the Hessian over some rows."""
    z = x @ theta
    least = np.exp(-np.abs(z))
    chance = np.where(z >= 0, 1.0, least) / (1 + least)
    hessian = (x * (least / (1 + least) ** 2)[:, None]).T @ x
    loss = (np.maximum(z, 0.0) + np.log1p(least)).sum() - y @ z
    return np.concatenate([[len(y), y.sum(), loss], x.T @ (chance - y), hessian[_upper(len(theta))]])


def _blocks(table: DataFrame, numbers: Sequence[str] = (), codes: Sequence[str] = ()) -> DataFrame:
    """Rows of a set packed into blocks: ``(set, n, positives, y, x, codes)``, the last three as bytes.

    A row's numbers are the array ``x``, or the columns ``numbers``; ``codes`` are places of levels. A
    task holds a bounded number of rows before it gives them out.
    """
    numbers, codes = list(numbers), list(codes)

    def block(s: int, parts: list) -> pa.RecordBatch:
        y, x, c = (np.concatenate(side) for side in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([int(y.sum())], pa.int64()),
             *(pa.array([v.tobytes()], pa.binary()) for v in (y.astype(np.uint8), x, c))],
            names=[SET, "n", "positives", "y", "x", "codes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of, y = batch.column(SET).to_numpy(), batch.column("y").to_numpy()
            x = np.column_stack([batch.column(c).to_numpy() for c in numbers]) if numbers else (
                np.zeros((n, 0)) if codes else batch.column("x").flatten().to_numpy().reshape(n, -1))
            c = np.column_stack([batch.column(v).to_numpy() for v in codes]).astype(np.int32) if codes else np.zeros(
                (n, 0), np.int32)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            for rows in np.split(order, cuts):
                s = int(of[rows[0]])
                held.setdefault(s, []).append((y[rows], x[rows], c[rows]))
                sizes[s] = sizes.get(s, 0) + len(rows)
                if sizes[s] >= BLOCK_ROWS:
                    yield block(s, held.pop(s))
                    sizes.pop(s)
            if sum(sizes.values()) >= HELD_ROWS:
                for s, parts in held.items():
                    yield block(s, parts)
                held, sizes = {}, {}
        for s, parts in held.items():
            yield block(s, parts)

    return table.mapInArrow(work, f"{SET} int, n bigint, positives bigint, y binary, x binary, codes binary")


def _unpacked(n: int, y: bytes, x: bytes, codes: bytes, levels: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's rows, 0 or 1 for each level, a constant; and their ``y``."""
    numbers = np.frombuffer(x).reshape(n, -1)
    at = np.frombuffer(codes, np.int32).reshape(n, -1)
    p = numbers.shape[1]
    out = np.zeros((n, p + sum(levels) + 1))
    out[:, :p], out[:, -1] = numbers, 1.0
    for j, size in enumerate(levels):
        known = np.flatnonzero(at[:, j] >= 0)
        out[known, p + at[known, j]] = 1.0
        p += size
    return out, np.frombuffer(y, np.uint8).astype(float)


def _added(blocks: DataFrame, thetas: dict[int, np.ndarray], sets: dict[int, list[int]],
           levels: Sequence[int] = ()) -> dict[int, np.ndarray]:
    """The sums of every model over the rows of its set, from one job."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, n, *packed in zip(*(batch.column(c) for c in (SET, "n", "y", "x", "codes")), strict=True):
                x, y = _unpacked(n.as_py(), *(v.as_buffer() for v in packed), levels)
                for m in sets.get(s.as_py(), ()):
                    for start in range(0, len(y), SUM_ROWS):
                        part = slice(start, start + SUM_ROWS)
                        held[m] = held.get(m, 0.0) + _sums(x[part], y[part], thetas[m])
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                names=["model", "s"])

    parts = blocks.mapInArrow(work, "model int, s array<double>").select("model", F.posexplode("s").alias("at", "v"))
    got = parts.groupBy("model", "at").agg(F.sum("v").alias("v")).toArrow()
    model, at, v = (got.column(c).to_numpy() for c in ("model", "at", "v"))
    out = {m: np.zeros(len(_upper(len(t))[0]) + len(t) + 3) for m, t in thetas.items()}
    for m in np.unique(model).tolist():
        mine = model == m
        out[m][at[mine]] = v[mine]
    return out


def fit_logistic(table: DataFrame, width: int, penalties: dict[int, Sequence[float]]) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients and intercept by ``(set, place of its C)``.

    ``table`` has the set number, ``y`` (0 or 1) and ``x``, ``width`` numbers.
    """
    _check_size(width, penalties)
    return _fit_blocks(write_scratch(_blocks(table.select(SET, "y", "x")), "stacked"), width, penalties)


def _check_size(width: int, penalties: dict[int, Sequence[float]]) -> None:
    models = sum(map(len, penalties.values()))
    if models * (width + 1) ** 2 > MOST_SUMS:
        raise ValueError(f"{models} models of {width} features have too many sums for one fit")


def _fit_blocks(blocks: DataFrame, width: int, penalties: dict[int, Sequence[float]],
                levels: Sequence[int] = (), places: dict[int, list[int]] | None = None) -> dict:
    """``fit_logistic`` over packed rows, whose codes stand for ``levels`` of each category.

    ``places`` says under which numbers the rows of a set lie, if not under its own only.
    """
    names = [(s, i) for s, cs in penalties.items() for i in range(len(cs))]
    size = width + 1
    c = np.array([float(penalties[s][i]) for s, i in names])
    weight = np.append(np.ones(width), 0.0)
    theta = {m: np.zeros(size) for m in range(len(names))}
    step: dict[int, np.ndarray] = {}
    loss, halved = dict.fromkeys(theta, np.inf), dict.fromkeys(theta, 0)
    open_, best = set(theta), dict(theta)
    for _ in range(STEPS):
        sets: dict[int, list[int]] = {}
        for m in sorted(open_):
            for s in places[names[m][0]] if places else [names[m][0]]:
                sets.setdefault(s, []).append(m)
        found = _added(blocks.filter(F.col(SET).isin(list(sets))) if len(open_) < len(names) else blocks,
                       {m: theta[m] for m in open_}, sets, levels)
        for m in sorted(open_):
            s = found[m]
            n, positives = s[0], s[1]
            if positives in (0, n):  # nothing to tell apart
                best[m] = np.append(np.zeros(width), -np.inf if positives == 0 else np.inf)
                open_.discard(m)
                continue
            now = s[2] + (weight * theta[m] ** 2).sum() / (2 * c[m])
            if now > loss[m] + 1e-9 * abs(loss[m]) and halved[m] < HALVINGS:
                step[m], halved[m] = step[m] / 2, halved[m] + 1
                theta[m] = best[m] - step[m]
                continue
            best[m], loss[m], halved[m] = theta[m], now, 0
            gradient = s[3:3 + size] + weight * theta[m] / c[m]
            hessian = np.zeros((size, size))
            hessian[_upper(size)] = s[3 + size:]
            hessian += np.triu(hessian, 1).T + np.diag(weight / c[m] + 1e-12)
            step[m] = np.linalg.solve(hessian, gradient)
            theta[m] = theta[m] - step[m]
            if np.abs(step[m]).max() <= TOLERANCE * (1 + np.abs(theta[m]).max()):
                best[m] = theta[m]
                open_.discard(m)
        if not open_:
            break
    return {names[m]: t for m, t in best.items()}


# ---- training sets side by side -------------------------------------------------------

class SetStack:
    """The rows of many training sets, scaled by the range of their own set."""

    def __init__(self, df: DataFrame, spec: FeatureSpec, members: dict[int, Column], scale: bool = True):
        """``members`` says for each set number which rows of ``df`` it trains on."""
        self.spec, self.numbers = spec, list(members)
        # neighbours inside the growing classes, by class; how many of them anyone will want, and if more than once
        self.searched, self.searching, self.widest, self.often = {}, threading.Lock(), 1, False
        self.inner = FeatureSpec(CLASS, ROW, spec.continuous, spec.categorical)
        rows = self._dealt(df, members)
        self.label_type, self.ranges = df.schema[spec.label].dataType, None
        if scale and spec.continuous:
            # one row for each set
            self.ranges = write_scratch(rows.groupBy(SET).agg(F.map_from_arrays(
                F.array(*[F.lit(c) for c in spec.continuous]),
                F.array(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
                          for c in spec.continuous])).alias("__range")), "ranges")
        self.rows = write_scratch(self.scaled(rows).withColumns({
            ROW: F.concat_ws(":", SET, spec.key), CLASS: F.concat_ws("|", SET, spec.label)}).select(
            SET, *self.inner.columns), "sets")
        sizes = collect_small(self.rows.groupBy(CLASS).count(), "classes of all sets")
        self.counts: dict[int, dict[str, int]] = {s: {} for s in members}
        for r in sizes:
            self.counts[int(r[CLASS].partition("|")[0])][r[CLASS]] = r["count"]

    def _dealt(self, df: DataFrame, members: dict[int, Column]) -> DataFrame:
        """Each row once for every set it belongs to."""
        own = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in members.items()]))
        return df.withColumn(SET, F.explode(own)).select(SET, *self.spec.columns)

    def scaled(self, rows: DataFrame) -> DataFrame:
        """Columns in the range of the row's set; a constant column gives 0."""
        if self.ranges is None:
            return rows
        place = {c: F.col("__range")[c] for c in self.spec.continuous}
        return rows.join(F.broadcast(self.ranges), SET).withColumns({
            c: F.when(r["high"] > r["low"], (F.col(c) - r["low"]) / (r["high"] - r["low"])).otherwise(
                F.col(c) * 0.0) for c, r in place.items()}).drop("__range")

    def plan(self, strategy="auto") -> DataFrame:
        """The plan of every set, one after another."""
        rows = []
        for s in self.numbers:
            counts = self.counts[s]
            target = class_targets(counts, strategy if not isinstance(strategy, dict) else {
                f"{s}|{c}": n for c, n in strategy.items()})
            rows += [(c, counts.get(c, 0), n, n - counts.get(c, 0)) for c, n in sorted(target.items())]
        return plan_table(self.rows.sparkSession, T.StructField(CLASS, T.StringType()), rows)

    def growing(self, plan: DataFrame) -> list[str]:
        return [r[CLASS] for r in plan.filter("n_new > 0").collect()]

    def smallest(self) -> list[str]:
        """The smallest class of each set."""
        return [min(c, key=lambda x: (c[x], x)) for c in self.counts.values() if c]

    def asking(self) -> list[str]:
        """All classes but the largest of each set."""
        return [c for counts in self.counts.values() for c in sorted(counts, key=lambda x: (counts[x], x))[:-1]]

    def measured(self, classes: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows in which a differing category costs 1, and what each set was divided by.

        That is the median of the columns' population sds in the given classes of the set.
        """
        spread = F.array_sort(F.array(*[F.stddev_pop(c) for c in self.spec.continuous]))
        n = len(self.spec.continuous)
        middle = (spread[(n - 1) // 2] + spread[n // 2]) / 2
        units = write_scratch(self.rows.filter(F.col(CLASS).isin(classes)).groupBy(SET).agg(
            F.when(middle > 0, middle).otherwise(1e-9).alias("__unit")), "units")
        unit = F.coalesce("__unit", F.lit(1.0))
        rows = self.rows.join(F.broadcast(units), SET, "left").withColumns(
            {c: F.col(c) / unit for c in self.spec.continuous}).drop("__unit")
        return write_scratch(rows, "measured"), units

    def neighbors(self, classes: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``measured`` and the k nearest rows of the same class; settings that differ in k share one search."""
        with self.searching:
            held = self.searched.get(tuple(classes))
            if held is None or held[0] < k:
                rows, units = self.measured(classes)
                widest = max(k, self.widest)
                held = self.searched[tuple(classes)] = (widest, rows, units, searched_lists(
                    rows, self.inner, widest, CLASS, 1.0, classes, often=self.often))
        _, rows, units, lists = held
        return rows, units, ranked(lists(k), self.inner)

    def unmeasured(self, rows: DataFrame, units: DataFrame) -> DataFrame:
        unit = F.coalesce("__unit", F.lit(1.0))
        return rows.withColumn(SET, _set_of(CLASS)).join(F.broadcast(units), SET, "left").withColumns(
            {c: F.col(c) * unit for c in self.spec.continuous}).drop("__unit", SET)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _set_of(name: str) -> Column:
    return F.substring_index(name, "|", 1).cast("int")


def _label_of() -> Column:
    """The label as text."""
    return F.substring(F.col(CLASS), F.length(F.substring_index(CLASS, "|", 1)) + 2, F.length(CLASS))


STACKED: dict[str, Callable] = {}
#: Samplers that leave every row where it is and mark what they add by ``is_synthetic``.
KEEPING = ("unbalanced", "random", "SMOTE", "ADASYN", "generator")


def register_stacked(name: str, fn: Callable) -> None:
    """``fn(stack, strategy, seed, **params)`` returns class and features of all sets' rows."""
    STACKED[name] = fn


def _random(stack: SetStack, strategy, seed):
    return resample.oversample_random(stack.rows, CLASS, ROW, stack.plan(strategy), seed)


def _smote(stack: SetStack, strategy, seed, k_neighbors=5):
    plan = stack.plan(strategy)
    if not stack.spec.categorical:
        return synthetic.smote(stack.rows, stack.inner, plan, int(k_neighbors), seed)
    rows, units, near = stack.neighbors(stack.growing(plan), int(k_neighbors))
    return stack.unmeasured(synthetic.smote_nc(rows, stack.inner, plan, int(k_neighbors), seed, near=near), units)


def _adasyn(stack: SetStack, strategy, seed, n_neighbors=5):
    return synthetic.adasyn(stack.rows, stack.inner, stack.plan(strategy), int(n_neighbors), seed, within=SET)


def _generator(stack: SetStack, strategy, seed, **fit):
    rows = stack.rows.select(*stack.inner.columns)
    new = ConditionalGenerator.fit(rows, stack.inner, **fit).sample(stack.plan(strategy), seed)
    return resample.append_synthetic(rows, new.withColumn(ROW, F.lit(None).cast("string")))


def _tomek(stack: SetStack, strategy, seed):
    return cleaned(stack, stack.rows)


def _under(stack: SetStack, strategy, seed):
    rows = [(c, n, *_less(n, min(counts.values()))) for counts in stack.counts.values() for c, n in sorted(counts.items())]
    plan = plan_table(stack.rows.sparkSession, T.StructField(CLASS, T.StringType()), rows)
    return resample.undersample_random(stack.rows, CLASS, ROW, plan, seed)


def _less(n: int, target: int) -> tuple[int, int]:
    return target, target - n


def one_by_one(stack: SetStack, sampler: Callable, strategy, seed, **params) -> DataFrame:
    """A sampler that knows nothing of sets, called for each of them."""
    spec, out = replace(stack.spec, key=ROW), None
    for s in stack.numbers:
        one = stack.rows.filter(F.col(SET) == s).withColumn(spec.label, _label_of().cast(stack.label_type))
        made = sampler(one.select(*spec.columns), spec, strategy, seed, **params).withColumn(
            CLASS, F.concat_ws("|", F.lit(s), spec.label)).select(*stack.inner.columns)
        out = made if out is None else out.unionByName(made)
    return out


def cleaned(stack: SetStack, rows: DataFrame) -> DataFrame:
    """Rows without the larger class's member of each Tomek link inside a set."""
    keyed = write_scratch(rows.withColumn(SET, _set_of(CLASS)).withColumn(
        ROW, F.concat_ws("+", ROW, F.monotonically_increasing_id())).select(SET, *stack.inner.columns), "resampled")
    kept, penalty = keyed, 0.0
    if stack.spec.categorical and stack.spec.continuous:
        held = SetStack.__new__(SetStack)
        held.__dict__.update(stack.__dict__, rows=keyed)
        kept, _ = held.measured(stack.smallest())
        penalty = 1.0
    left = synthetic.clean_tomek(kept, stack.inner, stack.smallest(), within=SET, penalty=penalty, asking=stack.asking())
    return keyed.join(left.select(ROW), ROW, "left_semi")


for _name, _fn in (("unbalanced", lambda stack, strategy, seed: stack.rows), ("random", _random),
                   ("under", _under), ("SMOTE", _smote), ("ADASYN", _adasyn), ("generator", _generator), ("tomek", _tomek)):
    register_stacked(_name, _fn)
BUILT_IN = dict(STACKED)


# ---- fit and score ------------------------------------------------------------------

class StackedLogistic:
    """Logistic regressions of all training sets, resamplings and penalties."""

    def __init__(self, df: DataFrame, spec: FeatureSpec, members: dict[int, Column], scale: bool = True):
        self.spec = spec
        self.stack = SetStack(df, spec, members, scale)
        self.levels = {}
        for c in spec.categorical:
            rows = collect_small(df.select(F.col(c).cast("string").alias("v")).distinct(), f"levels of {c}")
            self.levels[c] = sorted(r["v"] for r in rows if r["v"] is not None)
        self.width = len(spec.continuous) + sum(map(len, self.levels.values()))
        self.parts: list[DataFrame] = []
        # resamplings that hold all rows of the sets, and the places of such parts
        self.keeping: list[DataFrame] = []
        self.shared: set[int] = set()
        self.own: list[DataFrame] = []
        self.step = max(members) + 1

    def encoded(self, rows: DataFrame) -> Column:
        """Numbers of a row: the continuous columns, and 0 or 1 for each level."""
        cells = [F.col(c).cast("double") for c in self.spec.continuous]
        for c, levels in self.levels.items():
            cells += [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in levels]
        return F.array(*cells) if cells else F.array().cast("array<double>")

    def resampled(self, sampler: str | Callable, params: dict, seed: int = 0, cleaning: bool = False) -> DataFrame:
        """Class and features of the resampled rows of all sets.

        A sampler without a stacked form is passed as a function and called for each set.
        """
        params = dict(params)
        strategy = params.pop("sampling_strategy", "auto")
        rows = one_by_one(self.stack, sampler, strategy, seed, **params) if callable(sampler) else STACKED[sampler](
            self.stack, strategy, seed, **params)
        if cleaning:
            return cleaned(self.stack, rows)
        if sampler in KEEPING and STACKED[sampler] is BUILT_IN[sampler]:
            self.keeping.append(rows)
        return rows

    def add(self, tables: Sequence[DataFrame]) -> StackedLogistic:
        """Resamplings of all sets, to be fitted."""
        for rows in tables:
            place = len(self.parts)
            self.parts.append(self._labelled(rows, _set_of(CLASS) + place * self.step))
            if any(rows is t for t in self.keeping):
                self.shared.add(place)
                new = rows.filter("is_synthetic") if "is_synthetic" in rows.columns else rows.limit(0)
                self.own.append(self._labelled(new, _set_of(CLASS) + place * self.step))
            else:
                self.own.append(self.parts[-1])
        return self

    def _labelled(self, rows: DataFrame, of: Column) -> DataFrame:
        return rows.select(of.alias(SET), F.when(_label_of().cast("double") == 1, 1.0).otherwise(0.0).alias("y"),
                           *self.spec.features)

    def fit(self, penalties: Sequence[float]) -> StackedLogistic:
        """Fit every set of every resampling with every ``C``.

        Rows that several resamplings hold are packed once, under a number below 0.
        """
        self.table = _union(self.parts)
        self.table = self.table.select(SET, "y", self.encoded(self.table).alias("x"))
        kept = [self._labelled(self.stack.rows, -1 - _set_of(CLASS))] if self.shared else []
        table = _union(kept + self.own)
        numbers = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(self.spec.continuous)]
        codes = [self.code(c).alias(f"__c{i}") for i, c in enumerate(self.levels)]
        slim = table.select(SET, "y", *(numbers + codes or [F.array().cast("array<double>").alias("x")]))
        blocks = write_scratch(_blocks(slim, [f"__x{i}" for i in range(len(numbers))],
                                       [f"__c{i}" for i in range(len(codes))]), "stacked")
        found = {r[SET]: (r["n"], r["positives"]) for r in blocks.groupBy(SET).agg(
            F.sum("n").alias("n"), F.sum("positives").alias("positives")).collect()}
        # the numbers under which a set's rows lie
        places = {s: [s] for s in found if s >= 0}
        for s in found:
            if s < 0:
                for place in self.shared:
                    places.setdefault(place * self.step - 1 - s, []).append(s)
        self.sizes = {}
        for s, of in sorted(places.items()):
            n, positives = (sum(found[i][j] for i in of) for j in (0, 1))
            self.sizes[s] = (n, positives / n)
        self.penalties = list(penalties)
        wanted = {s: self.penalties for s in self.sizes}
        _check_size(self.width, wanted)
        self.thetas = _fit_blocks(blocks, self.width, wanted, [len(v) for v in self.levels.values()], places)
        return self

    def code(self, c: str) -> Column:
        """Place of a category's level, -1 without a level."""
        levels = F.array(*[F.lit(v) for v in self.levels[c]]).cast("array<string>")
        return (F.coalesce(F.array_position(levels, F.col(c).cast("string")), F.lit(0)) - 1).cast("int")

    def models(self) -> DataFrame:
        """``(set, resampling, candidate, theta, train_rows, train_share)``, one row for each fit."""
        rows = [(s % self.step, s // self.step, i, t.tolist(), *self.sizes[s]) for (s, i), t in self.thetas.items()]
        return self.stack.rows.sparkSession.createDataFrame(
            rows, f"{SET} int, resampling int, candidate int, theta array<double>, train_rows bigint, train_share double")

    def score(self, df: DataFrame, members: dict[int, Column]) -> DataFrame:
        """Key, label and probability of class 1 of the rows that each set's models shall score."""
        rows = self.stack.scaled(self.stack._dealt(df, members))
        rows = rows.select(SET, self.spec.key, self.spec.label, self.encoded(rows).alias("x"))
        dot = F.aggregate(F.zip_with("x", F.slice("theta", 1, self.width), lambda a, b: a * b),
                          F.element_at("theta", -1), lambda a, b: a + b)
        # models are few; their number times their size is bounded by MOST_SUMS
        return rows.join(F.broadcast(self.models()), SET).select(
            SET, "resampling", "candidate", self.spec.key, self.spec.label,
            (1 / (1 + F.exp(-dot))).alias("score"), "train_rows", "train_share")
