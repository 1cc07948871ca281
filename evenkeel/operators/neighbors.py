"""Exact nearest neighbours, block against block.

1. Rows with equal features become one point that remembers its k + 1 smallest
   keys; more copies can never be needed to fill k places.
2. Points join the cell of their nearest pivot. Pivots are numbered along a tree
   of halves, so cells with near numbers lie near each other, and the cells of a
   group are cut, in that order, into blocks of limited size. However small the
   cells are, a block is full; a hot cell is many blocks.
3. Each block of queries first searches itself, which bounds the k-th distance of
   its points; only the bounds leave the task. The triangle inequality then names
   the cells that could hold a nearer point for any of them.
4. The blocks of those cells go to a few blocks of queries together. So a vector
   is copied once for some ten thousand queries, not for each of them. Inside a
   task boxes around small leaves of points are ruled out by the bounds; a query's
   nearest rows leave the task with their keys and labels.

Equal distances are ordered by key. Distances count a numeric difference by its
square and a differing category by the square of ``penalty``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.functions.draws import uniform
from evenkeel.session import drop_scratch, write_scratch
from evenkeel.spec import FeatureSpec

# send the helpers below with the task, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points in a block of queries or members, and the bytes their features may take.
BLOCK_POINTS = 8192
BLOCK_BYTES = 4 << 20
#: Pivots are broadcast; their number and so the size of what is sent is bounded.
MAX_PIVOTS = 1024
#: Cells for each block; smaller cells rule out more.
CELLS_PER_BLOCK = 4
#: Neighbouring blocks that one task searches together: of queries and of members.
QUERY_BLOCKS = 2
MEMBER_BLOCKS = 4
TASKS_PER_CORE = 4
#: Rows of copies of one vector that one slice of them holds.
SLICE_ROWS = 50_000
QUERY_STEP = 256
#: Points in a leaf, columns beyond which boxes rule out nothing, and members compared at once.
LEAF_POINTS = 64
LEAF_COLUMNS = 12
MEMBER_STEP = 1024
#: Members that give a query's first bound.
NEAR_POINTS = 256
SLACK = 1e-9


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared length of each vector."""
    return np.einsum("ij,ij->i", x, x)


def _square_distances(xa, ca, xb, cb, penalty2: float) -> np.ndarray:
    """All squared distances between two blocks, up to rounding."""
    d2 = xa @ xb.T
    d2 *= -2.0
    d2 += _squares(xa)[:, None]
    d2 += _squares(xb)
    np.maximum(d2, 0.0, out=d2)
    for j in range(ca.shape[1]):
        d2 += penalty2 * (ca[:, j][:, None] != cb[:, j][None, :])
    return d2


def _leaves(x: np.ndarray, c: np.ndarray, penalty: float, size: int) -> list[np.ndarray]:
    """Row numbers cut into halves along the widest column until ``size`` rows at most are left."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        half = len(rows) // 2
        if 0 < x.shape[1] + c.shape[1] <= LEAF_COLUMNS:
            wide = np.concatenate([np.ptp(x[rows], axis=0), penalty * (np.ptp(c[rows], axis=0) > 0)])
            j = int(wide.argmax())
            values = x[rows, j] if j < x.shape[1] else c[rows, j - x.shape[1]]
            rows = rows[np.argsort(values, kind="stable")]
        todo += [rows[half:], rows[:half]]
    return out


def _boxes(x: np.ndarray, c: np.ndarray, leaves: list) -> tuple:
    """Smallest and largest number and category code in each leaf."""
    return tuple(np.array([f(v[rows], axis=0) for rows in leaves])
                 for v, f in ((x, np.min), (x, np.max), (c, np.min), (c, np.max)))


def _box_distances(q: np.ndarray, c: np.ndarray, boxes: tuple, penalty2: float) -> np.ndarray:
    """Squared distance from each query to each box, at most that of the query to any point in it."""
    low, high, first, last = boxes
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        out += np.maximum(np.maximum(low[:, j] - q[:, [j]], q[:, [j]] - high[:, j]), 0.0) ** 2
    for j in range(c.shape[1]):
        out += penalty2 * ((first[:, j] > c[:, [j]]) | (last[:, j] < c[:, [j]]))
    return out


def _places(keys) -> np.ndarray:
    """Place of each key in their order."""
    order = np.empty(len(keys), np.int64)
    order[pc.array_sort_indices(pa.array(keys)).to_numpy()] = np.arange(len(keys))
    return order


def _nearest_in_block(xq, cq, xm, cm, keys, k: int, penalty2: float, bound2: np.ndarray):
    """Yield (query numbers, member numbers, squared distances): for each query its k nearest members,
    without those that lie beyond the query's bound.

    Rough distances pick the members in reach; their distances are then worked
    out term by term, so equal vectors have equal distances, and ordered by key.
    """
    order = _places(keys)
    scale = _squares(xm).max(initial=0.0)
    penalty = penalty2**0.5
    boxed = xm.shape[1] + cm.shape[1] <= LEAF_COLUMNS
    leaves = _leaves(xm, cm, penalty, LEAF_POINTS if boxed else MEMBER_STEP)
    boxes = _boxes(xm, cm, leaves)
    sizes = np.array([len(rows) for rows in leaves])
    for asked in _leaves(xq, cq, penalty, LEAF_POINTS if boxed else QUERY_STEP):
        q, c, limit = xq[asked], cq[asked], bound2[asked]
        own = scale + _squares(q)
        least = _box_distances(q, c, boxes, penalty2)
        if np.isinf(limit).any() and len(xm) >= k:
            near = np.argsort(least.sum(axis=0), kind="stable")
            near = near[:1 + int(np.searchsorted(np.cumsum(sizes[near]), max(NEAR_POINTS, 2 * k)))]
            some = np.concatenate([leaves[i] for i in near])
            rough = _square_distances(q, c, xm[some], cm[some], penalty2)
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, kth + SLACK * (kth + own))
        reach = limit + SLACK * (np.where(np.isinf(limit), 0.0, limit) + own)
        kept = np.flatnonzero((least <= reach[:, None]).any(axis=0))
        if not len(kept):
            continue
        some = np.concatenate([leaves[i] for i in kept])
        pairs = []
        for start in range(0, len(some), MEMBER_STEP):
            part = some[start:start + MEMBER_STEP]
            rough = _square_distances(q, c, xm[part], cm[part], penalty2)
            at, to = np.nonzero(rough <= reach[:, None])
            pairs.append((at, part[to]))
        at, to = (np.concatenate(side) for side in zip(*pairs, strict=True))
        d2 = np.zeros(len(at))
        for j in range(q.shape[1]):
            d2 += (xm[to, j] - q[at, j]) ** 2
        for j in range(c.shape[1]):
            d2 += penalty2 * (cm[to, j] != c[at, j])
        best = np.lexsort((order[to], d2, at))
        at, to, d2 = at[best], to[best], d2[best]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield asked[at[first]], to[first], d2[first]


def _point_columns(spec: FeatureSpec, within: str | None) -> tuple[Column, Column, Column]:
    """Group, numeric array and category array of a row."""
    # adding zero turns -0.0 into 0.0, so equal numbers group together
    x = ", ".join(f"cast(`{c}` as double) + 0e0" for c in spec.continuous)
    c = ", ".join(f"cast(`{c}` as string)" for c in spec.categorical)
    x, c = F.expr(f"cast(array({x}) as array<double>)"), F.expr(f"cast(array({c}) as array<string>)")
    return F.lit("") if within is None else F.col(within).cast("string"), x, c


def points_of(df: DataFrame, spec: FeatureSpec, k: int, within: str | None,
              askers: list | None = None) -> DataFrame:
    """Distinct feature vectors: group, x, c, vid, ``ask`` and the k + 1 smallest (key, label).

    Rows of equal value in the column ``within`` are a group. ``ask`` tells whether any row of the vector, remembered or not, is of an
    asking class. Both parts are cut down before the shuffle, so a vector that
    a third of all rows share stays cheap.
    """
    group, x, c = _point_columns(spec, within)
    # the hash comes first, so sorts rarely compare the arrays
    vector = ["h", "g", "x", "c"]
    slim = df.select(
        F.xxhash64(group, x, c).alias("h"), group.alias("g"), x.alias("x"), c.alias("c"),
        F.col(spec.key).alias("key"), F.col(spec.label).alias("lab"),
    )
    order = Window.partitionBy(*vector).orderBy("key")
    firsts = slim.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).select(
        *vector, F.struct("key", "lab").alias("member"), F.lit(askers is None).alias("ask"))
    if askers is not None:
        marks = slim.filter(F.col("lab").isin(askers)).select(*vector).distinct()
        none = F.lit(None).cast(firsts.schema["member"].dataType)
        firsts = firsts.unionByName(marks.select("*", none.alias("member"), F.lit(True).alias("ask")))
    return firsts.groupBy(*vector).agg(
        F.min("member.key").alias("vid"), F.max("ask").alias("ask"),
        F.sort_array(F.collect_list("member")).alias("members"),
    ).drop("h")


def _numbered(pivots: list, penalty: float) -> list:
    """The pivots in an order that keeps near ones together."""
    x, c = _pivot_features(pivots)
    return [pivots[i] for rows in _leaves(x, _matched(c, c, len(x), len(x))[0], penalty, 1) for i in rows]


def _pivot_features(pivots: list) -> tuple[np.ndarray, pa.Array]:
    return (np.array([p["x"] for p in pivots], float).reshape(len(pivots), -1),
            pa.array([v for p in pivots for v in p["c"]], pa.string()))


def _assign_cells(points: DataFrame, pivots: list, penalty2: float) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(_pivot_features(pivots))
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("dist", T.DoubleType())])

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xp, cp = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, c = (batch.column(f).flatten() for f in ("x", "c"))
            xq = x.to_numpy(zero_copy_only=False).reshape(n, -1) if len(x) else np.zeros((n, 0))
            codes_q, codes_p = _matched(c, cp, n, len(xp))
            cell, dist = np.zeros(n, "int32"), np.zeros(n)
            for start in range(0, n, QUERY_STEP):
                part = slice(start, start + QUERY_STEP)
                d2 = _square_distances(xq[part], codes_q[part], xp, codes_p, penalty2)
                cell[part] = d2.argmin(axis=1)
                dist[part] = np.sqrt(d2.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names=schema.names)

    return points.mapInArrow(nearest_pivot, schema)


def _features(points: pa.StructArray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Numbers, categories one row after another, and keys of packed points."""
    n = len(points)
    x, c = (points.field(f).flatten() for f in ("x", "c"))
    x = x.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1) if len(x) else np.zeros((n, 0))
    return x, c, points.field("vid")


def _packed(table: pa.Table) -> pa.StructArray:
    chunks = [chunk.flatten() for chunk in table.column("points").chunks]
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _matched(ca: pa.Array, cb: pa.Array, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Categories of ``na`` and ``nb`` points as integers that agree between them."""
    if not len(ca) or not len(cb):
        return np.zeros((na, 0), int), np.zeros((nb, 0), int)
    codes = pa.concat_arrays([ca, cb]).dictionary_encode().indices.to_numpy().astype(int)
    return codes[:len(ca)].reshape(na, -1), codes[len(ca):].reshape(nb, -1)


def _cells(placed: DataFrame) -> DataFrame:
    """Each cell of a group: its points, those of the cells before it and the range of distances to the pivot."""
    before = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # a group has no more cells than there are pivots
    return placed.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _blocks(placed: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """One row for each block, ``g``, ``z`` and its packed points: a group's cells, one after the other, cut
    every ``limit`` points."""
    at = F.col("start") + uniform("vid", "block") * F.col("n")
    return placed.join(cells.select("g", "cell", "n", "start"), ["g", "cell"]).groupBy(
        "g", F.floor(at / limit).cast("int").alias("z")).agg(
        F.collect_list(F.struct("vid", "x", "c", "ask", "cell", "members")).alias("points"),
        F.max("ask").alias("asks"))


def _bounded(blocks: DataFrame, k: int, penalty2: float, tasks: int) -> DataFrame:
    """The asking points of each block, packed, each with a distance within which k + 1 rows of its block lie."""
    fields = blocks.schema["points"].dataType.elementType
    packed = T.StructType([fields[f] for f in ("vid", "x", "c", "cell")] + [T.StructField("bound", T.DoubleType())])
    schema = T.StructType([blocks.schema["g"], blocks.schema["z"], T.StructField("points", T.ArrayType(packed))])
    to_arrow = to_arrow_schema(schema)

    def bound_block(block: pa.Table) -> pa.Table:
        points = _packed(block)
        asked = points.filter(points.field("ask"))
        (xq, cq, _), (xm, cm, names) = _features(asked), _features(points)
        codes_q, codes_m = _matched(cq, cm, len(xq), len(xm))
        held = points.field("members").value_lengths().to_numpy(zero_copy_only=False)
        bound2 = np.full(len(asked), np.inf)
        for at, to, d2 in _nearest_in_block(xq, codes_q, xm, codes_m, names, k + 1,
                                            penalty2, bound2.copy()):
            enough = _running(at, held[to]) >= k + 1
            np.minimum.at(bound2, at[enough], d2[enough])
        columns = [asked.field(f.name) for f in packed.fields[:-1]] + [pa.array(np.sqrt(bound2))]
        rows = pa.StructArray.from_arrays(columns, names=packed.names)
        return pa.table([block.column("g"), block.column("z"), pa.ListArray.from_arrays([0, len(asked)], rows)],
                        names=schema.names).cast(to_arrow)

    return blocks.filter("asks").repartition(tasks, "g", "z").groupBy("g", "z").applyInArrow(bound_block, schema)


def _running(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums of ``n`` among neighbouring entries with the same number ``at``."""
    total = np.cumsum(n)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))[:len(at)]
    return total - np.repeat((total - n)[first], np.diff(np.append(first, len(at))))


def _open_cells(queries: DataFrame, stats: DataFrame, pivots: list, penalty2: float) -> DataFrame:
    """For each block of queries the cells that some query's bound cannot rule out."""
    shared = queries.sparkSession.sparkContext.broadcast(_pivot_features(pivots))

    def open_cells(queries: pa.Table, cells: pa.Table) -> pa.Table:
        xp, cp = shared.value
        points = _packed(queries)
        xq, cq, _ = _features(points)
        bound, cell = (points.field(f).to_numpy(zero_copy_only=False) for f in ("bound", "cell"))
        other, low, high = (cells.column(n).to_numpy() for n in ("other", "low", "high"))
        codes_q, codes_p = _matched(cq, cp, len(xq), len(xp))
        gaps = np.sqrt(_square_distances(xp, codes_p, xp[other], codes_p[other], penalty2))
        need = np.zeros(len(other), bool)
        for start in range(0, len(xq), QUERY_STEP):
            part = slice(start, start + QUERY_STEP)
            d = np.sqrt(_square_distances(xq[part], codes_q[part], xp, codes_p, penalty2))
            do, dc, gap = np.take_along_axis(d, cell[part][:, None], axis=1), d[:, other], gaps[cell[part]]
            with np.errstate(divide="ignore", invalid="ignore"):
                side = np.where(gap > 0, (dc**2 - do**2) / (2.0 * gap), 0.0)
            # nothing lies between a query and its own cell
            side[cell[part][:, None] == other] = 0.0
            least = np.maximum(np.maximum(dc - high, low - dc), side)
            room = 1e-7 * (1.0 + d.max(axis=1))
            need |= (least <= (bound[part] + room)[:, None]).any(axis=0)
        hit = other[need]
        g, z = (queries.column(n)[0].as_py() for n in ("g", "z"))
        return pa.table({"g": pa.array([g] * len(hit), pa.string()), "z": pa.array([z] * len(hit), pa.int32()),
                         "cell": pa.array(hit, pa.int32())})

    ranges = queries.select("g", "z").join(
        stats.select("g", F.col("cell").alias("other"), "low", "high"), "g")
    # both sides come from one table; new aliases keep their columns apart
    queries, ranges = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (queries, ranges))
    return queries.groupBy("g", "z").cogroup(ranges.groupBy("g", "z")).applyInArrow(
        open_cells, "g string, z int, cell int")


def _search(queries: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, penalty2: float,
            tasks: int | None = None, together: tuple[int, int] = (1, 1)) -> DataFrame:
    """The k + 1 nearest rows of each query in the blocks paired with its block: ``(g, vid, d2, key, lab)``.

    ``pairs`` has ``g``, ``z`` (queries) and ``mz`` (members); ``together`` says how
    many neighbouring blocks of queries and of members meet in a task. Points
    beyond the ``bound`` of a query, where it has one, are left out.
    """
    point = blocks.schema["points"].dataType.elementType
    row = point["members"].dataType.elementType
    schema = T.StructType([
        blocks.schema["g"], T.StructField("vid", point["vid"].dataType), T.StructField("d2", T.DoubleType()),
        *row.fields,
    ])

    def block_search(queries: pa.Table, members: pa.Table) -> pa.Table:
        if not queries.num_rows or not members.num_rows:
            return to_arrow.empty_table()
        asked = _packed(queries)
        if "ask" in [f.name for f in asked.type]:
            asked = asked.filter(asked.field("ask"))
            bound2 = np.full(len(asked), np.inf)
        else:
            bound2 = asked.field("bound").to_numpy(zero_copy_only=False) ** 2
        points = _packed(members)
        (xq, cq, vids), (xm, cm, names) = _features(asked), _features(points)
        codes_q, codes_m = _matched(cq, cm, len(xq), len(xm))
        lists = points.field("members")
        rows, held = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(held) - held
        order = _places(rows.field("key"))
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for at, to, d2 in _nearest_in_block(xq, codes_q, xm, codes_m, names, k + 1,
                                            penalty2, bound2):
            # from points to their rows, of which each query keeps the first
            n = held[to]
            at, d2 = np.repeat(at, n), np.repeat(d2, n)
            to = np.repeat(starts[to] - np.cumsum(n) + n, n) + np.arange(len(at))
            best = np.lexsort((order[to], d2, at))
            at, to, d2 = at[best], to[best], d2[best]
            first = _running(at, np.ones(len(at), int)) <= k + 1
            found.append((at[first], to[first], d2[first]))
        at, to, d2 = (np.concatenate(side) for side in zip(*found, strict=True))
        rows = rows.take(pa.array(to))
        return pa.table([pa.repeat(queries.column("g")[0], len(at)), vids.take(pa.array(at)), pa.array(d2),
                         rows.field("key"), rows.field("lab")], names=schema.names).cast(to_arrow)

    to_arrow = to_arrow_schema(schema)
    place = ["g", "qs", "ms"]
    pairs = pairs.withColumn("qs", F.floor(F.col("z") / together[0])).withColumn(
        "ms", F.floor(F.col("mz") / together[1]))
    q = pairs.select("g", "z", "qs", "ms").distinct().join(queries.select("g", "z", "points"), ["g", "z"])
    m = pairs.select("g", "mz", "qs", "ms").distinct().join(
        blocks.select("g", F.col("z").alias("mz"), "points"), ["g", "mz"])
    # both sides come from one table; new aliases keep their columns apart
    q, m = (side.select(*[F.col(c).alias(c) for c in [*place, "points"]]) for side in (q, m))
    if tasks:
        # a task's work goes by pairs of points, not by bytes
        q, m = (side.repartition(tasks, *place) for side in (q, m))
    return q.groupBy(*place).cogroup(m.groupBy(*place)).applyInArrow(block_search, schema)


class PointIndex:
    """The distinct vectors of a table, in blocks that queries can be searched in."""

    def __init__(self, rows: DataFrame, spec: FeatureSpec, k: int, within: str | None, askers: list | None,
                 penalty: float, block_points: int | None = None, lone: bool = False):
        """``lone``: only vectors that a single row has ask."""
        self.k, self.penalty2 = k, float(penalty) ** 2
        points = points_of(rows, spec, k, within, askers)
        if lone:
            points = points.withColumn("ask", F.col("ask") & (F.size("members") == 1))
        self.points = points = write_scratch(points, "points")
        broken = (
            F.exists("x", lambda v: v.isNull()) | F.exists("c", lambda v: v.isNull())
            | F.exists("members", lambda m: m["key"].isNull() | m["lab"].isNull()) | F.col("g").isNull()
        )
        n_points, n_broken = points.agg(F.count(F.lit(1)), F.count_if(broken)).first()
        if n_broken:
            raise ValueError("null value in a feature, label or key; fill it before resampling")
        each = 8 * (len(spec.continuous) + len(spec.categorical) + 2)
        self.limit = max(256, min(BLOCK_POINTS, BLOCK_BYTES // each))
        in_cell = self.limit / CELLS_PER_BLOCK if block_points is None else block_points
        n_pivots = 1 if n_points <= self.limit and block_points is None else max(1, min(
            math.ceil(n_points / in_cell), MAX_PIVOTS))
        self.pivots = None
        if n_pivots == 1:
            self.limit = max(self.limit, n_points)
            placed = points.withColumn("cell", F.lit(0)).withColumn("dist", F.lit(0.0))
            self.blocks = _blocks(placed, _cells(placed), self.limit)
        else:
            self.tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
            self.pivots = _numbered(points.orderBy(uniform("vid", "pivot"), "g", "vid").limit(n_pivots).select(
                "x", "c").collect(), float(penalty))
            placed = write_scratch(_assign_cells(points, self.pivots, self.penalty2), "placed")
            self.cells = write_scratch(_cells(placed), "cells")
            self.blocks = write_scratch(_blocks(placed, self.cells, self.limit), "blocks")
            drop_scratch(placed)

    def near(self) -> DataFrame:
        """The k + 1 nearest rows of each asking point, from several blocks: ``(g, vid, d2, key, lab)``."""
        if self.pivots is None:
            asking = self.blocks.filter("asks")
            return _search(asking, self.blocks, asking.select("g", "z", F.col("z").alias("mz")), self.k, self.penalty2)
        return self.near_within(write_scratch(_bounded(self.blocks, self.k, self.penalty2, self.tasks), "queries"))

    def near_within(self, queries: DataFrame) -> DataFrame:
        """As ``near``, for blocks of packed points that know a bound."""
        if self.pivots is None:
            return _search(queries, self.blocks, queries.select("g", "z", F.col("z").alias("mz")), self.k, self.penalty2)
        open_ = write_scratch(_open_cells(queries, self.cells, self.pivots, self.penalty2), "open")
        held = self.cells.select("g", "cell", F.explode(F.sequence(
            F.floor(F.col("start") / self.limit).cast("int"),
            F.floor((F.col("start") + F.col("n")) / self.limit).cast("int"))).alias("mz"))
        # a query's own cell is always open, so this search finds again what gave the bound
        pairs = open_.join(held, ["g", "cell"]).select("g", "z", "mz").distinct()
        return _search(queries, self.blocks, pairs, self.k, self.penalty2, self.tasks, (QUERY_BLOCKS, MEMBER_BLOCKS))

    def asked(self, bounds: DataFrame) -> DataFrame:
        """Blocks of packed points for ``near_within``: the vectors of ``bounds``, ``(g, vid, bound)``, that
        a single row has."""
        each = self.blocks.select("g", "z", F.inline("points")).filter(F.size("members") == 1).drop("ask", "members")
        return each.join(bounds, ["g", "vid"]).groupBy("g", "z").agg(
            F.collect_list(F.struct("vid", "x", "c", "cell", "bound")).alias("points"))


def neighbor_lists(df: DataFrame, spec: FeatureSpec, k: int, within: str | None = None, penalty: float = 0.0,
                   query_classes: list | None = None, block_points: int | None = None) -> DataFrame:
    """Exact k nearest other rows of every row, nearest first: ``(__key, __lab, list of (d2, key, lab))``.

    They are looked for among the rows of equal value in the column ``within``.
    ``query_classes`` limits for which rows neighbours are searched, not among which.
    """
    return searched_lists(df, spec, k, within, penalty, query_classes, block_points)(k)


def searched_lists(df: DataFrame, spec: FeatureSpec, widest: int, within: str | None = None, penalty: float = 0.0,
                   query_classes: list | None = None, block_points: int | None = None,
                   often: bool = False) -> Callable[[int], DataFrame]:
    """One search, from which ``neighbor_lists`` of every k up to ``widest`` can be had, ``often`` more than once."""
    if widest < 1:
        raise ValueError("k must be at least 1")
    spec.require(df)
    rows = df.select(*dict.fromkeys([*spec.columns, *([within] if within else [])]))
    if within == spec.label and query_classes is not None:
        rows = rows.filter(F.col(spec.label).isin(query_classes))
    askers = query_classes if within != spec.label else None
    index = PointIndex(rows, spec, widest, within, askers, penalty, block_points)
    near = _nearest_rows(index.near(), widest)
    if often:
        near = write_scratch(near, "near")

    def lists(k: int) -> DataFrame:
        points = index.points.withColumn("members", F.slice("members", 1, k + 1))
        return _expand(rows, points, near if k == widest else _nearest_rows(near, k), spec, k, within, askers)

    return lists


def knn(df: DataFrame, spec: FeatureSpec, k: int, within_class: bool = True,
        penalty: float = 0.0, query_classes: list | None = None,
        block_points: int | None = None) -> DataFrame:
    """Exact k nearest other rows of every row: ``(key, rank, neighbor, neighbor_label, distance)``.

    ``query_classes`` limits for which rows neighbours are searched, not among
    which. A row with fewer than k others gets as many as there are.
    ``block_points`` is the mean number of points in a cell.
    """
    return ranked(neighbor_lists(
        df, spec, k, spec.label if within_class else None, penalty, query_classes, block_points), spec)


def ranked(lists: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row for each row and neighbour of ``neighbor_lists``."""
    return (
        lists.select("__key", F.posexplode("list").alias("__p", "e"))
        .select(
            F.col("__key").alias(spec.key), (F.col("__p") + 1).alias("rank"),
            F.col("e.key").alias("neighbor"), F.col("e.lab").alias("neighbor_label"),
            F.sqrt("e.d2").alias("distance"),
        )
    )


def _nearest_rows(near: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest rows of each point, its own among them."""
    order = Window.partitionBy("g", "vid").orderBy("d2", "key")
    return near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).drop("rn")


def _expand(rows: DataFrame, points: DataFrame, near: DataFrame, spec: FeatureSpec, k: int,
            within: str | None, askers: list | None) -> DataFrame:
    """From the nearest rows of each point to those of each asking row."""
    lists = near.groupBy("g", "vid").agg(
        F.sort_array(F.collect_list(F.struct("d2", "key", "lab"))).alias("list"))
    others = F.slice(F.filter("list", lambda e: e["key"] != F.col("__key")), 1, k)
    known = points.filter("ask").select("g", "vid", F.explode("members").alias("m")).select(
        "g", "vid", F.col("m.key").alias("__key"), F.col("m.lab").alias("__lab"))
    if askers is not None:
        rows, known = (t.filter(F.col(c).isin(askers)) for t, c in ((rows, spec.label), (known, "__lab")))
    group, x, c = _point_columns(spec, within)
    # further copies: their first k fellow copies are their neighbours, at distance 0. One vector
    # may have very many of them, so its rows are spread over slices.
    vector = ["h", "g", "x", "c"]
    hashed = F.xxhash64("g", "x", "c").alias("h")
    rows = rows.select(group.alias("g"), x.alias("x"), c.alias("c"), F.col(spec.key).alias("__key"),
                       F.col(spec.label).alias("__lab")).select(hashed, "*")
    copies = rows.groupBy(*vector).agg(
        F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    full = points.filter(F.size("members") > k).select(hashed, "*").join(copies, vector).select(
        *vector, "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s"),
        F.element_at("members", -1)["key"].alias("__last"),
        F.transform(F.slice("members", 1, k), lambda m: F.struct(
            F.lit(0.0).alias("d2"), m["key"].alias("key"), m["lab"].alias("lab"))).alias("list"))
    sliced = rows.join(full.select(*vector, "slices").distinct(), vector).withColumn(
        "s", F.floor(uniform("__key", "slice") * F.col("slices")).cast("int")).drop("slices")
    further = sliced.join(full.drop("slices"), [*vector, "s"]).filter(F.col("__key") > F.col("__last"))
    return known.join(lists, ["g", "vid"]).select("__key", "__lab", others.alias("list")).unionByName(
        further.select("__key", "__lab", "list"))


def median_sd(df: DataFrame, spec: FeatureSpec, classes: list | None = None) -> float:
    """Median over the continuous columns of their population sd in the given classes."""
    rows = df.filter(F.col(spec.label).isin(classes)) if classes is not None else df
    row = rows.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in spec.continuous]).first()
    return float(np.median([row[c] for c in spec.continuous])) if spec.continuous else 1.0


def tomek_links(df: DataFrame, spec: FeatureSpec, penalty: float = 0.0, **options) -> DataFrame:
    """Pairs of opposite classes that are each other's nearest row: ``(a, b, label_a, label_b)``, a < b."""
    return mutual_links(knn(df, spec, 1, within_class=False, penalty=penalty, **options), spec)


def mutual_links(nearest: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The pairs of opposite classes in a table of nearest rows that name each other."""
    first = nearest.select(
        F.col(spec.key).alias("a"), F.col("neighbor").alias("b"), F.col("neighbor_label").alias("label_b"))
    back = first.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("label_b").alias("label_a"))
    return first.join(back, ["a", "b"]).filter(
        (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
    ).select("a", "b", "label_a", "label_b")



def links_within(df: DataFrame, spec: FeatureSpec, within: str, askers: list, penalty: float = 0.0,
                 block_points: int | None = None) -> DataFrame:
    """Tomek links among the rows of equal value in the column ``within``: ``(a, b, label_a, label_b)``, a < b.

    ``askers`` are all classes but at most one of each group, best its largest: a
    link has an end of another class than that. A row with copies has one of them
    for its nearest, so the copies with the two smallest keys may be a link. Other
    rows of asking classes look for their nearest; a row of the class left out
    looks only when it was named, and no further than the row that named it.
    """
    spec.require(df)
    index = PointIndex(df.select(within, *spec.columns), spec, 1, within, askers, penalty, block_points, lone=True)
    twin = F.col("members")
    pairs = index.points.filter(F.size("members") > 1).select(
        twin[0]["key"].alias("a"), twin[1]["key"].alias("b"),
        twin[0]["lab"].alias("label_a"), twin[1]["lab"].alias("label_b")).filter(
        (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")))

    def nearest(near: DataFrame) -> DataFrame:
        """Own label, nearest row and its distance of each lone row."""
        other = F.col("key") != F.col("vid")
        return near.groupBy("g", "vid").agg(
            F.max(F.when(~other, F.col("lab"))).alias("own"),
            F.min(F.when(other, F.struct("d2", "key", "lab"))).alias("n")).filter(F.col("n").isNotNull()).select(
            "g", "vid", "own", "n.*")

    first = write_scratch(nearest(index.near()).filter(F.col("own") != F.col("lab")), "nearest")
    # room for the rounding of the root
    bounds = first.filter(~F.col("lab").isin(askers)).groupBy("g", F.col("key").alias("vid")).agg(
        (F.sqrt(F.min("d2")) * (1 + SLACK)).alias("bound"))
    second = nearest(index.near_within(write_scratch(index.asked(bounds), "queries")))
    both = first.unionByName(second).select(
        F.col("vid").alias(spec.key), F.col("key").alias("neighbor"), F.col("lab").alias("neighbor_label"))
    return mutual_links(write_scratch(both, "nearest"), spec).unionByName(pairs)
