"""Hard negatives of anchor vectors by the threshold algorithm on sorted lists.

Rows are dealt out to blocks. In a block each dimension has a list of the rows
sorted by that component. For an anchor the lists are read from the end that its
sign asks for, all dimensions to the same depth; every row met is scored by its
inner product with the anchor. The inner product of the anchor with the values
reached is a threshold that no row unseen exceeds. Reading stops when the
threshold falls strictly below the kth best score, since an equal score could
still win by a smaller id, or below all a window allows.

The first search, in the lists of the anchor's label, finds its best rows; each
score found is the upper end of a window. The second search, in the lists of all
other labels, finds the best rows of each window. A block gives at most ``k``
rows for each anchor or window, which a window function over the anchor merges.

Equal vectors of one label are one entry with its first ids, and anchors with
equal vectors and labels are asked once, so a vector that fills a third of the
table is one entry and one question. Blocks and chunks of anchors meet pair by
pair; both have a bounded number of rows, and each is copied once for each
partner, never once for each row.

Cases: a null ``vec_id``, label or vector, or a null or non-finite component,
takes no part; a component too large for exact scores is an error
(``vectors.LARGEST``); a shorter vector counts as filled up with zeros; rows
that repeat id, label and vector count once; equal scores are ordered by id; a
vector of zeros has score 0 with all rows; an anchor without a positive or a
window without a row gives none; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.text import arrow_batch
from evenkeel.llm.vectors import finite_rows
from evenkeel.session import ship_package, write_scratch

SCALE, POSITIVES, NEGATIVES, PERCENT = 256, 5, 5, 80
#: Entries planned for a block and anchors for a chunk; small tables get smaller blocks, for all cores.
BLOCK_ROWS, CHUNK_ROWS, LEAST_ROWS = 16_384, 16_384, 1_024
#: Depth of the first step into the lists; each later one goes as deep again.
STEP = 16


# ---- the threshold algorithm on one block -------------------------------------------

class SortedLists:
    """A list of rows for each dimension, sorted by that component."""

    def __init__(self, vectors: np.ndarray, lists: np.ndarray | None = None, rows: np.ndarray | None = None):
        """``vectors`` are the whole block; ``rows`` are those the lists hold (all by default)."""
        self.vectors = vectors
        self.rows = np.arange(len(vectors)) if rows is None else rows
        up = np.argsort(vectors, axis=0, kind="stable").T if lists is None else lists
        self.lists = np.stack([up, up[:, ::-1]])
        self.largest = int(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)
        self.scored = 0

    def subset(self, keep: np.ndarray) -> SortedLists:
        """Lists of the rows that ``keep`` marks."""
        up = self.lists[0]
        found = object.__new__(SortedLists)
        found.vectors, found.floats, found.largest, found.scored = self.vectors, self.floats, self.largest, 0
        found.rows = np.flatnonzero(keep)
        up = up[keep[up]].reshape(up.shape[0], -1)
        found.lists = np.stack([up, up[:, ::-1]])
        return found

    def score(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; floating point is exact below 2 ** 53."""
        self.scored += len(rows)
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < 2**53:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows not seen before, their scores, and the threshold; it is None when all rows are seen."""
        dims = np.flatnonzero(anchor)
        length = self.lists.shape[2]
        if not len(dims) or not length:
            yield self.rows, np.zeros(len(self.rows), np.int64), None
            return
        end = (anchor[dims] > 0).astype(np.int64)
        seen = np.zeros(len(self.vectors), bool)
        met, start, step = 0, 0, STEP
        while start < length:
            stop = min(length, start + step)
            rows = self.lists[end, dims, start:stop]
            new = np.zeros(len(seen), bool)
            new[rows.ravel()] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            met += len(fresh)
            done = met == length
            threshold = None if done else sum(
                int(x) for x in self.vectors[rows[:, -1], dims] * anchor[dims])
            yield fresh, self.score(fresh, anchor), threshold
            if done:
                return
            start, step = stop, 2 * step


def _kth(scores: np.ndarray, k: int) -> int | None:
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else None


def best_rows(lists: SortedLists, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose score reaches the ``k`` th best, and their scores."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for fresh, found, threshold in lists.read(anchor):
        rows, scores = np.append(rows, fresh), np.append(scores, found)
        kth = _kth(scores, k)
        if kth is not None:
            keep = scores >= kth
            rows, scores = rows[keep], scores[keep]
            if threshold is not None and threshold < kth:
                break
    return rows, scores


def best_in_windows(lists: SortedLists, anchor: np.ndarray, tops: list[int], k: int,
                    percent: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each upper end, rows between ``percent`` of it and it whose score reaches the ``k`` th best."""
    none = np.zeros(0, np.int64)
    found = {t: (none, none) for t in tops if t >= 0}  # below 0 the lower end lies above the upper one
    open_ = set(found)
    for fresh, scores, threshold in lists.read(anchor) if open_ else ():
        for top in list(open_):
            rows, held = found[top]
            inside = (scores <= top) & (100 * scores >= percent * top)
            rows, held = np.append(rows, fresh[inside]), np.append(held, scores[inside])
            kth = _kth(held, k)
            if kth is not None:
                keep = held >= kth
                rows, held = rows[keep], held[keep]
            found[top] = rows, held
            if threshold is not None and (100 * threshold < percent * top or (kth is not None and threshold < kth)):
                open_.discard(top)
        if not open_:
            break
    return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        one = np.frombuffer(raw, "<i4")
        out[i, :len(one)] = one
    return out


class _Block:
    """Entries of a block and the anchors of a chunk, with lists made by label when asked for."""

    def __init__(self, left: pa.Table, right: pa.Table):
        width = max((len(x) // 4 for c in (left, right) for x in c.column("v").to_pylist()), default=0)
        self.entries, self.anchors = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        codes: dict = {}
        self.labels = np.array([codes.setdefault(x, len(codes)) for x in left.column("label").to_pylist()], np.int64)
        self.asked = [codes.setdefault(x, len(codes)) for x in right.column("label").to_pylist()]
        self.ids = [np.array(x, np.int64) for x in left.column("ids").to_pylist()]
        self.all = SortedLists(self.entries)

    def by_label(self, same: bool) -> Iterator[tuple[int, SortedLists]]:
        """Each anchor's number with the lists of its own label, or of all others."""
        order = sorted(range(len(self.asked)), key=self.asked.__getitem__)
        last, lists = None, self.all
        for i in order:
            if self.asked[i] != last:
                last = self.asked[i]
                lists = self.all.subset((self.labels == last) == same)
            yield i, lists

    def first_ids(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` ids of entries by score, then id."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.concatenate([self.ids[r] for r in rows])
        score = np.repeat(scores, [len(self.ids[r]) for r in rows])
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def _gathered(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Rows of a question and its window, one for each id."""
    sizes = [len(ids) for *_, ids, _ in rows]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({
        "point": pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
        "top": pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), sizes)),
        "score": pa.array(cat([r[3] for r in rows])), "vec_id": pa.array(cat([r[2] for r in rows]))})


_FOUND = "point long, top long, score long, vec_id long"


def _search(entries: DataFrame, points: DataFrame, blocks: int, chunks: int, work) -> DataFrame:
    """Run ``work`` on every block of entries with every chunk of points."""
    left = entries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = points.withColumn("chunk", F.pmod("point", F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(work, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by score, then id, as one sorted array."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("found"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   percent: int = PERCENT, scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; ``is_anchor`` is a condition on them.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema["label"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, values = finite_rows(batch.column("embedding"), scale)
            raw, ends = values.astype("<i4").tobytes(), 4 * np.cumsum(sizes)
            at = pa.array(rows)
            yield arrow_batch({
                **{c: batch.column(c).take(at) for c in ("vec_id", "label", "anchor")},
                "v": pa.array([raw[b - 4 * n:b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)],
                              pa.binary())})

    known = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = write_scratch(known.mapInArrow(
        work, f"vec_id long, label {kind}, anchor boolean, v binary").dropDuplicates(
        ["vec_id", "label", "v"]), "vectors")
    # only the first ids of an entry can be among the first ids of an anchor; Spark cuts before the shuffle
    k = max(positives + 1, negatives)
    rank = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    entries = rows.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("label", "v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = write_scratch(entries, "entries")
    points = write_scratch(rows.filter("anchor").select("label", "v").distinct().withColumn(
        "point", F.monotonically_increasing_id()), "points")
    n, asked = entries.count(), points.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * cores, n // LEAST_ROWS))
    chunks = max(1, -(-asked // CHUNK_ROWS))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("label", "v"), F.lit(blocks)).cast("int"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = _Block(left, right), []
        numbers = right.column("point").to_pylist()
        for i, lists in block.by_label(True):
            ids, scores = block.first_ids(*best_rows(lists, block.anchors[i], positives + 1), positives + 1)
            out.append((numbers[i], 0, ids, scores))
        return _gathered(out)

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = _Block(left, right), []
        numbers, tops = right.column("point").to_pylist(), right.column("tops").to_pylist()
        for i, lists in block.by_label(False):
            found = best_in_windows(lists, block.anchors[i], tops[i], negatives, percent)
            out += [(numbers[i], top, *block.first_ids(*got, negatives)) for top, got in found.items()]
        return _gathered(out)

    own = write_scratch(points.join(_first(
        _search(entries, points, blocks, chunks, near), ["point"], positives + 1), "point"), "positives")
    tops = own.select("point", "label", "v", F.array_distinct(F.transform("found", lambda x: x["score"])).alias("tops"))
    others = _first(_search(entries, tops, blocks, chunks, below), ["point", "top"], negatives)
    windows = others.groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct("top", "found"))).alias("windows"))
    answers = own.join(windows, "point").select("label", "v", "found", "windows")
    each = rows.filter("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v").join(answers, ["label", "v"])
    # equal anchors share their answer but for themselves
    each = each.withColumn("positive", F.explode(F.slice(
        F.filter("found", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)))
    each = each.withColumn("negative", F.explode(F.col("windows")[F.col("positive.score")]))
    return each.select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("negative.rank").cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"))
