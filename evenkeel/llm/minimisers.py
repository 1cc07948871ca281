"""Runs of windows that share a minimiser, found in whole tables.

A window is ``width`` consecutive units (bytes or words). Its minimiser is the
unit string of length ``seed`` inside it with the lowest hash; consecutive
windows mostly share one, so a text falls into few runs, and equal windows
always have equal minimisers. A run is named by its minimiser, a second hash of
all its units and its number of windows, so equal runs are found without moving
a text. Only the first copy of each run is ever fetched, and only where another
run has the same minimiser.

Spans are half-open unit ranges of a document, which ``id`` and ``h`` name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.text import (
    BYTES,
    CONTENT,
    TOKENS,
    arrow_batch,
    as_signed,
    chunks,
    keyed,
    mix,
    own_id,
    word_hashes,
)
from evenkeel.session import drop_scratch, write_scratch

ROW = ["id", "h"]
OUT_ROWS = 200_000
#: Runs of one minimiser that differ: up to this many go to its bucket, of more every window goes
#: to the window's own key.
BUCKET_RUNS = 8_000
#: Runs of a batch that are looked at together.
LOOK_RUNS = 150_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def window_runs(rolling, sums: np.ndarray, places: np.ndarray, width: int, seed: int):
    """Document, first window, window count and minimiser hash of each run of windows."""
    counts = np.maximum(np.diff(places) - width + 1, 0)
    total = int(counts.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return none, none, none, np.zeros(0, np.uint64)
    grams = rolling.windows(sums, seed)
    # the low half holds the place, so that of equal hashes the leftmost wins
    ordered = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    lowest = (sliding_min(ordered, width - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(total) - np.repeat(ends - counts, counts) + places[doc]
    best = lowest[at]
    new = np.ones(total, bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.append(first, total)), grams[best[first]]


class Units:
    """How a text is cut: ``bytes`` or ``words``."""

    def __init__(self, kind: str):
        self.kind = kind

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Rolling hash, its sums, the sums of a second hash, and each document's place."""
        if self.kind == "bytes":
            return BYTES, BYTES.sums(BYTES.table[data]), CONTENT.sums(CONTENT.table[data]), offsets
        values, places = word_hashes(data, offsets)
        return TOKENS, TOKENS.sums(values), CONTENT.sums(mix(values + np.uint64(7))), places

    def cut(self, body: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        if self.kind == "bytes":
            return [body[a:b] for a, b in spans]
        parts = body.split()
        return [b" ".join(parts[a:b]) for a, b in spans]


def _slices(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = len(next(iter(columns.values())))
    for i in range(0, total, OUT_ROWS):
        yield arrow_batch({k: v[i:i + OUT_ROWS] for k, v in columns.items()})


def place_of(start: np.ndarray, n: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """Start, window count (below ``2 ** bits``) and two marks as one number, as small as it can be."""
    return (start.astype(np.int64) << (bits + 2)) | (n.astype(np.int64) << 2) | marks


def recurring_runs(rows: DataFrame, kind: str, width: int, seed: int) -> DataFrame:
    """Every run whose minimiser is found at two places or more.

    What repeats inside one Arrow batch is known to recur and is dealt out by its
    place; one row without windows stands for it where minimisers are counted.
    ``again`` marks a run that its own document had before. A row travels as five
    whole numbers: start, window count and both marks are one of them (``place_of``),
    and a minimiser that is known to recur is mixed with the row's place, which takes
    it out again.
    """
    bits = width.bit_length()

    def rows_out(found: list) -> Iterator[pa.RecordBatch]:
        ids, hs, start, n, key, name = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(ids):
            return
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        more = ~new | np.concatenate([~new[1:], [False]])
        shared = np.zeros(len(key), bool)
        shared[order] = more
        again = np.zeros(len(key), bool)
        some = np.flatnonzero(shared)
        some = some[np.lexsort((start[some], n[some], name[some], key[some], hs[some], ids[some]))]
        again[some[1:]] = np.logical_and.reduce([c[some[1:]] == c[some[:-1]] for c in (ids, hs, key, name, n)])
        at = place_of(start, n, shared * 2 + again, bits)
        key = as_signed(key)
        yield from _slices({"spread": np.where(shared, key ^ at ^ (ids << 20) ^ hs, key),
                            "name": as_signed(name), "id": ids, "at": at, "h": hs})
        stand = key[order[new & more]]
        zero = np.zeros(len(stand), np.int64)
        yield from _slices({"spread": stand, "name": zero, "id": zero, "at": zero, "h": zero})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(kind)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            hs = batch.column("h").to_numpy()
            found, held = [], 0
            for first, _, data, offsets in chunks(batch):
                rolling, sums, content, places = units.read(data, offsets)
                doc, at, n, key = window_runs(rolling, sums, places, width, seed)
                name = CONTENT.runs(content, at, at + n + width - 1)
                found.append((ids[doc + first], hs[doc + first], at - places[doc], n, key, name))
                held += len(doc)
                if held > LOOK_RUNS:
                    yield from rows_out(found)
                    found, held = [], 0
            if found:
                yield from rows_out(found)

    found = rows.select("id", "h", "body").mapInArrow(work, "spread long, name long, id long, at long, h long")
    at, shared = F.col("at"), F.col("at").bitwiseAND(F.lit(2)) > 0
    n = F.shiftright(at, 2).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    dealt = F.col("spread").bitwiseXOR(at).bitwiseXOR(F.shiftleft("id", 20)).bitwiseXOR(F.col("h"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("spread"))
    return found.withColumn("seen", seen).filter((n > 0) & (shared | (F.col("seen") > 1))).select(
        "id", "h", F.shiftright(at, bits + 2).cast("int").alias("start"), n.alias("n"),
        F.when(shared, dealt).otherwise(F.col("spread")).alias("key"), "name",
        (at.bitwiseAND(F.lit(1)) > 0).alias("again"))


def several_texts(rows: DataFrame) -> bool:
    """Does an id stand for different texts? If none does, the id alone names a row in all run tables."""
    return not rows.groupBy("id").agg((F.min("h") < F.max("h")).alias("several")).filter("several").isEmpty()


class Repeats:
    """Copies of runs and, where runs differ under one minimiser, copies of their windows.

    ``keep_first`` leaves the first place of every window alone (by ``id``, then
    start; rows that share an id but not the text are not ordered among each
    other); otherwise all places of a window that repeats are found.
    """

    def __init__(self, docs: DataFrame, kind: str, width: int, seed: int, keep_first: bool,
                 bucket_units: int, in_bucket: Callable, bucket_runs: int = BUCKET_RUNS,
                 short_names: bool = False):
        # the same columns wherever texts are dealt out, so that they are dealt out once
        rows = keyed(docs).select("id", "h", "body")
        short = short_names and not several_texts(rows)
        self.rows = rows.withColumn("h", F.lit(0).cast("long")) if short else rows
        # a join drops a column that is the same everywhere, so tables dealt out by both would be dealt out again
        self.row = ["id"] if short else ROW
        self.kind, self.width, self.seed = kind, width, seed
        self.keep_first, self.bucket_units = keep_first, bucket_units
        self.in_bucket, self.bucket_runs = in_bucket, bucket_runs

    def spans(self) -> DataFrame:
        """``id``, ``h``, ``a`` and ``b``: the spans of the windows that are found."""
        width = self.width
        runs = write_scratch(recurring_runs(self.rows, self.kind, width, self.seed), "runs")
        # what stands at one place only is no copy, however often its row is repeated
        place = F.xxhash64("id", "h", "start")
        kinds = write_scratch(runs.withColumn("place", place).groupBy("key", "name", "n").agg(
            F.min("id").alias("low"), F.min("place").alias("p"), F.max("place").alias("q")).select(
            "key", "name", "n", "low", "p", (F.col("p") < F.col("q")).alias("copied")), "kinds")
        several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        marks = kinds.join(several, "key", "left").filter("copied or kinds > 1").withColumn(
            "kinds", F.coalesce("kinds", F.lit(1)))
        # one place stands for all copies of a run: the first, which may be several rows of one id
        first = (F.col("id") == F.col("low")) & ~F.col("again") if self.keep_first else place == F.col("p")
        known = write_scratch(runs.join(marks, ["key", "name", "n"]).select(
            "id", "h", "start", "n", "key", "copied", "kinds", first.alias("first")), "known")
        drop_scratch(runs)
        drop_scratch(kinds)
        copies = known.filter(F.col("copied") & ~F.col("first") if self.keep_first else F.col("copied"))
        found = copies.select("id", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") + (width - 1)).alias("b"))
        asked = known.filter("first and kinds > 1").select(
            "id", "h", "start", "n", "key", "copied", (F.col("kinds") > self.bucket_runs).alias("hot"))
        units = asked.agg(F.sum(F.when(~F.col("hot"), F.col("n") + width - 1))).first()[0] or 0
        buckets = max(1, -(-units // self.bucket_units))
        cold = self._strings(asked.filter(~F.col("hot")), buckets)
        found = found.unionByName(cold.groupBy("bucket").applyInArrow(
            self.in_bucket, "id long, h long, a int, b int"))
        if asked.filter("hot").limit(1).count():
            found = found.unionByName(self._by_window(asked.filter("hot")))
        return found

    def _asked(self, asked: DataFrame) -> DataFrame:
        wanted = asked.groupBy(*self.row).agg(F.collect_set(F.struct("start", "n", "key", "copied")).alias("runs"))
        return self.rows.join(wanted, self.row).dropDuplicates(self.row)

    def _strings(self, asked: DataFrame, buckets: int) -> DataFrame:
        """Each run as one packed string, with the bucket of its minimiser."""
        kind, width = self.kind, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = Units(kind)
            for whole in batches:
                for i in range(0, whole.num_rows, 256):
                    out = {k: [] for k in ("bucket", "id", "h", "start", "copied", "body")}
                    for row in whole.slice(i, 256).to_pylist():
                        spans = [(r["start"], r["start"] + r["n"] + width - 1) for r in row["runs"]]
                        out["body"] += units.cut(row["body"], spans)
                        out["id"] += [row["id"]] * len(spans)
                        out["h"] += [row["h"]] * len(spans)
                        out["start"] += [r["start"] for r in row["runs"]]
                        out["copied"] += [r["copied"] for r in row["runs"]]
                        out["bucket"] += [(r["key"] >> 7) % buckets for r in row["runs"]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out["bucket"], pa.int64()), pa.array(out["id"], pa.int64()),
                         pa.array(out["h"], pa.int64()), pa.array(out["start"], pa.int32()),
                         pa.array(out["copied"], pa.bool_()), pa.array(out["body"], pa.binary())],
                        names=list(out))

        return self._asked(asked).mapInArrow(
            work, "bucket long, id long, h long, start int, copied boolean, body binary")

    def _by_window(self, asked: DataFrame) -> DataFrame:
        """Windows of crowded minimisers, each under two hashes of its own."""
        kind, width = self.kind, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = Units(kind)
            for whole in batches:
                for row in whole.to_pylist():
                    data = np.frombuffer(row["body"], np.uint8)
                    rolling, sums, content, _ = units.read(data, np.array([0, len(data)]))
                    at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in row["runs"]])
                    copied = np.concatenate([np.full(r["n"], r["copied"]) for r in row["runs"]])
                    x = as_signed(rolling.runs(sums, at, at + width))
                    y = as_signed(CONTENT.runs(content, at, at + width))
                    order = np.lexsort((at, y, x))
                    again = np.zeros(len(at), bool)
                    again[order[1:]] = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
                    yield from _slices({
                        "x": x, "y": y, "id": np.full(len(at), row["id"], np.int64),
                        "h": np.full(len(at), row["h"], np.int64), "start": at.astype(np.int32),
                        "copied": copied, "again": again})

        windows = write_scratch(self._asked(asked).mapInArrow(
            work, "x long, y long, id long, h long, start int, copied boolean, again boolean"), "windows")
        place = F.xxhash64("id", "h", "start")
        known = windows.withColumn("place", place).groupBy("x", "y").agg(
            F.min("id").alias("low"), F.min("place").alias("p"), F.max("place").alias("q"),
            F.max("copied").alias("any")).filter((F.col("p") < F.col("q")) | F.col("any"))
        both = windows.join(known, ["x", "y"])
        if self.keep_first:
            both = both.filter((F.col("id") != F.col("low")) | F.col("again"))
        return both.select("id", "h", F.col("start").alias("a"), (F.col("start") + width).alias("b"))

    def marked(self) -> DataFrame:
        """Every row with its bytes and the spans found in it (null: none)."""
        spans = self.spans().groupBy(*self.row).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
        return self.rows.join(spans, self.row, "left").select(own_id().alias("doc_id"), "body", "spans")


def covered(size: int, spans: list[dict] | None) -> np.ndarray:
    """Which of ``size`` units the spans cover."""
    if not spans:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def span_table(ids: np.ndarray, hs: np.ndarray, starts: np.ndarray, width: int) -> pa.Table:
    """Spans of single windows, joined where they follow each other in one run."""
    if not len(ids):
        return pa.table({"id": pa.array([], pa.int64()), "h": pa.array([], pa.int64()),
                         "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32())})
    order = np.lexsort((starts, hs, ids))
    ids, hs, starts = ids[order], hs[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1]) | (starts[1:] > starts[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return pa.table({"id": ids[first], "h": hs[first], "a": starts[first].astype(np.int32),
                     "b": (starts[last] + width).astype(np.int32)})
