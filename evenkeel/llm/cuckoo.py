"""Exact dedup with a cuckoo-filter index of live text digests.

The index is cut into buckets by digest. Each bucket has a cuckoo filter (16-bit
fingerprints, four to a cell, two cells for each digest) that can take digests
in and out. A filter that overflows is built again twice as large from the
bucket's stored digests. A hit in a filter is only a guess; it counts after the
stored rows of the bucket show the same SHA-256 digest. Copies are added up
before anything is shuffled by digest, so a text that fills a third of the
table is one entry of one bucket.

The index is three written tables below the shared folder: stored rows, live
digests and filters; each change writes new ones, so a lost executor costs
nothing and an old version stays readable.

Cases: a null text equals the empty text; of equal texts the largest ``doc_id``
stays, a null id only when all are null; rows that repeat ``doc_id`` and text
stand for one document and are marked alike, though each counts in
``group_size``; a long text is one digest; an empty table gives an empty index.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.text import whole_row
from evenkeel.session import ship_package, write_scratch

CELL = 4
KICKS = 200
#: Digests a bucket is planned for; more make its filter grow, not fail.
BUCKET_DIGESTS = 20_000
FILTERS = "bucket int, cells int, held long, slots binary"


class CuckooFilter:
    """Fingerprints of digests in two possible cells each."""

    def __init__(self, cells: int, slots: bytes | None = None, held: int = 0):
        self.cells, self.held = cells, held
        self.slots = (np.zeros(cells * CELL, np.uint16) if slots is None
                      else np.frombuffer(slots, np.uint16).copy()).tolist()

    @classmethod
    def sized(cls, digests: int) -> CuckooFilter:
        return cls(1 << max(0, math.ceil(math.log2(max(digests, 1) / (CELL * 0.85)))))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        a = int.from_bytes(digest[:8], "little") % self.cells
        return mark, a, self._other(a, mark)

    def _other(self, cell: int, mark: int) -> int:
        return cell ^ (mark * 0x5BD1E995 >> 3) % self.cells

    def _put(self, cell: int, mark: int) -> bool:
        for i in range(cell * CELL, cell * CELL + CELL):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter is full; it is then of no more use and must be built anew."""
        mark, a, b = self._places(digest)
        if self._put(a, mark) or self._put(b, mark):
            self.held += 1
            return True
        cell = b
        for kick in range(KICKS):
            i = cell * CELL + kick % CELL
            mark, self.slots[i] = self.slots[i], mark
            cell = self._other(cell, mark)
            if self._put(cell, mark):
                self.held += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for cell in (a, b):
            for i in range(cell * CELL, cell * CELL + CELL):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    self.held -= 1
                    return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return (mark in self.slots[a * CELL:a * CELL + CELL]
                or mark in self.slots[b * CELL:b * CELL + CELL])

    def to_bytes(self) -> bytes:
        return np.array(self.slots, np.uint16).tobytes()


def built(digests: list[bytes], cells: int = 1) -> CuckooFilter:
    """A filter that holds all digests, doubled until they fit."""
    found = CuckooFilter.sized(len(digests))
    found = found if found.cells >= cells else CuckooFilter(cells)
    while not all(found.insert(d) for d in digests):
        found = CuckooFilter(found.cells * 2)
    return found


def changed(found: CuckooFilter | None, came: list[bytes], went: list[bytes], live: list[bytes]) -> CuckooFilter:
    """Take digests out and in; ``live`` are all digests the bucket holds afterwards."""
    if found is None:
        return built(live)
    for d in went:
        found.delete(d)
    if all(found.insert(d) for d in came):
        return found
    return built(live, found.cells * 2)


def _digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class CuckooIndex:
    """Live texts by digest: ``insert``, ``delete`` and ``lookup`` take documents."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        ship_package(spark)
        self.spark, self.buckets = spark, buckets
        self.rows = self.live = self.filters = None

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))

    def _replace(self, rows: DataFrame) -> None:
        """Store the rows and bring live digests and filters in line with them."""
        before, filters = self.live, self.filters
        self.rows = write_scratch(rows, "cuckoo-rows")
        if self.buckets is None:
            self.buckets = max(1, -(-self.rows.count() // BUCKET_DIGESTS))
        live = self._bucketed(self.rows.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        self.live = write_scratch(live, "cuckoo-live")
        now = self.live.select("bucket", F.unhex("digest").alias("digest"), F.lit(1).alias("now"))
        if before is None:
            both = now.withColumn("was", F.lit(0))
            filters = self.spark.createDataFrame([], FILTERS)
        else:
            was = before.select("bucket", F.unhex("digest").alias("digest"), F.lit(1).alias("was"))
            both = now.join(was, ["bucket", "digest"], "full").fillna(0, ["now", "was"])

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            digests, now_, was_ = (right.column(c).to_pylist() for c in ("digest", "now", "was"))
            old = left.to_pylist()
            found = CuckooFilter(old[0]["cells"], old[0]["slots"], old[0]["held"]) if old else None
            came = [d for d, n, w in zip(digests, now_, was_, strict=True) if n and not w]
            went = [d for d, n, w in zip(digests, now_, was_, strict=True) if w and not n]
            found = changed(found, came, went, [d for d, n in zip(digests, now_, strict=True) if n])
            bucket = (right if right.num_rows else left).column("bucket")[0].as_py()
            return pa.table({
                "bucket": pa.array([bucket], pa.int32()), "cells": pa.array([found.cells], pa.int32()),
                "held": pa.array([found.held], pa.int64()),
                "slots": pa.array([found.to_bytes()], pa.binary())})

        self.filters = write_scratch(filters.groupBy("bucket").cogroup(
            both.select("bucket", "digest", "now", "was").groupBy("bucket")).applyInArrow(
            update, FILTERS), "cuckoo-filters")

    def insert(self, docs: DataFrame) -> None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"))
        self._replace(rows if self.rows is None else self.rows.unionByName(rows))

    def delete(self, docs: DataFrame) -> None:
        """Take out every stored row with the ``doc_id`` and text of one of ``docs``."""
        gone = docs.select(F.col("doc_id").cast("long").alias("g"), _digest(F.col("text")).alias("d")).distinct()
        self._replace(self.rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g")) & (
            F.col("digest") == F.col("d")), "left_anti"))

    def lookup(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``digest``, and ``keep_id`` and ``group_size`` where the text is live."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"))
        asked = self._bucketed(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("__n"))).select(
            "bucket", F.unhex("digest").alias("digest"))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            old = left.to_pylist()
            found = CuckooFilter(old[0]["cells"], old[0]["slots"], old[0]["held"]) if old else ()
            hits = [d for d in right.column("digest").to_pylist() if d in found]
            return pa.table({"digest": pa.array(hits, pa.binary())})

        hits = self.filters.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
            probe, "digest binary").select(F.lower(F.hex("digest")).alias("digest"))
        known = hits.join(self.live.drop("bucket"), "digest")
        return rows.join(known, "digest", "left")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row with the row that stays of its equal texts."""
    index = CuckooIndex(docs.sparkSession)
    index.insert(docs)
    return index.lookup(docs).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def unique_texts(docs: DataFrame) -> DataFrame:
    """One row of each text, the one that stays, with all its columns; of equal such rows one."""
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").cast("long").alias("i"), F.col("text_sha256").alias("d")).distinct()
    df = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), _digest(F.col("text")).alias("digest"))
    return df.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).dropDuplicates(
        ["digest"]).select("row.*")
