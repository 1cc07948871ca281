"""Centroid clustering in whole numbers, with distances filtered by a rotation.

Vectors become whole numbers and are rotated to their principal axes, learned
from the products of all vectors. A written table holds each vector, its first
``LEADING`` rotated coordinates and the length of the rest. For a centroid, the
squared distance of the leading coordinates plus the squared difference of the
two remaining lengths is never more than the true squared distance. So each
vector is compared exactly with the centroid of the lowest such bound, and then
only with those whose bound does not exceed the distance found. All distances
that decide are sums of whole numbers; the rotation decides nothing.

A round is one job: tasks add up their vectors by centroid, and ``k`` sums of
each task are all that is shuffled. The driver sees ``k`` centroids and one
matrix of ``width * width`` sums.

Cases: a vector that is null, has another length than ``width``, or a null or
non-finite component takes no part; a component too large for exact squares is
an error (``vectors.LARGEST``); a null ``vec_id`` has no hash and is a first
centroid only when ids run out; rows that repeat a ``vec_id`` are vectors of
their own, and of equal hashes the order is that of the stored bytes; equal
distances go to the smaller centroid; fewer than ``k`` vectors give as many
centroids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import arrow_batch
from evenkeel.llm.vectors import as_binary, as_matrix, finite_rows
from evenkeel.session import ship_package, write_scratch

WIDTH, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
LEADING = 16
#: What rounding may take from a bound, as a share of the two squared lengths.
SLACK = 1e-6
#: Vectors that are compared at once.
BLOCK = 4096


# ---- rotation -----------------------------------------------------------------

class Rotation:
    """Leading principal coordinates about the mean, and the length of what they leave."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    @classmethod
    def of(cls, n: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Rotation:
        mean = sums / max(n, 1)
        axes = np.linalg.eigh(products / max(n, 1) - np.outer(mean, mean))[1]
        return cls(mean, np.ascontiguousarray(axes[:, ::-1][:, :leading]))

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, length of the rest and squared length, about the mean."""
        moved = vectors - self.mean
        lead = moved @ self.axes
        size = np.einsum("ij,ij->i", moved, moved)
        rest = np.sqrt(np.maximum(size - np.einsum("ij,ij->i", lead, lead), 0))
        return lead, rest, size


def _kept(vectors: DataFrame, width: int, scale: int):
    """``vec_id`` and the vector, for batches of the rows that take part."""
    ship_package(vectors.sparkSession)
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.col("embedding").cast("array<double>").alias("embedding"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for whole in batches:
            batch = whole.filter(pc.equal(pc.list_value_length(whole.column("embedding")), width))
            if batch.num_rows:
                rows, _, values = finite_rows(batch.column("embedding"), scale)
                yield batch.column("vec_id").take(pa.array(rows)), values.reshape(-1, width)
    return df, read


def learn_rotation(vectors: DataFrame, width: int, scale: int, leading: int) -> Rotation | None:
    """Principal axes of all vectors that take part; None when there are none."""
    df, read = _kept(vectors, width, scale)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for _, values in read(batches):
            one = np.hstack([values, np.ones((len(values), 1))])
            total += one.T @ one
        if total[width, width]:
            yield arrow_batch({"i": np.arange(width + 1, dtype=np.int32),
                               "v": pa.array(list(total), pa.list_(pa.float64()))})

    sums = df.mapInArrow(work, "i int, v array<double>").groupBy("i").agg(
        *[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width + 1)]).collect()
    if not sums:
        return None
    table = np.array([list(r)[1:] for r in sorted(sums)])
    return Rotation.of(int(table[width, width]), table[width, :width], table[:width, :width], leading)


def rotated(vectors: DataFrame, rotation: Rotation, width: int, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (the whole numbers), ``lead``, ``rest`` and ``size`` of each vector."""
    df, read = _kept(vectors, width, scale)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in read(batches):
            lead, rest, size = rotation.apply(values)
            yield arrow_batch({
                "vec_id": ids, "v": as_binary(values.astype("<i4")), "lead": as_binary(lead.astype("<f4")),
                "rest": rest, "size": size})

    return df.mapInArrow(work, "vec_id long, v binary, lead binary, rest double, size double")


# ---- nearest centroid -----------------------------------------------------------

class Nearest:
    """The nearest centroid by bounds first, then by exact distances of those that survive."""

    def __init__(self, centroids: list[list[int]], rotation: Rotation):
        self.exact = np.array(centroids, np.int64)
        self.lead, self.rest, self.size = rotation.apply(self.exact.astype(np.float64))
        self.compared = 0

    def _distance(self, vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        apart = vectors - self.exact[centroid]
        self.compared += len(vectors)
        return np.einsum("ij,ij->i", apart, apart)

    def find(self, vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray,
             size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector."""
        low = ((lead[:, None, :] - self.lead) ** 2).sum(axis=2) + (rest[:, None] - self.rest) ** 2
        low -= SLACK * (size[:, None] + self.size + 1)
        best = np.argmin(low, axis=1)
        distance = self._distance(vectors, best)
        for j in range(len(self.exact)):
            left = np.flatnonzero((low[:, j] <= distance) & (best != j))
            if len(left):
                other = self._distance(vectors[left], np.full(len(left), j))
                nearer = (other < distance[left]) | ((other == distance[left]) & (j < best[left]))
                best[left[nearer]], distance[left[nearer]] = j, other[nearer]
        return best, distance

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of batches with their vectors, centroids and distances."""
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                vectors = as_matrix(batch.column("v"), "<i4").astype(np.int64)
                best, distance = self.find(
                    vectors, as_matrix(batch.column("lead"), "<f4").astype(np.float64),
                    batch.column("rest").to_numpy(), batch.column("size").to_numpy())
                yield batch, vectors, best, distance


def _sums(table: DataFrame, centroids: list[list[int]], rotation: Rotation) -> dict[int, list[int]]:
    """Count and componentwise sum of the vectors nearest to each centroid."""
    k, width = len(centroids), len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, rotation)
        total = np.zeros((k, width + 1), np.int64)
        for _, vectors, best, _ in nearest.batches(batches):
            for j in range(k):
                mine = best == j
                total[j, 0] += int(mine.sum())
                total[j, 1:] += vectors[mine].sum(axis=0)
        yield arrow_batch({"cluster": np.arange(k, dtype=np.int32),
                           "s": pa.array(list(total), pa.list_(pa.int64()))})

    rows = table.mapInArrow(work, "cluster int, s array<long>").groupBy("cluster").agg(
        *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width + 1)]).collect()
    return {r["cluster"]: list(r)[1:] for r in rows}


def first_centroids(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hash of their id."""
    rows = table.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias(
        "hash")).orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return [np.frombuffer(bytes(r["v"]), "<i4").tolist() for r in rows]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
            width: int = WIDTH, scale: int = SCALE, leading: int = LEADING) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of each vector."""
    spark = vectors.sparkSession
    rotation = learn_rotation(vectors, width, scale, leading)
    if rotation is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long,"
                                         " inertia long, centroid array<long>")
    table = write_scratch(rotated(vectors, rotation, width, scale), "rotated")
    centroids = first_centroids(table, k, seed)
    for _ in range(rounds):
        sums = _sums(table, centroids, rotation)
        moved = [[s // sums[j][0] for s in sums[j][1:]] if sums[j][0] else c for j, c in enumerate(centroids)]
        if moved == centroids:  # every later round would find the same
            break
        centroids = moved

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance in Nearest(centroids, rotation).batches(batches):
            yield arrow_batch({"vec_id": batch.column("vec_id"), "cluster": best.astype(np.int32),
                               "distance": distance})

    placed = write_scratch(table.mapInArrow(work, "vec_id long, cluster int, distance long"), "clusters")
    own = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    # one row for each centroid
    about = spark.createDataFrame(
        [(j, own[j], sum(own.values()), c) for j, c in enumerate(centroids) if j in own],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid) -> F.Column:
    """SHA-256 of the components as decimal numbers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)
