"""Centroid clustering and hard negatives against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from evenkeel.llm import centroids, negatives
from evenkeel.llm.vectors import LARGEST
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, point string, h long"


def _table(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, e, y, "x", "y", "z", 1) for i, e, y in rows], SCHEMA).repartition(3)


def _rows(width=8, n=260, seed=2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        y = rng.randrange(4)
        rows.append((i, [m + rng.gauss(0, 0.4) for m in middles[y if rng.random() < 0.8 else rng.randrange(4)]], y))
    hot = rows[0][1]
    rows += [(1000 + i, hot, rows[0][2]) for i in range(150)]  # one vector in a third of the rows, anchors too
    rows += [(2000 + i, hot, (rows[0][2] + 1) % 4) for i in range(20)]  # ties across labels
    rows += [(3000, None, 1), (3001, [1.0] * (width - 1) + [None], 1), (3002, [math.nan] + [1.0] * (width - 1), 1),
             (3003, [math.inf] + [1.0] * (width - 1), 1), (3004, [1.0] * width, None), (3010, [0.0] * width, 2),
             (3020, [-1.0] * width, 3), (None, [0.5] * width, 1)]
    return rows


def _floors(e, scale):
    return [math.floor(scale * x) for x in e]


def _finite(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def _plain_clusters(rows, k, rounds, seed, width, scale):
    kept = [(i, _floors(e, scale)) for i, e, _ in rows if _finite(e) and len(e) == width]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middles = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(middles))
    for _ in range(rounds):
        held = [[] for _ in middles]
        for _, v in kept:
            held[near(v)[1]].append(v)
        middles = [[sum(x) // len(h) for x in zip(*h)] if h else m for h, m in zip(held, middles)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return found, middles


@pytest.mark.parametrize("k,rounds,leading", [(5, 4, 3), (3, 12, 8), (2000, 1, 1)])
def test_clusters_equal_plain_rounds(spark, k, rounds, leading):
    rows = _rows() + [(7, _rows()[7][1], 0), (7, _rows()[8][1], 0)]  # repeated rows and ids
    found, middles = _plain_clusters(rows, k, rounds, 3, 8, 64)
    got = centroids.cluster(_table(spark, rows), k, rounds, 3, 8, 64, leading).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(found, key=key)
    total = sum(d for *_, d in found)
    for r in got:
        assert r.centroid == middles[r.cluster] and r.inertia == total
        assert r.cluster_inertia == sum(d for _, c, d in found if c == r.cluster)


def test_bounds_never_exceed_distances_and_save_comparisons():
    rng = np.random.default_rng(4)
    middles = rng.integers(-3000, 3000, (12, 32))
    vectors = middles[rng.integers(0, 12, 3000)] + rng.integers(-150, 150, (3000, 32))
    one = np.hstack([vectors, np.ones((3000, 1))])
    table = one.T @ one
    rotation = centroids.Rotation.of(3000, table[32, :32], table[:32, :32], 6)
    lead, rest, size = rotation.apply(vectors.astype(float))
    nearest = centroids.Nearest(middles.tolist(), rotation)
    low = ((lead[:, None] - nearest.lead) ** 2).sum(axis=2) + (rest[:, None] - nearest.rest) ** 2
    true = ((vectors[:, None] - middles) ** 2).sum(axis=2)
    assert (low - centroids.SLACK * (size[:, None] + nearest.size + 1) <= true).all()
    best, distance = nearest.find(vectors, lead.astype("<f4").astype(float), rest, size)
    assert (best == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert nearest.compared < 1.5 * len(vectors)  # of 12 times


def _plain_negatives(rows, is_anchor, positives, negatives_, percent, scale):
    kept = sorted({(i, y, tuple(_floors(e, scale))) for i, e, y in rows
                   if _finite(e) and y is not None and i is not None})
    out = []
    for a, y, q in kept:
        if not is_anchor(a):
            continue
        score = lambda v: sum(x * z for x, z in zip(q, v))
        near = sorted((-score(v), i) for i, z, v in kept if z == y and i != a)[:positives]
        far = sorted((-score(v), i) for i, z, v in kept if z != y)
        for s, i in near:
            p = -s
            inside = [(-n, j) for n, j in far if percent * p <= 100 * -n <= 100 * p][:negatives_]
            out += [(a, i, r + 1, j, p, n) for r, (n, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [4, 10_000])
def test_negatives_equal_plain_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", blocks * 10)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", blocks)
    rows = _rows()
    rows += [rows[10], rows[10], rows[20]]  # repeated rows
    rows += [(30, [0.3] * 5, 1), (4000, [2.0] * 5, 1)]  # an id with two vectors; shorter vectors
    want = _plain_negatives(rows, lambda i: i % 10 == 0, 4, 3, 80, 64)
    got = negatives.hard_negatives(_table(spark, rows), F.col("vec_id") % 10 == 0, 4, 3, 80, 64).collect()
    assert sorted(tuple(r) for r in got) == want
    assert len(want) > 200 and any(a >= 1000 for a, *_ in want)


def test_reading_stops_at_the_threshold():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-50, 50, (4000, 6))
    vectors[:40] *= 4
    lists = negatives.SortedLists(vectors)
    for i in range(40):
        lists.scored = 0
        rows, scores = negatives.best_rows(lists, vectors[i], 5)
        true = np.sort(vectors @ vectors[i])[::-1]
        assert sorted(scores.tolist(), reverse=True)[:5] == true[:5].tolist()
        assert lists.scored < len(vectors) / 2
    part = lists.subset(np.arange(4000) % 3 == 0)
    rows, _ = negatives.best_rows(part, vectors[1], 5)
    assert (rows % 3 == 0).all()
    top = int(vectors[0] @ vectors[0])
    found = negatives.best_in_windows(lists, vectors[0], [top, top // 2, 0, -5], 3, 80)
    score = vectors @ vectors[0]
    for t in (top, top // 2, 0):
        inside = np.sort(score[(score <= t) & (100 * score >= 80 * t)])[::-1][:3]
        assert sorted(found[t][1].tolist(), reverse=True)[:3] == inside.tolist()
    assert -5 not in found


def test_scores_beyond_floating_point_are_exact():
    big = np.array([[2**27, 1], [2**27, 2], [2**27 - 1, 3]], np.int64)
    lists = negatives.SortedLists(big)
    _, scores = negatives.best_rows(lists, np.array([2**27, 3], np.int64), 1)
    assert scores.tolist() == [2**54 + 6]


def test_empty_tables_and_large_components(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 8, 1)]):
        df = _table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        assert centroids.cluster(df, width=8).count() == 0
        assert negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    large = _table(spark, [(1, [float(LARGEST)] * 8, 1)])
    with pytest.raises(Exception, match="larger than"):
        centroids.cluster(large, width=8).count()
    with pytest.raises(Exception, match="larger than"):
        negatives.hard_negatives(large, F.lit(True)).count()
