"""Substring dedup on words: super-k-mers travel to buckets, where sorting counts windows.

Consecutive windows of ``WIDTH`` words that share a minimiser are one
super-k-mer. Copies of a super-k-mer are known by name; different ones under one
minimiser travel as packed strings to the minimiser's bucket, where the words
are numbered and windows ranked by sorting, doubling the compared length, so
that counts are exact. Every word covered by a window that is found twice or
more is removed, at all its places.

Cases: null and empty texts have no words; a text shorter than a window keeps
all its words; rows that repeat ``doc_id`` and text are one document and do not
count as copies of each other; a long text is cut into runs like any other; an
empty table gives an empty result. Crowded minimisers: see ``Repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evenkeel.llm.minimisers import BUCKET_RUNS, Repeats, covered, span_table

WIDTH = 35
SEED = 12
#: Words of packed strings planned for one bucket.
BUCKET_WORDS = 150_000


def window_ranks(words: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal windows of ``width`` words, by sorting pairs of shorter ranks."""
    rank, done = words.astype(np.int64), 1
    while done < width and len(rank):
        step = min(done, width - done)
        first, second = rank[:len(rank) - step], rank[step:]
        rank = np.unique(first * (int(rank.max()) + 1) + second, return_inverse=True)[1]
        done += step
    return rank


def count_windows(width: int):
    def work(table: pa.Table) -> pa.Table:
        bodies = [b.split() for b in table.column("body").to_pylist()]
        sizes = np.array([len(b) for b in bodies])
        numbers: dict[bytes, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for b in bodies for w in b], np.int64)
        ranks = window_ranks(words, width)
        counts = sizes - width + 1
        run = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rank = ranks[np.repeat(np.cumsum(sizes) - sizes, counts) + within]
        copied = table.column("copied").to_numpy()
        weight = np.bincount(rank, weights=np.where(copied[run], 2, 1))
        hit = (weight[rank] > 1) & ~copied[run]
        run, within = run[hit], within[hit]
        return span_table(table.column("id").to_numpy()[run], table.column("h").to_numpy()[run],
                          table.column("start").to_numpy()[run] + within, width)
    return work


def drop_repeated_passages(docs: DataFrame, width: int = WIDTH, seed: int = SEED,
                           bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``text``, the kept words joined by one space."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                counts, removed, texts = [], [], []
                for body, spans in zip(batch.column("body").to_pylist(),
                                       batch.column("spans").to_pylist(), strict=True):
                    words = body.split()
                    gone = covered(len(words), spans)
                    counts.append(len(words))
                    removed.append(int(gone.sum()))
                    texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                                           if removed[-1] else words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"])

    found = Repeats(docs, "words", width, seed, False, BUCKET_WORDS, count_windows(width), bucket_runs)
    return found.marked().mapInArrow(work, "doc_id long, n_words long, n_removed long, text string")
