"""Suffix-array dedup of byte strings by threshold-bounded interval expansion.

Different runs under one minimiser meet in a bucket. Their suffixes are sorted,
and the common prefix lengths of neighbours are derived from the Burrows-Wheeler
transform alone: an interval of suffixes that start alike is extended backward
by every character that stands before it, breadth first. An interval that first
appears in round L shows that its upper border has a common prefix of L. Rounds
run by increasing value and stop at the minimum length; borders without a value
then join suffixes that share at least that many bytes. Each byte covered by
such a string goes, unless the string starts there for the first time.

Cases: a null text is empty; a text shorter than the minimum keeps all its
bytes; rows that repeat a ``doc_id`` are never earlier than each other; rows
without a ``doc_id`` come last, ordered by a hash of their text; overlapping
copies inside one document count; a long text is cut into runs like any other;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evenkeel.llm.minimisers import BUCKET_RUNS, Repeats, covered, span_table

LENGTH = 100
SEED = 40
#: Bytes of runs planned for one bucket.
BUCKET_BYTES = 1 << 18
#: Symbols that fit one 63-bit sort key.
PACKED = 7


def sorted_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of strings that each end in a 0, told apart by place.

    ``text`` holds symbols from 0 to 256, ``ends`` the place of the 0 that ends
    each position's string. Sorting doubles the compared length each time.
    """
    n = len(text)
    at = np.arange(n)
    rank = np.zeros(n, np.int64)
    for i in range(PACKED):
        here = at + i
        rank = rank * 512 + np.where(here <= ends, text[np.minimum(here, n - 1)], 0)
    done = PACKED
    longest = int((ends - at).max()) + 1
    rank = np.unique(rank, return_inverse=True)[1]
    while done < longest:
        later = np.where(at + done <= ends, rank[np.minimum(at + done, n - 1)] + 1, 0)
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1]
        done *= 2
    return np.argsort(rank, kind="stable")


def long_common_prefixes(text: np.ndarray, suffixes: np.ndarray, minimum: int) -> np.ndarray:
    """For each suffix but the first: does it share ``minimum`` symbols with the one before it?"""
    n = len(text)
    place = np.empty(n, np.int64)
    place[suffixes] = np.arange(n)
    before = np.where(suffixes > 0, text[suffixes - 1], 0)
    back = place[suffixes - 1]
    heads = text[suffixes]
    ends = int((text == 0).sum())
    known = np.zeros(n + 1, bool)
    known[:ends + 1] = True
    known[n] = True
    # round 0: every end by itself, and one interval for each first symbol
    first = np.flatnonzero(np.diff(heads) != 0) + 1
    borders = np.append(first, n)
    known[first] = True
    low = np.concatenate([np.arange(ends), first])
    high = np.concatenate([np.arange(1, ends + 1), np.append(borders[1:], n)])[:len(low)]
    keep = high < n
    low, high = low[keep], high[keep]
    for _ in range(1, minimum):
        if not len(low):
            break
        sizes = high - low
        origin = np.repeat(np.arange(len(low)), sizes)
        row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[origin]
        inner = before[row] > 0
        reach, origin = back[row[inner]], origin[inner]
        if not len(reach):
            break
        order = np.argsort(reach)
        reach, origin = reach[order], origin[order]
        new = np.ones(len(reach), bool)
        new[1:] = (np.diff(reach) != 1) | (np.diff(origin) != 0) | (heads[reach[1:]] != heads[reach[:-1]])
        start = np.flatnonzero(new)
        low = reach[start]
        high = reach[np.append(start[1:], len(reach)) - 1] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return ~known[1:n]


def earlier_copies(minimum: int):
    def work(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies]) + 1
        text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 1
        stops = np.cumsum(sizes) - 1
        text[stops] = 0
        run = np.repeat(np.arange(len(sizes)), sizes)
        suffixes = sorted_suffixes(text, stops[run])
        alike = long_common_prefixes(text, suffixes, minimum)
        member = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
        group = np.cumsum(~np.concatenate([[False], alike]))[member]
        at = suffixes[member]
        owner = run[at]
        ids = table.column("id").to_numpy()[owner]
        hs = table.column("h").to_numpy()[owner]
        starts = table.column("start").to_numpy()[owner] + at - (stops[owner] - sizes[owner] + 1)
        order = np.lexsort((starts, hs, ids, group))
        group, ids_, hs_ = group[order], ids[order], hs[order]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        first = ids_[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else ids_
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (ids_[1:] == ids_[:-1]) & (hs_[1:] == hs_[:-1])
        hit = order[(ids_ != first) | again]
        return span_table(ids[hit], hs[hit], starts[hit], minimum)
    return work


def drop_earlier_seen(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                      bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                sizes, removed, runs, kept = [], [], [], []
                for body, spans in zip(batch.column("body").to_pylist(),
                                       batch.column("spans").to_pylist(), strict=True):
                    gone = covered(len(body), spans)
                    sizes.append(len(body))
                    removed.append(int(gone.sum()))
                    runs.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                    kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes() if removed[-1] else body)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)],
                     pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = Repeats(docs, "bytes", length, seed, True, BUCKET_BYTES, earlier_copies(length), bucket_runs,
                    short_names=True)
    return found.marked().mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
