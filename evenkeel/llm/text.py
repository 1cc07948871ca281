"""Words, word hashes and row identity shared by the text operators.

A word is a run of characters other than space and U+0009..U+000D. Those six
are single bytes in UTF-8, so words can be found on the bytes.

Rows are told apart by ``id`` and a hash of the text: rows that repeat both are
the same document and get the same answer. ``id`` is the ``doc_id``; a row
without one gets an id above all others (``NO_ID`` and more) from its text. A
null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.session import ship_package

WORD = r"[^\x20\x09-\x0D]+"
#: Ids from here on stand for rows without a ``doc_id``; real ids are smaller.
NO_ID = 2**62
#: Bytes handled at once in a Python task; a longer text is handled alone.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(text: Column) -> Column:
    """All words of a text; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def row_id() -> Column:
    """The ``doc_id``, or an id from the text where there is none."""
    return F.coalesce(F.col("doc_id").cast("long"), row_hash().bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, ``row``; ``row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def own_id(name: str = "id") -> Column:
    """Back from an id to the ``doc_id``."""
    return F.when(F.col(name) < NO_ID, F.col(name))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``id`` and ``h`` (row identity) and the text as UTF-8 bytes."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", row_id().alias("id"), row_hash().alias("h"), text.cast("binary").alias("body"))


# ---- hashing on arrays ----------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) & (2**64 - 1)
    return x


class Rolling:
    """Hashes of any run of a sequence from one running sum (mod 2^64)."""

    def __init__(self, seed: int):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1)
                         + np.uint64(seed << 20))
        self.a = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        self.powers = np.ones(0, np.uint64)
        self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, a in (("powers", self.a), ("inverses", _inverse(self.a))):
                steps = np.full(size, a, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[starts:ends]`` for each pair, from ``sums(values)``."""
        self._grow(len(sums))  # a task may hold a copy of its own
        return mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of every run of ``width`` values."""
        self._grow(len(sums))
        n = max(0, len(sums) - width)
        return mix((sums[width:] - sums[:n]) * self.inverses[:n])


BYTES = Rolling(11)
TOKENS = Rolling(23)
CONTENT = Rolling(41)


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's place in that list."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and each document's place in that list."""
    starts, ends, places = find_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), places
    return BYTES.runs(BYTES.sums(BYTES.table[data]), starts, ends), places


# ---- Arrow batches ----------------------------------------------------------------

def chunks(batch: pa.RecordBatch, column: str = "body") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their bytes: ``(first, last, data, offsets)``."""
    body = batch.column(column)
    large = pa.types.is_large_binary(body.type)
    offs = np.frombuffer(body.buffers()[1], np.int64 if large else np.int32)
    offs = offs[body.offset: body.offset + len(body) + 1].astype(np.int64)
    buffer = body.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(body):
        last = int(np.searchsorted(offs, offs[first] + CHUNK_BYTES, side="right")) - 1
        last = min(len(body), max(last, first + 1))
        yield first, last, data[offs[first]:offs[last]], offs[first:last + 1] - offs[first]
        first = last


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def arrow_batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()],
        names=list(columns))


def doc_of(places: np.ndarray, count: int) -> np.ndarray:
    """Document number of each of ``count`` entries, given each document's place."""
    return np.repeat(np.arange(len(places) - 1), np.diff(places))[:count]
