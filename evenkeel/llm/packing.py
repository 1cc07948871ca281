"""Pack documents into sequences of fixed length along a Hilbert curve.

Every document becomes its token ids and an end id. A vector is hashed from the
ids and projected to ``DIMS`` dimensions; its cell on the Hilbert curve through
that space is the sort key, so that neighbours on the curve are alike. Documents
are range-sorted by key, laid end to end and cut every ``length`` ids: all
sequences are full but the last one.

Bounds of the ranges come from the keys of a sample of documents; a key that
fills several ranges is dealt out among them by a hash of the row. The sorted
table is written once with the place of each document inside its range; the
ranges' totals (one number each) give the places in the whole. So all ids are
computed once and a lost executor changes no place.

Cases: a null or empty text is the end id alone; a long text spans many
sequences; rows that repeat ``doc_id`` and text are packed as often as they
occur, side by side; equal keys are ordered by id; an empty table packs nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.text import arrow_batch, keyed, mix
from evenkeel.session import write_scratch

LENGTH = 2048
END = 1
DIMS = 4
#: Bits of each coordinate; DIMS * BITS stays below 63.
BITS = 15
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Ranges of the curve for each shuffle partition, sampled documents for each range, and at most.
RANGES, SAMPLED, SAMPLE_ROWS, SAMPLE_SEED = 2, 25, 400_000, 5
BATCH = 512


# ---- tokens -----------------------------------------------------------------------

def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, by the vocabulary's ranks.

    Texts with the vocabulary's special mark go through its own tokenizer.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        with open(_tokenizer_path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def whole(self):
        """The vocabulary's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(_tokenizer_path(self.vocabulary))

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or "\x85" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.pieces.encode_ordinary(text), np.uint16)


@lru_cache(maxsize=1)
def encoder() -> Encoder:
    return Encoder()


# ---- the curve ----------------------------------------------------------------------

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``2 ** bits``.

    The coordinates are turned, from the highest bit down, into the frame of the
    sub-cube they fall in; the Gray code of the turned bits is the place.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        high = one << np.uint64(bit)
        low = high - one
        for d in range(dims):
            inside = (x[d] & high) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        high = one << np.uint64(bit)
        turn = np.where((x[-1] & high) != 0, turn ^ (high - one), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << one) | ((x[d] >> np.uint64(bit)) & one)
    return place.astype(np.int64)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """A sign for each id and dimension."""
    seeds = np.arange((1 << 16) * DIMS, dtype=np.uint64)
    return (1 - 2 * (mix(seeds + np.uint64(99)) >> np.uint64(63)).astype(np.int8)).reshape(-1, DIMS)


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document from its hashed and projected ids."""
    signs = _directions()
    points = np.array([signs[d].sum(axis=0, dtype=np.int64) / max(1.0, np.sqrt(len(d))) if len(d)
                       else np.zeros(DIMS) for d in documents]).reshape(-1, DIMS)
    cells = (0.5 + np.arctan(points / 4) / np.pi) * ((1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


# ---- packing --------------------------------------------------------------------------

def _part(keys: np.ndarray, ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each document; equal bounds share their key's documents."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    spread = mix(ids.view(np.uint64) ^ hashes.view(np.uint64)) % (high - low + 1).astype(np.uint64)
    return (low + spread.astype(np.int64)).astype(np.int32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with the token ids of their texts."""
    tool = encoder()
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            batch = whole.slice(i, BATCH)
            yield batch, [tool.encode(t.as_py()) for t in batch.column("text")]


def _keys(docs: DataFrame) -> DataFrame:
    """``key`` of each document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in _texts(batches):
            yield arrow_batch({"key": curve_keys(ids)})

    return keyed(docs).select(F.col("body").cast("string").alias("text")).mapInArrow(work, "key long")


def _encoded(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``doc_id``, ``id``, ``h``, ``key``, ``ids`` (16-bit, with the end id) and ``part``, the range of the key."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], np.uint16).tobytes()
        for batch, ids in _texts(batches):
            keys = curve_keys(ids)
            yield arrow_batch({
                "doc_id": batch.column("doc_id"), "id": batch.column("id"), "h": batch.column("h"), "key": keys,
                "ids": pa.array([x.tobytes() + end for x in ids], pa.binary()),
                "part": _part(keys, batch.column("id").to_numpy(), batch.column("h").to_numpy(), bounds)})

    df = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "id", "h",
                            F.col("body").cast("string").alias("text"))
    return df.mapInArrow(work, "doc_id long, id long, h long, key long, ids binary, part int")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add how many ids of its range stand before each document; ranges follow each other."""
    last, before = -1, 0
    for batch in batches:
        parts = batch.column("part").to_numpy()
        sizes = pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // 2
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
        start = np.repeat(ahead[first], np.diff(np.append(first, len(parts)))) if len(parts) else sizes
        place = ahead[:-1] - start
        if len(parts):
            place[parts == last] += before
            yield arrow_batch({"doc_id": batch.column("doc_id"), "part": parts, "before": place,
                               "size": sizes, "ids": batch.column("ids")})
            last, before = int(parts[-1]), int(place[-1] + sizes[-1])


def _cutter(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (w.slice(i, BATCH) for w in batches for i in range(0, w.num_rows, BATCH)):
            rows, cuts = [], []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, at, raw in zip(doc_ids, batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.uint16).astype("<u4")
                start = 0
                while start < len(ids):
                    offset = (at + start) % length
                    take = min(length - offset, len(ids) - start)
                    rows.append((doc, start, take, len(ids), (at + start) // length, offset))
                    cuts.append(ids[start:start + take].tobytes())
                    start += take
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(cuts, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return work


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document in a sequence; ``ids`` are little-endian 32-bit."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = RANGES * parts
    share = min(1.0, min(SAMPLE_ROWS, SAMPLED * ranges) / max(docs.count(), 1))
    keys = np.sort([r["key"] for r in _keys(
        docs if share == 1.0 else docs.sample(False, share, SAMPLE_SEED)).collect()])
    bounds = keys[[len(keys) * i // ranges for i in range(1, ranges)]] if len(keys) else np.zeros(0, np.int64)
    line = write_scratch(_encoded(docs, bounds).repartition(
        parts, "part").sortWithinPartitions("part", "key", "id", "h").mapInArrow(
        _placed, "doc_id long, part int, before long, size long, ids binary"), "curve")
    totals = {r["part"]: r["n"] for r in line.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    numbers = sorted(totals)
    starts = zip(numbers, accumulate([0, *(totals[p] for p in numbers)]), strict=False)
    offsets = spark.createDataFrame([(p, n) for p, n in starts] or [(0, 0)], "part int, ahead long")
    placed = line.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(
        _cutter(length), "doc_id long, start long, length long, doc_tokens long, sequence_id long,"
        " offset long, ids binary")
