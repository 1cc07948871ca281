"""Exact Jaccard join of word-shingle sets by universe partitions and one-deletion neighbourhoods.

Two sets with similarity ``PERCENT`` or more and sizes in reach of one size band
differ in at most H shingles. The universe of shingles is dealt by hash into
segments, each of them allowed no difference (its whole part of the set is one
signature) or one (its part and the part less each one shingle are signatures).
An allowance of none counts one and of one counts two; when the counts sum to
more than H, a linked pair shares a signature in some segment (pigeonhole). How
many segments of each kind a band gets is the cheapest mixture by a cost model
of signatures and chance meetings. Parts that are empty, or are so with one
deletion, would meet those of a share of all sets. So a band has some segments to
spare, enough for its smallest sets, and a set whose such parts count no more
than that leaves them out: another segment has to agree.

Sets that share a signature are candidates if their sketches allow it: one bit a
slot, whether an odd number of shingles falls there. Sets differ in as many
shingles as bits at least, and unlike ones in about half the bits, so common
shingles connect hardly any; what the sketches of a signature do not connect is
told apart before any text is read. What is left of all signatures is a clump.
A clump is cut into blocks, and each pair of blocks is compared whole by matrix
products of its shingles, which give back a forest of the links and never the
pairs. A clump of more than ``DIRECT_BLOCKS`` blocks, which chance meetings may
have joined, is thinned out first: each set is compared with a hub of its
signatures, for as many rounds as that closes signatures, and only signatures
whose members are then still in several components stay open. Of these, either
the members of each signature or, where that is fewer copies of texts, all that
they connect are compared; what does not fit a block is cut into blocks and
compared block against block. Near copies that a hub connects need no more; texts
that share signatures without being similar cost a copy for each block or
signature. Every pair that shares a signature was compared or is connected, so
no link is lost. All comparisons are made on the texts.

A signature that repeats inside one Arrow batch is known to recur; its rows are
dealt out by salt, and one of them stands for the batch where it is counted.

Cases: null and empty texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle; equal sets are one node, however
many rows have them; rows that repeat a ``doc_id`` are the same document; a null
``doc_id`` comes last and is reported as null; a very long text is one set; an
empty table gives an empty result. Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.graph import components
from evenkeel.llm.text import (
    BYTES,
    TOKENS,
    arrow_batch,
    as_signed,
    chunks,
    find_words,
    keyed,
    mix,
    own_id,
    row_hash,
    row_id,
    whole_row,
)
from evenkeel.session import drop_scratch, write_scratch

#: Share of the universe's cost model: what one chance meeting costs in signatures.
MEETING_COST = 50.0
#: Standard deviations of the empty parts of a band's smallest sets that its spare segments allow for.
SPREADS = 3.0
#: Segments with one deletion that a band may have.
MOST_LOOSE = 24
#: Sets, and bytes of their texts, planned for one block of a clump.
BLOCK_SETS, BLOCK_BYTES = 2400, 6 << 20
#: Blocks of a clump up to which every two of them are compared at once.
DIRECT_BLOCKS = 8
#: Bytes of texts that blocks of clumps get in one turn, if the texts themselves are not more.
TURN_BYTES = 64 << 20
#: Bits of a set's sketch, as a share of its shingles, at least and at most; bytes of sketches in one task.
SKETCH_SHARE, LEAST_BITS, MOST_BITS = 0.7, 64, 1 << 14
SKETCH_BYTES = 16 << 20
#: Bytes of sketches in one turn, for each shingle of the table, if they are more than ``TURN_BYTES``.
SKETCH_ROOM = 4
#: Members of a signature up to which all its pairs are made at once.
PAIRED_SETS = 64
#: Members that are compared with one copy of the smallest set of their signature.
STAR_SETS = 512
#: Rounds of hubs in wide clumps, and the share of open members up to which another round is worth it.
STAR_TURNS, MOST_LEFT = 4, 0.7
#: Shingles that one matrix product looks at, and rows of its result that are made at once.
COLUMNS, ROWS = 1024, 512
#: Shingles of more than this share of the sets go into matrix products, pairs of the others are
#: counted one by one, so many at a time.
DENSE, PAIRS = 0.1, 1 << 20
SALTS = 1024
#: Ids up to this many (16 bytes each) are broadcast to pick their texts, more are joined by shuffle.
BROADCAST_IDS = 500_000
OUT_ROWS = 200_000

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = BYTES.table[_LOWER]


# ---- sets ---------------------------------------------------------------------

def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, one after another, and their places."""
    starts, ends, places = find_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = BYTES.runs(BYTES.sums(_TABLE[data]), starts, ends)
    sums = TOKENS.sums(words)
    found = []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if b - a >= width:
            at = np.arange(a, b - width + 1)
            found.append(np.unique(TOKENS.runs(sums, at, at + width)))
        elif b > a:
            found.append(mix(TOKENS.runs(sums, np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in found])
    return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)])


def _sums_by_row(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[places[1:]] - total[places[:-1]]


def set_names(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    sizes = np.diff(places).astype(np.uint64)
    return mix(_sums_by_row(mix(tokens ^ np.uint64(0x51ED270B7F4A7C15)), places) + sizes)


def sketches(tokens: np.ndarray, places: np.ndarray) -> list[bytes]:
    """For each set one bit for each slot of a power of two: whether it has an odd number of shingles there.

    Two sets differ in at least as many shingles as their sketches in bits. A
    sketch folds to half its slots by exclusive or of its halves.
    """
    value = mix(tokens ^ np.uint64(0x6A09E667F3BCC909))
    out = []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        bits = LEAST_BITS
        while bits < min(SKETCH_SHARE * (b - a), MOST_BITS):
            bits *= 2
        slot = (value[a:b] & np.uint64(bits - 1)).astype(np.int64)
        out.append(np.packbits(np.bincount(slot, minlength=bits) & 1).tobytes())
    return out


# ---- signatures -----------------------------------------------------------------

class Scheme:
    """Bands of set sizes and the segments of each, for one similarity in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    @lru_cache(maxsize=None)  # noqa: B019 - a scheme lives as long as its process
    def band(self, k: int) -> tuple[int, int]:
        lo = 1 if k == 0 else self.band(k - 1)[1] + 1
        return lo, max(lo, lo * 10_000 // self.percent ** 2)

    def band_of(self, size: int) -> int:
        k = 0
        while self.band(k)[1] < size:
            k += 1
        return k

    @lru_cache(maxsize=None)  # noqa: B019
    def most_apart(self, k: int) -> int:
        """Largest symmetric difference of a linked pair whose smaller set is in the band."""
        lo, hi = self.band(k)
        both = np.arange(2 * lo, hi + hi * 100 // self.percent + 1)
        shared = -(-self.percent * both // (100 + self.percent))
        return int(np.max(both - 2 * shared, initial=0))

    @lru_cache(maxsize=None)  # noqa: B019
    def plan(self, k: int) -> tuple[int, int, int]:
        """Segments with one deletion, segments without, and spare differences; the cheapest mixture."""
        lo, hi = self.band(k)
        size, need = (lo + hi) / 2, self.most_apart(k) + 1
        best = None
        for ones in range(min(need, MOST_LOOSE) + 1):
            exact, spare, enough = max(0, need - 2 * ones), -1, max(0, 2 * ones - need)
            while spare < enough <= need:  # more segments thin out the others a little
                spare, exact = enough, max(exact, need + enough - 2 * ones)
                each = lo / max(1, ones + exact)
                none, few = math.exp(-each), (1 + each) * math.exp(-each)
                spread = math.sqrt((exact * none + 4 * ones * few) * (1 - few))
                enough = max(spare, math.ceil(exact * none + 2 * ones * few + SPREADS * spread))
            if enough > need and best is not None:
                continue
            each = size / max(1, ones + exact)
            cost = exact * (1 + MEETING_COST * math.exp(-each) / 10) + ones * (
                1 + each + MEETING_COST * (1 + each) * math.exp(-each))
            if best is None or cost < best[0]:
                best = cost, ones, exact, exact + 2 * ones - need
        return best[1:]

    @lru_cache(maxsize=None)  # noqa: B019
    def bands_for(self, size: int) -> tuple[int, ...]:
        """The bands in which a set of this size has partners."""
        own = self.band_of(size)
        lower = [j for j in range(max(0, own - 3), own) if self.band(j)[1] * 100 >= self.percent * size]
        return tuple(k for k in [*lower, own] if self.most_apart(k) > 0)

    def signatures(self, tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signature and set number, for sets of shingle hashes one after another."""
        sizes = np.diff(places)
        jobs = [(row, k) for row, n in enumerate(sizes.tolist()) if n for k in self.bands_for(n)]
        if not jobs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = np.array([j[0] for j in jobs])
        plans = np.array([self.plan(k) for _, k in jobs])
        ones, exact, spare = plans.T
        segments = ones + exact
        base = np.concatenate([[0], np.cumsum(segments)])
        counts = sizes[rows]
        job = np.repeat(np.arange(len(jobs)), counts)
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(places[rows], counts)
        token = tokens[at]
        place = (mix(token + np.uint64(1)) >> np.uint64(24)) % segments[job].astype(np.uint64)
        slot = base[job] + place.astype(np.int64)
        value = mix(token ^ np.uint64(0x2545F4914F6CDD1D))
        part = np.zeros(base[-1], np.uint64)
        np.add.at(part, slot, value)
        owner = np.repeat(np.arange(len(jobs)), segments)
        within = np.arange(base[-1]) - base[owner]
        band = np.array([k for _, k in jobs], np.uint64)
        salt = mix((band[owner] << np.uint64(32)) + within.astype(np.uint64) + np.uint64(1))
        loose = within < ones[owner]
        # parts that are empty, or are so with one deletion, would meet those of very many sets
        held = np.bincount(slot, minlength=base[-1])
        weak = held <= loose
        missed = np.bincount(owner, np.where(weak, 1 + loose, 0), len(jobs))
        hidden = weak & (missed <= spare)[owner]
        shown = ~hidden | (held > 0)
        deleted = loose[slot] & ~hidden[slot]
        sigs = np.concatenate([mix(part + salt)[shown],
                               mix(part[slot[deleted]] - value[deleted] + salt[slot[deleted]])])
        return sigs, rows[np.concatenate([owner[shown], job[deleted]])]


def _slices(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = len(next(iter(columns.values())))
    for i in range(0, total, OUT_ROWS):
        yield arrow_batch({k: v[i:i + OUT_ROWS] for k, v in columns.items()})


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch):
                tokens, places = shingle_sets(data, offsets, width)
                yield arrow_batch({
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "id": batch.column("id").slice(first, last - first),
                    "h": batch.column("h").slice(first, last - first),
                    "n": np.diff(places).astype(np.int64),
                    "node": as_signed(set_names(tokens, places)),
                    "sketch": pa.array(sketches(tokens, places), pa.binary())})

    df = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return df.mapInArrow(work, "doc_id long, id long, h long, n long, node long, sketch binary")


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of ``sig``, ``salt`` and ``node``; salt 0 is to be counted, others are known to recur."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            sigs, nodes, seen = [], [], set()
            for _, _, data, offsets in chunks(batch):
                tokens, places = shingle_sets(data, offsets, width)
                names = set_names(tokens, places)
                fresh = np.array([not (x in seen or seen.add(x)) for x in names.tolist()], bool)
                sizes = np.diff(places)
                keep = np.repeat(fresh, sizes)
                sig, row = scheme.signatures(
                    tokens[keep], np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))]))
                sigs.append(sig)
                nodes.append(names[row])
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
            if not len(sig):
                continue
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            shared = ~new | np.concatenate([~new[1:], [False]])
            yield from _slices({"sig": as_signed(sig[new]), "salt": np.zeros(int(new.sum()), np.int32),
                                "node": as_signed(node[new])})
            yield from _slices({
                "sig": as_signed(sig[shared]), "node": as_signed(node[shared]),
                "salt": (1 + mix(node[shared]) % np.uint64(SALTS)).astype(np.int32)})

    df = keyed(docs).select("body")

    def ordered(batches):
        for b in work(batches):
            yield b.select(["sig", "salt", "node"])

    return df.mapInArrow(ordered, "sig long, salt int, node long")


def _recurring(signed: DataFrame) -> DataFrame:
    """Signatures that two sets share: ``sig`` and ``node``."""
    alike = Window.partitionBy("sig", "salt")
    return signed.withColumn("lo", F.min("node").over(alike)).withColumn("hi", F.max("node").over(alike)).filter(
        (F.col("salt") > 0) | (F.col("lo") < F.col("hi"))).select("sig", "node")


# ---- sketches -------------------------------------------------------------------

class Sketched:
    """Sketches of sets, and which pairs of sets may be similar by them."""

    def __init__(self, sizes: np.ndarray, sketch: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        words = np.array([len(x) // 8 for x in sketch])
        self.words, self.place, self.own, self.half = words, np.zeros(len(sketch), np.int64), {}, {}
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            bits = np.frombuffer(b"".join(sketch[i] for i in at.tolist()), np.uint64).reshape(len(at), w)
            self.place[at] = np.arange(len(at))
            self.own[w] = bits
            if w > 1:
                self.half[w] = bits[:, :w // 2] ^ bits[:, w // 2:]

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of set numbers differ in no more bits than linked sets in shingles."""
        both, p = self.sizes[a] + self.sizes[b], self.percent
        most = both - 2 * -(-p * both // (100 + p))
        good = np.abs(self.sizes[a] - self.sizes[b]) <= most
        swap = self.words[a] < self.words[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        # sizes of linked sets may be further apart than a fold where the similarity asked for is low
        for w in self.own:
            for table, v in ((self.own, w), (self.half, w // 2)):
                at = np.flatnonzero(good & (self.words[a] == w) & (self.words[b] == v)) if v in self.own else []
                step = max(1, PAIRS // w)
                for i in range(0, len(at), step):
                    part = at[i:i + step]
                    apart = table[w][self.place[a[part]]] ^ self.own[v][self.place[b[part]]]
                    good[part] = np.bitwise_count(apart).sum(axis=1) <= most[part]
        return good


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give all that the pairs connect the smallest number among them."""
    while len(x):
        x, y = root[x], root[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root[:] = root[root]


def alike_groups(sig: np.ndarray, owner: np.ndarray, known: Sketched) -> np.ndarray:
    """For each place of a signature (in order) the first place that pairs in reach connect it with."""
    root = np.arange(len(sig))
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    for d in np.unique(sizes[(sizes > 1) & (sizes <= PAIRED_SETS)]).tolist():
        i, j = np.triu_indices(d, 1)
        first = starts[sizes == d]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(first), step):
            x, y = ((first[k:k + step, None] + side).ravel() for side in (i, j))
            good = known.may_link(owner[x], owner[y])
            _join(root, x[good], y[good])
    for a, n in zip(starts[sizes > PAIRED_SETS].tolist(), sizes[sizes > PAIRED_SETS].tolist(), strict=True):
        own = np.arange(n)
        for i in range(n):
            other = np.flatnonzero(own[i + 1:] != own[i]) + i + 1
            if not len(other) and (own == own[0]).all():
                break
            good = other[known.may_link(np.full(len(other), owner[a + i]), owner[a + other])]
            names = np.unique(own[np.append(good, i)])
            own[np.isin(own, names)] = names[0]
        root[a:a + n] = a + own
    return root


def _alike(meet: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Sets that share a signature, less those that sketches tell apart from all others there: ``sig`` and ``node``.

    What is left of a signature may fall into several groups. A group is named
    by its members, so signatures with the same ones are one. Rows take turns,
    so that no more sketches are on disk than the texts take.
    """
    def work(table: pa.Table) -> pa.Table:
        sig, node = (table.column(c).to_numpy() for c in ("sig", "node"))
        names, first, owner = np.unique(node, return_index=True, return_inverse=True)
        picked = table.select(["n", "sketch"]).take(pa.array(first))
        known = Sketched(picked.column("n").to_numpy(), picked.column("sketch").to_pylist(), percent)
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
        sig, owner = sig[new], owner[new]
        root = alike_groups(sig, owner, known)
        often = np.bincount(root, minlength=len(root))
        kept = often[root] > 1
        root, owner = root[kept], owner[kept]
        total = np.zeros(len(often), np.uint64)
        np.add.at(total, root, mix(names[owner].view(np.uint64) ^ np.uint64(0x3C6EF372FE94F82B)))
        group = as_signed(mix(total + often.astype(np.uint64)))[root]
        rows = np.unique(np.column_stack([group, names[owner]]), axis=0)
        return pa.table({"sig": pa.array(rows[:, 0], pa.int64()), "node": pa.array(rows[:, 1], pa.int64())})

    named = sets.filter("n > 0").groupBy("node").agg(F.first(F.struct("n", "sketch")).alias("s")).select("node", "s.*")
    named = write_scratch(named.join(meet.select("node").distinct(), "node", "left_semi"), "sketches")
    total = meet.join(named.select("node", F.length("sketch").alias("b")), "node").agg(F.sum("b")).first()[0] or 0
    room = max(TURN_BYTES, SKETCH_ROOM * (sets.agg(F.sum("n")).first()[0] or 0))
    turns, out = max(1, -(-total // room)), None
    buckets = max(1, -(-total // (SKETCH_BYTES * turns)))
    for t in range(turns):
        part = meet.filter(F.pmod(F.xxhash64("sig", F.lit("turn")), F.lit(turns)) == t) if turns > 1 else meet
        found = part.join(named, "node").groupBy(F.pmod(F.xxhash64("sig"), F.lit(buckets))).applyInArrow(
            work, "sig long, node long")
        found = write_scratch(found.distinct(), "alike")
        out = found if out is None else out.unionByName(found)
    out = write_scratch(out.distinct(), "alike") if turns > 1 else out
    drop_scratch(named)
    return out


# ---- verification ---------------------------------------------------------------

def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of shingles reach the similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _star_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are similar enough.

    A text ``b`` is sent once for ``STAR_SETS`` of its partners and read once in a task.
    """
    def sets_of(table: pa.Table) -> Iterator[np.ndarray]:
        for batch in table.select(["body"]).combine_chunks().to_batches():
            for _, _, data, offsets in chunks(batch):
                tokens, places = shingle_sets(data, offsets, width)
                yield from (tokens[x:y] for x, y in zip(places[:-1], places[1:], strict=True))

    def work(members: pa.Table, hubs: pa.Table) -> pa.Table:
        known = dict(zip(hubs.column("b").to_pylist(), sets_of(hubs), strict=True))
        good = np.array([linked(x, known[b], percent) for x, b in zip(
            sets_of(members), members.column("b").to_pylist(), strict=True)], bool)
        return members.select(["a", "b"]).filter(pa.array(good))

    sized = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_SETS).cast("int").alias("slices"))
    total = texts.join(pairs.select(F.col("a").alias("node")), "node").agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(1, -(-total // BLOCK_BYTES))
    bucket = F.pmod(F.xxhash64("b", "slice"), F.lit(buckets))
    members = pairs.join(sized, "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices"))).select(
        "a", "b", bucket.alias("bucket")).join(texts.withColumnRenamed("node", "a"), "a")
    hubs = sized.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1))).select(
        "b", bucket.alias("bucket")).distinct().join(texts.withColumnRenamed("node", "b"), "b")
    # both sides come from one table; new aliases keep their columns apart
    members, hubs = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (members, hubs))
    return members.groupBy("bucket").cogroup(hubs.groupBy("bucket")).applyInArrow(work, "a long, b long")


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each node asked for: ``node`` and ``body``."""
    wanted = write_scratch(sets.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min_by(F.struct("id", "h"), F.struct("id", "h")).alias("row")).select("node", "row.id", "row.h"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    found = keyed(docs).join(F.broadcast(wanted) if few else wanted, ["id", "h"]).select("node", "body")
    texts = write_scratch(found.dropDuplicates(["node"]), "texts")
    drop_scratch(wanted)
    return texts


def _count_pairs(shared: np.ndarray, owner: np.ndarray, often: np.ndarray) -> None:
    """Add one for each two owners of a shingle, above the diagonal.

    ``owner`` lists the owners of one shingle after another, ``often`` how many each has.
    """
    flat, n = shared.reshape(-1), len(shared)
    start = np.cumsum(often) - often
    for d in np.unique(often).tolist():
        i, j = np.triu_indices(d, 1)
        at = start[often == d]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            members = owner[at[k:k + step, None] + np.arange(d)]
            np.add.at(flat, (members[:, i].astype(np.int64) * n + members[:, j]).ravel(), np.float32(1))


def linked_forest(sets: list[np.ndarray], names: list[int], percent: int) -> list[tuple[int, int]]:
    """Links among sets of shingles, enough to connect what all of them connect.

    Counts of common shingles come from products of 0/1 matrices for frequent
    shingles, some at a time, and from the pairs of owners for the others; a
    shingle of one set only is left out.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    often = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    many = often > max(2, len(sets) * DENSE)
    _count_pairs(shared, owner[~many[column]], often[~many])
    common = many[column]
    owner, column = owner[common], (np.cumsum(many) - 1)[column[common]]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        for i in range(0, len(sets), ROWS):
            shared[i:i + ROWS] += part[i:i + ROWS] @ part.T
    root = list(range(len(sets)))
    found = []
    for row in range(len(sets)):
        both = shared[row, row + 1:].astype(np.int64)
        union = sizes[row] + sizes[row + 1:] - both
        for j in (np.flatnonzero((both > 0) & (100 * both >= percent * union)) + row + 1).tolist():
            i = row
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                found.append((names[i], names[j]))
    return found


def _blocks(size, total) -> F.Column:
    return F.ceil(F.greatest(size / BLOCK_SETS, total / BLOCK_BYTES)).cast("int")


def _clumps(meets: DataFrame, texts: DataFrame) -> DataFrame:
    """What the pairs ``a``, ``b`` connect: ``clump``, ``node``, its ``bytes`` and the clump's ``blocks``."""
    members = components(meets).select("node", F.col("comp").alias("clump")).join(
        texts.select("node", F.length("body").alias("bytes")), "node")
    blocks = members.groupBy("clump").agg(_blocks(F.count(F.lit(1)), F.sum("bytes")).alias("blocks"))
    return write_scratch(members.join(blocks, "clump").select("clump", "node", "bytes", "blocks"), "clumps")


def _open_groups(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups to compare for the open signatures (``sig``, ``node``): ``clump``, ``node``, ``bytes`` and ``blocks``.

    By signature, one group for all signatures with the same members, or by what
    the signatures connect, whichever needs fewer bytes of texts in a clump.
    """
    same = rest.groupBy("sig").agg(
        F.min("node").alias("low"), F.count(F.lit(1)).alias("n"), F.sum(F.hash("node").cast("long")).alias("x"),
        F.bit_xor(F.xxhash64("node")).alias("y"))
    once = same.groupBy("n", "x", "y").agg(F.min_by(F.struct("sig", "low"), "sig").alias("one")).select("one.*")
    kept = write_scratch(rest.join(once, "sig"), "open")
    whole = _clumps(kept.filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")), texts)
    parts = kept.join(whole.select("node", "clump", "bytes"), "node")
    sized = parts.groupBy("sig", "clump").agg(_blocks(F.count(F.lit(1)), F.sum("bytes")).alias("blocks"),
                                              F.sum("bytes").alias("total"))
    by_sig = sized.groupBy("clump").agg(F.sum(F.col("total") * F.col("blocks")).alias("apart"))
    by_clump = whole.groupBy("clump").agg(F.sum(F.col("bytes") * F.col("blocks")).alias("together"))
    choice = by_sig.join(by_clump, "clump").select("clump", (F.col("apart") < F.col("together")).alias("split"))
    apart = parts.join(choice.filter("split").select("clump"), "clump", "left_semi").join(
        sized.select("sig", "blocks"), "sig").select(F.col("sig").alias("clump"), "node", "bytes", "blocks")
    together = whole.join(choice.filter(~F.col("split")).select("clump"), "clump", "left_semi")
    # the two kinds of names are hashes of their own; the last column keeps them apart
    return write_scratch(apart.withColumn("split", F.lit(True)).unionByName(
        together.select("clump", "node", "bytes", "blocks").withColumn("split", F.lit(False))), "groups")


def _clump_links(clumps: DataFrame, texts: DataFrame, width: int, percent: int, room: int) -> DataFrame:
    """Links (``a``, ``b``) inside clumps, block against block.

    A text travels once for each block of its clump. Pairs of blocks take turns,
    so that only ``room`` bytes or so of such copies are on disk at a time.
    """
    def work(table: pa.Table) -> pa.Table:
        names, sets = table.column("node").to_pylist(), []
        for batch in table.select(["body"]).combine_chunks().to_batches():
            for _, _, data, offsets in chunks(batch):
                tokens, places = shingle_sets(data, offsets, width)
                sets += [tokens[x:y] for x, y in zip(places[:-1], places[1:], strict=True)]
        found = linked_forest(sets, names, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([x for _, x in found], pa.int64())})

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = clumps.withColumn("own", own).select(
        "clump", "split", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "clump", "split", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    copies = clumps.agg(F.sum(F.col("bytes").cast("long") * F.col("blocks"))).first()[0] or 0
    turns = max(1, -(-copies // max(room, TURN_BYTES)))
    turn, out = F.pmod(F.xxhash64("clump", "split", "i", "j", F.lit("turn")), F.lit(turns)), None
    for t in range(turns):
        part = dealt.filter(turn == t) if turns > 1 else dealt
        found = part.join(texts, "node").groupBy("clump", "split", "i", "j").applyInArrow(work, "a long, b long")
        if turns > 1:
            found = write_scratch(found, "links")
        out = found if out is None else out.unionByName(found)
    return out


def _open(rest: DataFrame, star: DataFrame) -> DataFrame:
    """The signatures (``sig``, ``node``, ``comp``) whose members are in several components of the links."""
    named = rest.join(components(star), "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp"))
    several = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return write_scratch(named.join(several.select("sig"), "sig", "left_semi"), "open")


def _more_stars(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Compare each member with one hub a round while that closes signatures; what is still open, and all links.

    The hub of a signature is the member with the lowest hash, so signatures of one
    family mostly agree on it; a member takes the lowest hub of its signatures
    that is not in its own component yet.
    """
    left, star = rest.withColumn("comp", F.col("node")), None
    held = None
    for turn in range(STAR_TURNS):
        n = left.count()
        if not n or (held is not None and n > MOST_LEFT * held):
            break
        held = n
        low = lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        hubs = left.groupBy("sig").agg(F.min_by(F.struct("node", "comp"), low("node")).alias("hub"))
        pairs = left.join(hubs, "sig").filter("comp != hub.comp").groupBy(F.col("node").alias("a")).agg(
            F.min_by("hub.node", low("hub.node")).alias("b"))
        found = _star_links(write_scratch(pairs, "pairs"), texts, width, percent)
        star = write_scratch(found if star is None else star.unionByName(found), "links")
        left = _open(left.select("sig", "node"), star)
    return left.select("sig", "node"), star


def links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of the similarity graph: ``node`` and ``comp`` for every linked node."""
    shared = write_scratch(_recurring(_signed(docs, width, percent)), "signatures")
    meet = _alike(shared, sets, percent)
    drop_scratch(shared)
    texts = _texts(docs, sets, meet.select("node").distinct())
    room = texts.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    hubs = meet.groupBy("sig").agg(F.min("node").alias("hub"))
    starred = meet.join(hubs, "sig").filter("node != hub")
    pairs = write_scratch(starred.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    clumps = _clumps(pairs, texts).withColumn("split", F.lit(False))
    near = clumps.filter(F.col("blocks") <= DIRECT_BLOCKS)
    found = write_scratch(_clump_links(near, texts, width, percent, room), "links")
    wide = clumps.filter(F.col("blocks") > DIRECT_BLOCKS).select("node")
    if wide.limit(1).count():
        rest = write_scratch(meet.join(wide, "node", "left_semi"), "rest")
        left, star = _more_stars(rest, texts, width, percent)
        more = write_scratch(_clump_links(_open_groups(left, texts), texts, width, percent, room), "links")
        found = found.unionByName(star).unionByName(more)
        drop_scratch(rest)
    for table in (meet, texts, pairs, clumps):
        drop_scratch(table)
    return components(found)


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row.

    ``component_id`` is the smallest ``doc_id`` that links reach. ``stays`` marks
    one document of each component, the one of that id.
    """
    sets = write_scratch(_sets(docs, width), "sets")
    labels = links(docs, sets, width, percent)
    placed = sets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.filter("n > 0").groupBy("comp").agg(F.min(F.struct("id", "h")).alias("low"))
    placed = placed.join(lowest, "comp", "left").withColumn(
        "low", F.when(F.col("n") > 0, F.col("low")).otherwise(F.struct("id", "h")))
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"),
        own_id("low.id").alias("component_id"),
        ((F.col("low.id") == F.col("id")) & (F.col("low.h") == F.col("h"))).alias("stays"), "id", "h")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns."""
    kept = similar_groups(docs, width, percent).filter("stays").select("id", "h").distinct()
    # the row travels as one column, so that no name of its columns can clash
    df = docs.select(whole_row(docs), row_id().alias("id"), row_hash().alias("h"))
    return df.join(kept, ["id", "h"]).dropDuplicates(["id", "h"]).select("row.*")
