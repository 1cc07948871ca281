"""Language of a text from averaged hashed subword embeddings and a linear softmax.

Subwords are runs of ``GRAMS`` bytes of the lower-cased text in which everything
in ASCII but letters is a space; a space may only begin or end one. Each is
hashed to one of ``BUCKETS`` embeddings. The mean of a text's embeddings goes
through a linear softmax. Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample; what a subword adds to each
language is then one row of a table of ``BUCKETS`` rows, which is sent to the tasks.

A fifth of the sample is kept from training and calibrates the model: one
temperature makes scores probabilities, and texts below the least score at which
the wanted share of accepted texts is right are marked ``rejected``.

The sample has at most ``SAMPLE_TEXTS`` texts, dealt out evenly to the (at most
``LANGUAGES``, most frequent) languages and picked by a hash of ``doc_id``, and
of each text at most ``TEXT_BUCKETS`` of its most frequent buckets. Predictions
use whole texts, in pieces.

Cases: a null text, or one without a letter, is ``und`` with score 0, rejected; a
null language teaches nothing; a null ``doc_id`` is not held out and teaches
nothing; of equal texts with one language one is in the sample; a language seen
once can be predicted; if nothing can be learned every text is ``und``; equal
scores go to the language that comes first; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.draws import uniform
from evenkeel.llm.text import arrow_batch, chunks
from evenkeel.session import ship_package

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKETS, DIMS = 1 << 16, 16
#: Bounds of the sample.
SAMPLE_TEXTS, LANGUAGES, TEXT_BUCKETS = 6_000, 100, 4_096
EPOCHS, BATCH, RATE, SEED = 6, 16, 4.0, 11
#: Share of accepted texts that shall be right.
RIGHT = 0.99
#: Bytes whose subwords are looked up at once.
PIECE = 1 << 18

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 256)


# ---- subwords -------------------------------------------------------------------

def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each length the bucket of the subword that starts at each byte; ``BUCKETS`` where there is none.

    The last bytes have fewer neighbours; lists are as long as ``data`` less the longest length less one.
    """
    n = max(0, len(data) - GRAMS[-1] + 1)
    letters = _LETTERS[data]
    solid = letters != 0x20
    key, inner, out = letters[:n].astype(np.uint32), np.ones(n, bool), []
    for size in range(2, GRAMS[-1] + 1):
        key = key << np.uint32(8) | letters[size - 1:size - 1 + n]
        if size in GRAMS:
            there = inner if size > 2 else solid[:n] | solid[1:1 + n]
            hashed = (key ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            hashed = (hashed ^ hashed >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(16)
            out.append(np.where(there & (solid[:n] | solid[1:1 + n]), hashed, np.uint32(BUCKETS)).astype(np.int32))
        inner = inner & solid[size - 1:size - 1 + n]
    return out


def _padded(text: Column) -> Column:
    """Spaces around the text let short words be subwords and keep neighbouring texts apart."""
    return F.concat(F.lit(" "), F.lower(text), F.lit("    ")).cast("binary")


def summed(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over the subwords of each padded text, and how many there are."""
    total = np.zeros((len(offsets) - 1, table.shape[1]))
    count = np.zeros(len(offsets) - 1, np.int64)
    for a in range(0, len(data), PIECE):
        b = min(len(data), a + PIECE)
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        part = data[a:b + GRAMS[-1] - 1]
        if len(part) < b - a + GRAMS[-1] - 1:  # the end of the last text is spaces
            part = np.concatenate([part, np.full(b - a + GRAMS[-1] - 1 - len(part), 0x20, np.uint8)])
        starts = np.maximum(offsets[first:last], a) - a
        for found in subwords(part):
            total[first:last] += np.add.reduceat(table[found], starts, axis=0)
            count[first:last] += np.add.reduceat(found != BUCKETS, starts)
    return total, count


# ---- training ---------------------------------------------------------------------

@dataclass
class LanguageModel:
    """What each bucket adds to each language's score, and how scores become answers."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each language for padded texts one after another."""
        total, count = summed(data, offsets, self.table)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def _dense(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of some texts and a matrix of their shares."""
    buckets, where = np.unique(np.concatenate([b for b, _ in bags]), return_inverse=True)
    shares = np.zeros((len(bags), len(buckets)), np.float32)
    shares[np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags]), where] = np.concatenate([s for _, s in bags])
    return buckets, shares


def train(bags: list[Bag], labels: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    weight, bias = np.zeros((DIMS, languages), np.float32), np.zeros(languages, np.float32)
    steps = EPOCHS * -(-len(bags) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            buckets, shares = _dense([bags[r] for r in rows])
            hidden = shares @ embed[buckets]
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            rate = np.float32(RATE * (1 - step / steps) / len(rows))
            back = error @ weight.T
            # a text's mean leaves each of its embeddings a small share of the gradient
            weight -= rate * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            embed[buckets] -= rate * len(buckets) ** 0.5 * (shares.T @ back)
            step += 1
    return embed, weight, bias


def calibrate(logits: np.ndarray, labels: np.ndarray, right: float = RIGHT) -> tuple[float, float]:
    """The temperature with the best likelihood, and the least score that accepts ``right`` of texts rightly."""
    if not len(labels):
        return 1.0, 0.0
    choices = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    chance = softmax(logits / temperature)
    score, hit = chance.max(axis=1), chance.argmax(axis=1) == labels
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
    # scores tied with the last accepted one are accepted with it
    ends = np.append(score[order][1:] < score[order][:-1], True)
    good = np.flatnonzero((share >= right) & ends)
    return temperature, float(score[order][good[-1]]) if len(good) else 1.0


def _sample(docs: DataFrame, may_teach: Column) -> tuple[list[str], list[Bag], np.ndarray]:
    """Languages, and buckets and language of each text of the sample, in a fixed order."""
    known = docs.filter(F.coalesce(may_teach, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull()
                        & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], [], np.zeros(0, np.int64)
    each = SAMPLE_TEXTS / len(counts)
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    picked = known.join(F.broadcast(shares), "lang").filter(uniform("doc_id", "lang") < F.col("share")).select(
        "lang", F.sha2("text", 256).alias("h"), _padded(F.col("text")).alias("body")).dropDuplicates(["lang", "h"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch):
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    total = np.zeros(BUCKETS + 1, np.int64)
                    for i in range(a, b, PIECE):
                        for found in subwords(data[i:min(b, i + PIECE + GRAMS[-1] - 1)]):
                            total += np.bincount(found, minlength=BUCKETS + 1)
                    there = np.flatnonzero(total[:BUCKETS])
                    there = np.sort(there[np.argsort(-total[there], kind="stable")[:TEXT_BUCKETS]])
                    rows.append((there.astype("<u2").tobytes(), total[there].astype("<u4").tobytes()))
                yield arrow_batch({
                    "lang": batch.column("lang").slice(first, last - first),
                    "h": batch.column("h").slice(first, last - first),
                    "buckets": pa.array([r[0] for r in rows], pa.binary()),
                    "counts": pa.array([r[1] for r in rows], pa.binary())})

    found = sorted(picked.mapInArrow(work, "lang string, h string, buckets binary, counts binary").collect(),
                   key=lambda r: (r["h"], r["lang"]))
    languages = sorted({r["lang"] for r in found})
    bags = []
    for r in found:
        counts_ = np.frombuffer(bytes(r["counts"]), "<u4").astype(np.float32)
        bags.append((np.frombuffer(bytes(r["buckets"]), "<u2").astype(np.int64), counts_ / max(counts_.sum(), 1)))
    return languages, bags, np.array([languages.index(r["lang"]) for r in found], np.int64)


def learn_languages(docs: DataFrame, may_teach: Column) -> LanguageModel | None:
    """A calibrated model from ``text`` and ``lang`` of the rows that may teach; None without any."""
    ship_package(docs.sparkSession)
    languages, bags, labels = _sample(docs, may_teach)
    if not languages:
        return None
    aside = np.arange(len(bags)) % 5 == 4
    use = [i for i in range(len(bags)) if not aside[i]]
    embed, weight, bias = train([bags[i] for i in use], labels[use], len(languages))
    table = np.vstack([embed @ weight, np.zeros((1, len(languages)), np.float32)])
    logits = np.array([s @ table[b] + bias for b, s in (bags[i] for i in np.flatnonzero(aside))]).reshape(
        -1, len(languages))
    temperature, least = calibrate(logits, labels[aside])
    return LanguageModel(languages, table, bias, temperature, least)


# ---- prediction -------------------------------------------------------------------

def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``rejected`` of each row."""
    asked = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return asked.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                            F.lit(True).alias("rejected"))
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS rows of LANGUAGES numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, last, data, offsets in chunks(batch):
                chance = own.scores(data, offsets)
                best = chance.argmax(axis=1)
                score = chance[np.arange(len(best)), best]
                known = batch.column("known").slice(first, last - first).to_numpy(zero_copy_only=False)
                yield arrow_batch({
                    "doc_id": batch.column("doc_id").slice(first, last - first),
                    "lang_pred": pa.array([own.languages[i] if k else UNKNOWN for i, k in zip(
                        best.tolist(), known.tolist(), strict=True)], pa.string()),
                    "score": np.where(known, score, 0.0), "rejected": ~known | (score < own.least)})

    rows = asked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").isNotNull().alias("known"),
                        _padded(F.coalesce("text", F.lit(""))).alias("body"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(key: str = "doc_id") -> Column:
    """Rows that are tested on only: ``crc32`` of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
