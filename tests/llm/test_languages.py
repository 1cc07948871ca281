"""Language identification: subwords and scores against plain versions, accuracy on held-out texts."""

import math
import re

import numpy as np
import pytest

from evenkeel.llm import languages
from pyspark.sql import functions as F
from tests.llm.fixtures import empty, table, texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return languages.learn_languages(docs, ~languages.held_out())


def _plain_grams(text):
    """Subwords of a text as byte strings, one by one."""
    data = re.sub(rb"[\x00-\x60\x7b-\x7f]", b" ", f" {text.lower()}    ".encode())
    out = []
    for size in languages.GRAMS:
        for i in range(len(data) - size + 1):
            gram = data[i:i + size]
            if b" " not in gram[1:-1] and gram.strip(b" "):
                out.append(gram)
    return out


def _bucket(gram):
    key = int.from_bytes(gram, "big") ^ (len(gram) * 0x9E3779B1 & 0xFFFFFFFF)
    x = key * 0x85EBCA6B % 2**32
    x = (x ^ x >> 13) * 0xC2B2AE35 % 2**32
    return x >> 16


@pytest.mark.parametrize("piece", [1 << 18, 64])
def test_subwords_and_scores_equal_plain_ones(model, monkeypatch, piece):
    monkeypatch.setattr(languages, "PIECE", piece)
    found = [t for _, t in texts() if t]
    padded = [f" {t.lower()}    ".encode() for t in found]
    data = np.frombuffer(b"".join(padded), np.uint8)
    offsets = np.cumsum([0, *map(len, padded)])
    _, count = languages.summed(data, offsets, model.table)
    chance = model.scores(data, offsets)
    for i, t in enumerate(found):
        grams = _plain_grams(t)
        assert count[i] == len(grams)
        mean = sum((model.table[_bucket(g)].astype(float) for g in grams), np.zeros(len(model.languages)))
        x = (mean / max(1, len(grams)) + model.bias) / model.temperature
        e = [math.exp(v - max(x)) for v in x]
        assert chance[i] == pytest.approx([v / sum(e) for v in e], abs=1e-5)


def test_held_out_texts_are_named_rightly(docs, model):
    got = languages.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn(
        "aside", languages.held_out()).collect()
    aside = [r for r in got if r.aside]
    assert 0.25 < len(aside) / len(got) < 0.42
    assert np.mean([r.lang_pred == r.lang for r in aside]) > 0.97
    taken = [r for r in aside if not r.rejected]
    assert np.mean([r.lang_pred == r.lang for r in taken]) >= languages.RIGHT and len(taken) > 0.9 * len(aside)
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.score for r in aside]) == pytest.approx(np.mean([r.lang_pred == r.lang for r in aside]), abs=0.05)


def test_other_columns_and_reruns_change_nothing(docs, model):
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn(
        "doc_id", F.col("doc_id") + 7)
    a = {r.doc_id: r[1:] for r in languages.predict_languages(docs, model).collect()}
    b = {r.doc_id - 7: r[1:] for r in languages.predict_languages(changed, model).collect()}
    assert a == b
    again = languages.learn_languages(docs.repartition(7), ~languages.held_out())
    assert np.allclose(again.table, model.table) and again.languages == model.languages


def test_texts_that_are_held_out_teach_nothing(docs):
    lying = docs.withColumn("lang", F.when(languages.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in languages.learn_languages(lying, ~languages.held_out()).languages


def test_calibration():
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, 4000)
    right = rng.random(4000) < 0.8
    logits = np.zeros((4000, 3))
    logits[np.arange(4000), np.where(right, labels, (labels + 1) % 3)] = 30  # far too sure
    temperature, least = languages.calibrate(logits, labels)
    assert languages.softmax(logits / temperature).max(axis=1).mean() == pytest.approx(0.8, abs=0.03)
    assert least == 1.0  # 0.8 of the accepted would be right, not 0.99
    logits[right] *= 2
    least = languages.calibrate(logits, labels)[1]
    accepted = languages.softmax(logits / languages.calibrate(logits, labels)[0]).max(axis=1) >= least
    assert right[accepted].mean() >= 0.99 and accepted.sum() == right.sum()


def test_odd_texts(spark, model):
    rows = [*texts(), (600, "123 456 !!"), (601, "Ä"), (602, "the of and to in " * 30_000), (None, "the of and is in")]
    got = {r.doc_id: r for r in languages.predict_languages(table(spark, rows), model).collect()}
    for i, t in rows:
        known = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not known), i
        assert got[i].rejected if not known else 0 < got[i].score <= 1
    assert got[602].lang_pred == got[None].lang_pred == "en"


def test_little_or_nothing_to_learn_from(spark):
    none = languages.learn_languages(empty(spark), ~languages.held_out())
    assert none is None
    got = languages.predict_languages(table(spark, [(1, "abc"), (2, None)]), none).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in got} == {("und", 0.0, True)}
    one = spark.createDataFrame([(2, "ab cd", "q"), (2, "ab cd", "q"), (3, None, "q"), (5, "x", None)],
                                "doc_id long, text string, lang string")
    model = languages.learn_languages(one, F.lit(True))
    assert model.languages == ["q"]
    assert {r.lang_pred for r in languages.predict_languages(one, model).collect()} == {"q", "und"}
    assert languages.predict_languages(empty(spark), model).count() == 0
