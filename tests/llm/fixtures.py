"""Small tables with the cases every operator must stand: nulls, empties, copies, ties, long texts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, size string"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() if i % 11 == 0 else w)
        out.append(".\n" if i % 33 == 32 else ". " if i % 11 == 10 else " ")
    return "".join(out).strip()


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng, words = random.Random(seed), vocabulary(seed)
    passage = prose(rng, words, 60)
    base = [prose(rng, words, rng.randint(5, 200)) for _ in range(25)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[3]) for i in range(6)]  # exact copies
    for i in range(12):  # near copies of one text, each with one word changed
        w = base[4].split(" ")
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{prose(rng, words, 20)} {passage} {prose(rng, words, 15 + i)}") for i in range(8)]
    rows += [(400 + i, f"{prose(rng, words, 12)}\nAccept all cookies on this site now {i}.\n{prose(rng, words, 30)}")
             for i in range(14)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "one two"), (505, "ONE two"),
             (506, "a " * 300), (507, prose(rng, words, 6000)), (508, "x" * 5000), (509, "é ß \x0b\x0c z"),
             (510, "%%% *** ### " * 40), (511, "same line\n" * 50),
             (512, "ab" * 150), (513, "Licensed under the Apache License, Version 2.0. " + base[0])]
    return rows


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with columns whose names clash with the operators' own."""
    full = [(i, t, "en", None if n % 7 == 0 else f"s{n % 4}", None if t is None else len(t), "x", "y", "z")
            for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
