"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of ASCII letters and digits or other non-ASCII characters, lower
case. A template of s word shingles belongs to the class of the next power of
two c; documents are cut into blocks of c shingles, and every two neighbouring
blocks are one window, so a passage of s shingles lies whole in some window.
Such a window has a Jaccard similarity of at least ``CONTAINED * s / (2 * c)``,
a fifth or more, to the template. Each of ``BANDS`` bands holds one minimum, so
the chance that all bands miss is ``0.8 ** 32`` at most, below one in a
thousand. A shared band retrieves the template for the window; the share of its
shingles that the window has decides.

Licenses share much of their wording. A license whose shingles, as far as the
window has them, all stand in a better one that is found in the same place has
nothing that speaks for it and is left out; better is the one with more
shingles found less those missing, so a whole text beats its own opening and
the version that is there beats the one whose number is missing.

Each document is scanned where it lies: nothing is shuffled. Templates are a
parameter and travel with the task.

Cases: null and empty texts match nothing; a text or template of fewer words
than a shingle is one shingle; a license found in several windows is one row
with its best window; repeated rows get a row each; long texts are cut into
windows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.license_texts import TEXTS
from evenkeel.llm.text import BYTES, TOKENS, chunks, keyed, mix

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32


def _gnu(work: str, kind: str, version: str) -> str:
    """The notice that the GNU licenses ask for."""
    return (f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU "
            f"{kind} Public License as published by the Free Software Foundation; either version {version} of the "
            "License, or (at your option) any later version.")


def _cc(kind: str) -> str:
    return f"This work is licensed under a Creative Commons Attribution-{kind} 4.0 International License."


# Wording of public license statements, by SPDX name.
STATEMENTS = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("program", "General", "2"),
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL-2.0": [_gnu("library", "Library General", "2")],
    "LGPL-2.1": [_gnu("library", "Lesser General", "2.1")],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License as published by the Free "
                 "Software Foundation", _gnu("library", "Lesser General", "3")],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free "
                 "Software Foundation", _gnu("program", "Affero General", "3")],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _cc("ShareAlike")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _cc("NonCommercial")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _cc("NoDerivatives")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _cc("NonCommercial-ShareAlike")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _cc("NonCommercial-NoDerivatives")],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or "
                "neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Statements first, then the whole text.
TEMPLATES = {name: [*STATEMENTS.get(name, []), *([TEXTS[name]] if name in TEXTS else [])]
             for name in [*STATEMENTS, *(n for n in TEXTS if n not in STATEMENTS)]}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = BYTES.table[_LOWER]
_BAND_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def license_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, one document after another, and their places."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, places = _word_places(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sums = TOKENS.sums(BYTES.runs(BYTES.sums(_TABLE[data]), starts, ends))
    counts = np.diff(places)
    each = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    out = np.concatenate([[0], np.cumsum(each)])
    first = np.arange(out[-1]) - np.repeat(out[:-1], each) + np.repeat(places[:-1], each)
    last = np.minimum(first + SHINGLE, np.repeat(places[1:], each))
    return TOKENS.runs(sums, first, last) + (last - first).astype(np.uint64), out


def _bands(values: np.ndarray) -> Iterator[np.ndarray]:
    for salt in _BAND_SALTS:
        x = (values ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        yield x * np.uint64(0xD6E8FEB86659FD93)


class Templates:
    """Shingles of each template and, by class, the minima that retrieve it."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names, self.sets = [], []
        by_class: dict[int, list[int]] = {}
        for name, versions in texts.items():
            for version in versions:
                body = np.frombuffer(version.encode(), np.uint8)
                shingles = np.unique(license_shingles(body, np.array([0, len(body)]))[0])
                if len(shingles):
                    block = 1 << int(len(shingles) - 1).bit_length()
                    by_class.setdefault(block, []).append(len(self.sets))
                    self.names.append(name)
                    self.sets.append(shingles)
        #: for each class: template numbers and their minima, a row for each band
        self.classes = {
            block: (np.array(numbers), np.array([[b.min() for b in _bands(self.sets[i])] for i in numbers]).T)
            for block, numbers in by_class.items()}

    def scan(self, shingles: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Document, template, first shingle of the window and containment of each match that stands."""
        if not len(shingles):
            return []
        counts = np.diff(places)
        bands = list(_bands(shingles))
        found = []
        for block, (numbers, minima) in self.classes.items():
            blocks = -(-counts // block)
            doc = np.repeat(np.arange(len(counts)), blocks)
            within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            first = places[doc] + within * block
            next_ = np.append(doc[1:] == doc[:-1], False)
            hit = np.zeros((len(numbers), len(doc)), bool)
            for values, wanted in zip(bands, minima, strict=True):
                low = np.minimum.reduceat(values, first)
                low = np.where(next_, np.minimum(low, np.append(low[1:], low[-1:])), low)
                hit |= low[None, :] == wanted[:, None]
            for i, w in zip(*np.nonzero(hit), strict=True):
                d, number = doc[w], numbers[i]
                window = shingles[first[w]:min(first[w] + 2 * block, places[d + 1])]
                template = self.sets[number]
                held = np.intersect1d(window, template)
                if len(held) / len(template) >= CONTAINED:
                    found.append((int(d), int(number), int(first[w] - places[d]), len(window), held))
        return self._standing(found)

    def _standing(self, found: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int, int, float]]:
        """Matches with a shingle that no better license in an overlapping window has."""
        by_doc: dict[int, list] = {}
        for d, number, at, width, held in found:
            better = 2 * len(held) - len(self.sets[number])
            by_doc.setdefault(d, []).append((-better, self.names[number], at, number, width, held))
        out = []
        for d, matches in by_doc.items():
            matches.sort(key=lambda m: m[:4])
            kept: list[tuple] = []
            for _, name, at, number, width, held in matches:
                if not any(name != n and at < a + w and a < at + width and np.isin(held, self.sets[i]).all()
                           for n, a, i, w in kept):
                    kept.append((name, at, number, width))
                    out.append((d, number, at, len(held) / len(self.sets[number])))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id``, ``license``, ``containment`` and ``first_shingle`` of the best window.

    One row for each document and license that is found in it.
    """
    texts = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, _, data, offsets in chunks(batch):
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for d, number, at, share in known.scan(*license_shingles(data, offsets)):
                    key = (d + first, known.names[number])
                    best[key] = max(best.get(key, (0.0, 0)), (share, -at))
                rows = [(doc_ids[d], name, share, -at) for (d, name), (share, at) in best.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)],
                    names=["doc_id", "license", "containment", "first_shingle"])

    return keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "body").mapInArrow(
        work, "doc_id long, license string, containment double, first_shingle long")
