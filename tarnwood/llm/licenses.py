"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Every template has windows of its own length: WIDE times its words, starting every quarter of that, so one window
always holds an occurrence whole. A window's signature is the least value of each of HASHES functions over its shingles
of min(5, words of the template) words, taken from block minima of quarters. Bands are single rows: a window of similarity s
collides with its template with probability 1 - (1 - s)^16, which is 0.99998 at s = 0.5. A short template has few
shingles for its words; where a window that holds it whole is of less than ALIKE to it, every window with one of its shingles is a candidate, without
bands, so nothing is lost. Candidates are verified on the exact share of the template's shingles that the
window and the quarter after it hold, CONTAINED or more.

All windows of all texts are hashed, in arrays over a batch of texts, and nothing is shuffled. Templates are few; their tables are broadcast, in
blocks of TEMPLATES a pass.

Defined cases. Null or empty text: no match. Texts stand end to end in a batch for retrieval; a match is verified within one text. Repeated rows: reported each; null ids: searched and reported as null. Very long texts: searched whole. Overlapping
matches of one license in a document are one match, placed where most shingles are (ties: the first). Empty tables: no rows. Other columns, clashing names included, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, rows_to_batch, small_batches, windows, word_hashes

HASHES, WIDE, CONTAINED, SHINGLE, TEMPLATES, ALIKE = 16, 4 / 3, 0.8, 5, 500, 0.5
_RNG = np.random.RandomState(41)
_A = (_RNG.randint(0, 2**31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.randint(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_EDGES = b".,;:!?\"'()[]{}<>|*%&#$@+=_~^/\\`-"

#: Notices in common use, by license.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, without marks at their edges."""
    return [s for w in text.lower().split() if (s := w.strip(_EDGES))]


@dataclass
class Template:
    license: str
    k: int  # words of a shingle
    step: int  # a quarter of its windows, in words
    shingles: np.ndarray  # sorted, distinct


def templates_of(notices) -> list[Template]:
    out = []
    for name, text in notices:
        words = words_of(text.encode())
        if words:
            k = min(SHINGLE, len(words))
            s = np.unique(windows(word_hashes(words), k))
            out.append(Template(name, k, max(1, -(-int(WIDE * len(words)) // 4)), s))
    return out


def _values(shingles: np.ndarray, i: int) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32) * _A[i] + _B[i]


class Bands:
    """Templates of one shingle width and window step: for each hash, a table of 2^16 flags on the value's top bits."""

    def __init__(self, some: list[tuple[int, Template]]):
        self.some, self.k, self.step = some, some[0][1].k, some[0][1].step
        short = [len(t.shingles) < ALIKE * 4 * self.step for _, t in some]
        self.short, self.long = np.flatnonzero(short).tolist(), np.flatnonzero(~np.array(short))
        self.least = np.array([[_values(some[x][1].shingles, i).min() for i in range(HASHES)] for x in self.long], dtype=np.uint32).reshape(-1, HASHES)
        self.flags = np.zeros((HASHES, 1 << 16), dtype=bool)
        for i in range(HASHES):
            self.flags[i, self.least[:, i] >> 16] = True

    def candidates(self, s: np.ndarray, values: list[np.ndarray]) -> list[tuple[int, int]]:
        """(template, first shingle of the window) for each window and template that share a band, or a shingle of a short one; values: of each hash over all shingles s."""
        out = []
        for x in self.short:
            block = np.flatnonzero(np.isin(s, self.some[x][1].shingles)) // self.step
            block = np.unique(block[:, None] - np.arange(5))  # a window and the quarter after it
            out += [(x, b * self.step) for b in block[block >= 0].tolist()]
        if not len(self.long):
            return out
        n = len(s)
        starts = np.arange(0, max(1, n), self.step)
        hit = np.zeros(len(starts), dtype=bool)
        signature = np.empty((HASHES, len(starts)), dtype=np.uint32)
        for i in range(HASHES):
            block = np.minimum.reduceat(values[i], starts)
            least = block.copy()
            for j in range(1, min(4, len(block))):  # a window is four blocks
                np.minimum(least[:-j], block[j:], out=least[:-j])
            signature[i] = least
            hit |= self.flags[i, least >> 16]
        at = np.flatnonzero(hit)
        which, window = np.nonzero((self.least[:, :, None] == signature[None, :, at]).any(axis=1))
        return out + list(zip(self.long[which].tolist(), starts[at[window]].tolist(), strict=True))


class Scanner:
    def __init__(self, templates: list[Template]):
        self.templates = templates
        groups: dict[tuple[int, int], list[tuple[int, Template]]] = {}
        for i, t in enumerate(templates):
            groups.setdefault((t.k, t.step), []).append((i, t))
        self.bands = [Bands(g) for _, g in sorted(groups.items())]

    def scan(self, text: bytes) -> dict[str, tuple[int, int, float]]:
        """license -> (matches, first word of the best, its share)."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[bytes]) -> list[dict[str, tuple[int, int, float]]]:
        """For each text; windows run over all texts end to end, verification stays within one text."""
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        begins = ends - [len(w) for w in words]
        h = word_hashes([w for ws in words for w in ws])
        found: list[dict[str, list[tuple[int, int, float]]]] = [{} for _ in texts]
        k, s, values = 0, h, []
        for b in self.bands:
            if len(h) < b.k:
                continue
            if b.k != k:
                k, s = b.k, windows(h, b.k)
                values = [_values(s, i) for i in range(HASHES)]
            for x, start in b.candidates(s, values):
                t, stop = b.some[x][1], start + 5 * b.step
                for d in range(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(begins, stop, "left"))):
                    low, high = max(start, int(begins[d])), min(stop, int(ends[d]) - k + 1)
                    if low >= high:
                        continue
                    there = s[low:high]
                    inside = np.isin(there, t.shingles)
                    share = len(np.unique(there[inside])) / len(t.shingles)
                    if share >= CONTAINED:
                        first = low - int(begins[d]) + int(np.flatnonzero(inside)[0])
                        found[d].setdefault(t.license, []).append((first, first + len(t.shingles) + k, share))
        return [{name: self.best(some) for name, some in hits.items()} for hits in found]

    @staticmethod
    def best(some: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        some.sort()
        n, end = 0, -1
        for a, z, _ in some:
            n += a >= end
            end = max(end, z) if a < end else z
        first, _, share = min(some, key=lambda m: (-m[2], m[0]))
        return n, first, share


def scan(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_matches, first_word, share: a row for each document and license it holds."""
    small_batches(docs.sparkSession)
    kind = "doc_id long, license string, n_matches long, first_word long, share double"
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("n_matches", pa.int64()), ("first_word", pa.int64()), ("share", pa.float64())])
    by_name = sorted(notices)  # a license's templates stay in one block
    blocks: list[list] = [[]]
    for i, x in enumerate(by_name):
        if len(blocks[-1]) >= TEMPLATES and x[0] != by_name[i - 1][0]:
            blocks.append([])
        blocks[-1].append(x)
    out = docs.sparkSession.createDataFrame([], kind)
    for block in blocks:

        def run(batches, block=block):
            scanner = Scanner(templates_of(block))
            for b in batches:
                texts = b.column(1).cast(pa.binary()).to_pylist()
                found = scanner.scan_all(texts)
                yield rows_to_batch([(d, name, *m) for d, hits in zip(b.column(0).to_pylist(), found, strict=True) for name, m in sorted(hits.items())], schema)

        out = out.unionByName(id_and_text(docs, id_col, text_col).mapInArrow(run, kind))
    return out


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def phrase(text: str) -> re.Pattern:
    """A notice as a pattern of its words, for tests."""
    return re.compile(rb"[^\w]+".join(map(re.escape, words_of(text.encode()))))
