"""License scans: winnowed fingerprints pick templates, banded alignment measures them.

Templates (license names and notices; a parameter) are hashed into word 3-grams
and winnowed: of each 3 neighbouring hashes the least is kept (the last of
equals), so any 5 words in common share a fingerprint. The inverted index of
these (its size is that of the templates, not of the data) is sent to every
task. Fingerprints of a document that hit the index are put together by template
and diagonal; around each such cluster a local alignment in a band of
``BAND`` words on either side tells the span, the template words matched in
order and their share, the coverage. Words are compared in lower case without
punctuation around them.

A match is reported from ``min_coverage`` on; of matches of one template that
overlap the best stays, and the text between matches is aligned again as long as
hits are left there. Null text and texts without words match nothing.
Repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmere.llm._common import as_bytes, slices
from glyphmere.llm._shingles import shingles

GRAM, RUN, BAND = 3, 3, 8
#: Usual license notices, by SPDX id.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT-notice": "Released under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_EDGE = b".,;:()[]{}\"'`!?*#$%&|<>-_=/\\"


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's number of words."""
    number: dict[bytes, int] = {}
    ids, lengths = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.lower().split()
        lengths[k] = len(words)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.strip(_EDGE)) for w in number), np.uint64, len(number))
    return (table[np.concatenate(ids)] if ids else np.zeros(0, np.uint64)), lengths


def winnowed(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places (in ``words``) of texts that follow each other; texts of fewer than 5 words keep all of theirs."""
    grams = shingles(words, GRAM)
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(len(words))
    grams[left < GRAM] = np.iinfo(np.uint64).max
    if len(words) < GRAM + RUN - 1:
        at = np.flatnonzero(left >= GRAM)
        return grams[at], at
    runs = np.lib.stride_tricks.sliding_window_view(grams, RUN)
    place = np.arange(len(runs)) + (RUN - 1 - runs[:, ::-1].argmin(axis=1))
    whole = left[: len(runs)] >= GRAM + RUN - 1
    short = np.flatnonzero((np.repeat(lengths, lengths) < GRAM + RUN - 1) & (left >= GRAM))
    at = np.unique(np.concatenate([place[whole], short]))
    return grams[at], at


class Index:
    """Templates as word hashes, and their fingerprints sorted: hash, template, place."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        words, self.lengths = normal_words([templates[n].encode() for n in self.names])
        first = np.cumsum(self.lengths) - self.lengths
        self.words = [words[a : a + n] for a, n in zip(first, self.lengths)]
        h, at = winnowed(words, self.lengths)
        which = np.searchsorted(first, at, side="right") - 1
        order = np.argsort(h, kind="stable")
        self.hash, self.template, self.place = h[order], which[order], (at - first[which])[order]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in ``h``, entry of the index) with equal fingerprints."""
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        return np.repeat(some, n), np.repeat(hi[some] - np.cumsum(n), n) + np.arange(n.sum())


def aligned(a: np.ndarray, b: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment of template ``a`` with text ``b`` near b = a + diagonal: (matched words, first, end in b). Match 2, mismatch and gap -1."""
    best = (0, 0, 0, 0)
    m, n = len(a), len(b)
    above: dict[int, tuple[int, int, int]] = {}  # j -> score, matched, start, for the row before
    for i in range(m):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(n, i + diagonal + band + 1)):
            s, k, start = above.get(j - 1, (0, 0, j))
            equal = a[i] == b[j]
            cell = (s + 2, k + 1, start if s > 0 else j) if equal else (s - 1, k, start)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[j] = cell
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def bands(diagonals: list[int]) -> list[int]:
    """Middles of bands that hold all of the sorted diagonals; those within ``BAND`` of each other are one cluster, with a band each ``BAND`` words if it is wide."""
    groups: list[list[int]] = []
    for d in diagonals:
        if groups and d - groups[-1][1] <= BAND:
            groups[-1][1] = d
        else:
            groups.append([d, d])
    return [d for lo, hi in groups for d in (range(lo, hi + BAND, BAND) if hi - lo > 2 * BAND else [(lo + hi) // 2])]


def scan_text(index: Index, words: np.ndarray, found: list[tuple[int, int, int]], min_coverage: float) -> list[tuple[int, float, int, int, int]]:
    """template, coverage, first, end (words of the text), matched. found: template, its place, the text's place of each hit."""
    by: dict[int, list[tuple[int, int]]] = {}
    for t, p, at in found:
        by.setdefault(t, []).append((p, at))
    out = []
    for t, hits in sorted(by.items()):
        template = index.words[t].tolist()
        matches: list[tuple[int, int, int]] = []
        todo = [(0, len(words), hits)]
        while todo:  # parts of the text between matches, with the hits in them
            left, right, hits = todo.pop()
            tried = []
            for d in bands(sorted({at - p for p, at in hits})):
                begin = max(left, d - 2 * BAND)
                piece = words[begin : max(begin, min(right, d + len(template) + 2 * BAND))]
                matched, first, end = aligned(template, piece.tolist(), d - begin)
                if matched >= min_coverage * len(template):
                    tried.append((matched, begin + first, begin + end))
            kept: list[tuple[int, int, int]] = []
            for matched, first, end in sorted(tried, key=lambda x: (-x[0], x[1])):
                if all(end <= a or first >= b for _, a, b in kept):
                    kept.append((matched, first, end))
            matches += kept
            edges = [left, *(x for _, a, b in sorted(kept, key=lambda x: x[1]) for x in (a, b)), right]
            for a, b in zip(edges[::2], edges[1::2]) if kept else ():
                inside = [(p, at) for p, at in hits if a <= at and at + GRAM <= b]
                if inside:
                    todo.append((a, b, inside))
        out += [(t, matched / len(template), first, end, matched) for matched, first, end in sorted(matches, key=lambda x: x[1])]
    return out


def scan(df: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, template, coverage, first_word, end_word, matched_words: a row for each match."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 8 << 20):
            words, lengths = normal_words([t or b"" for t in as_bytes(batch.column("t"))])
            first = np.cumsum(lengths) - lengths
            h, at = winnowed(words, lengths)
            hit, entry = index.hits(h)
            by: dict[int, list] = {}
            doc = np.searchsorted(first + lengths, at[hit], side="right")
            for d, e, p in zip(doc.tolist(), entry.tolist(), at[hit].tolist()):
                by.setdefault(d, []).append((int(index.template[e]), int(index.place[e]), p - int(first[d])))
            rows = [(d, index.names[t], c, a, b, m) for d, found in sorted(by.items()) for t, c, a, b, m in scan_text(index, words[first[d] : first[d] + lengths[d]], found, min_coverage)]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])], ["i", "template", "coverage", "first_word", "end_word", "matched_words"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, template string, coverage double, first_word long, end_word long, matched_words long").withColumnRenamed("i", id_col)
