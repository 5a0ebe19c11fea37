"""License scans: which license texts a document contains, and where.

Words are `\\w+` runs of the lower-cased text. Templates are grouped by their number of five-word shingles into
classes c = 8, 16, 32, ...; a document's shingle positions are covered by overlapping windows of 2c positions,
c apart, so a template's passage lies whole in one of them. Each window has a MinHash signature of BANDS
one-row bands; a template whose containment in the window is at least LEAST has a Jaccard similarity of at least
LEAST / 4 with it if it has over c / 2 different shingles, so that some band meets it with probability at least
1 - (1 - LEAST / 4) ** BANDS = 0.9992. Templates with fewer (the shortest, and those that repeat themselves) are looked
up without bands: a window meets one if it holds any of its shingles. Windows that meet a template are then verified
by the exact share of the template's shingles that they contain.

A template of fewer than five words is one shingle of its own length, looked up in a pass for that length. The scan
is a map over documents without a shuffle. Templates are a query set, given in the program: they are dealt to the
tasks in blocks of at most BLOCK, one pass over the documents for each block. Words are those of the text as it is,
each in small letters, so places are exact also where letters grow when they are lowered.

Nulls: a null text is empty and has no license; templates without words match nothing. doc_id may be null or
repeat: each row is scanned. Other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm import words as W
from docgrid.llm.common import text_or_empty

SHINGLE = 5
LEAST = 0.8
BANDS = 32
SMALLEST = 8
BLOCK = 2000

# Public license notices, as their authors ask for them to be stated.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


class Scanner:
    """Signatures of a block of templates, by the length of a shingle and by class."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, bands: int = BANDS) -> None:
        rng = np.random.default_rng(11)
        self.least, self.bands = least, bands
        self.odd = rng.integers(0, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands, np.uint64)
        self.by_size: dict[int, dict[int, list[tuple[str, np.ndarray, int]]]] = {}
        for name, text in templates.items():
            words = W.lowered(text)
            if words:
                size = min(SHINGLE, len(words))
                own = np.unique(W.runs(W.hashes(words), size))
                places = len(words) - size + 1
                at = SMALLEST
                while at < places:
                    at *= 2
                self.by_size.setdefault(size, {}).setdefault(at, []).append((name, own, places))
        # templates with too few different shingles for the bands: size to (sorted shingles, their owners), owners as (class, template)
        self.rare: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, tuple[str, np.ndarray, int]]]]] = {}
        for size, classes in self.by_size.items():
            rare = [(c, t) for c, found in classes.items() for t in found if 2 * len(t[1]) <= c]
            if rare:
                shingles, owner = np.concatenate([t[1] for _, t in rare]), np.repeat(np.arange(len(rare)), [len(t[1]) for _, t in rare])
                order = np.argsort(shingles, kind="stable")
                self.rare[size] = shingles[order], owner[order], rare
            self.by_size[size] = {c: kept for c, found in classes.items() if (kept := [t for t in found if 2 * len(t[1]) > c])}
        # the bands of a class's templates: sorted (band, value) keys and the templates that have them
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size, classes in self.by_size.items():
            for c, found in classes.items():
                if found:
                    keys = np.concatenate([self._banded(self._permuted(own).min(axis=1)[:, None])[:, 0] for _, own, _ in found])
                    order = np.argsort(keys, kind="stable")
                    self.index[size, c] = keys[order], np.repeat(np.arange(len(found)), bands)[order]

    def _permuted(self, shingles: np.ndarray) -> np.ndarray:
        return shingles[None, :] * self.odd[:, None] + self.add[:, None]

    def _banded(self, values: np.ndarray) -> np.ndarray:
        """Keys of the least values of each band (a row of values), told apart by band."""
        return W.mixed(values + np.arange(1, len(values) + 1, dtype=np.uint64)[:, None] * W.STEP)

    def _retrieved(self, size: int, c: int, windows: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(template, windows that share a band with it) of a class: windows are looked up, templates aren't gone through."""
        known, owner = self.index[size, c]
        keys = self._banded(windows)
        first = np.searchsorted(known, keys)
        first[first == len(known)] = 0
        met: dict[int, set[int]] = {}
        for band, at in np.argwhere(known[first] == keys).tolist():
            last = np.searchsorted(known, keys[band, at], side="right")
            for k in owner[first[band, at] : last].tolist():
                met.setdefault(k, set()).add(at)
        for k in sorted(met):
            yield k, sorted(met[k])

    def _looked_up(self, size: int, shingles: np.ndarray) -> Iterator[tuple[int, tuple[str, np.ndarray, int], list[int]]]:
        """(class, template, windows that hold a shingle of it) of the templates without bands."""
        known, owner, rare = self.rare[size]
        first, last = np.searchsorted(known, shingles), np.searchsorted(known, shingles, side="right")
        places: dict[int, list[int]] = {}
        for p in np.flatnonzero(first < last).tolist():
            for k in owner[first[p] : last[p]].tolist():
                places.setdefault(k, []).append(p)
        for k, found in places.items():
            c, template = rare[k]
            own = np.array(found) // c
            met = np.unique(np.concatenate([own - 1, own]))
            yield c, template, met[met >= 0].tolist()

    def find(self, words: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, word after the last) of each template that some window contains; its best window."""
        best: dict[str, tuple[str, float, int, int]] = {}
        for size, classes in self.by_size.items():
            shingles = W.runs(words, size)
            if not len(shingles):
                continue
            if size in self.rare:
                for c, template, met in self._looked_up(size, shingles):
                    self._verify(best, shingles, size, c, template, met)
            blocks, c = None, SMALLEST
            while c <= max(classes, default=0):
                if blocks is None:
                    starts = np.arange(0, len(shingles), c)
                    blocks = np.stack([np.minimum.reduceat(shingles * a + b, starts) for a, b in zip(self.odd, self.add, strict=True)])
                else:
                    blocks = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], 2), axis=1)
                if c in classes:
                    windows = np.minimum(blocks, np.append(blocks[:, 1:], blocks[:, -1:], axis=1))
                    for k, met in self._retrieved(size, c, windows) if classes[c] else ():
                        self._verify(best, shingles, size, c, classes[c][k], met)
                c *= 2
        return [best[k] for k in sorted(best)]

    def _verify(self, best: dict[str, tuple[str, float, int, int]], shingles: np.ndarray, size: int, c: int, template: tuple[str, np.ndarray, int], met: list[int]) -> None:
        name, own, _ = template
        for at in met:
            part = shingles[at * c : at * c + 2 * c]
            inside = np.isin(part, own)
            share = len(np.unique(part[inside])) / len(own)
            if share >= self.least and share > best.get(name, ("", 0.0))[1]:
                place = np.flatnonzero(inside) + at * c
                best[name] = (name, share, int(place[0]), int(place[-1]) + size)


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """A row per document row and license: doc_id, license, containment, start, end (code points of the text)."""
    items = sorted((TEMPLATES if templates is None else templates).items())
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, containment double, start long, end long"
    texts, parts = documents.select("doc_id", text_or_empty().alias("text")), []
    for at in range(0, max(1, len(items)), BLOCK):
        scanner = Scanner(dict(items[at : at + BLOCK]), least, bands)
        parts.append(texts.mapInArrow(_runner(scanner), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _runner(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scanner.find(W.hashes(W.lowered(text)))
                spans = W.spans(text) if found else []
                for name, share, first, after in found:
                    for column, value in zip(rows, (doc_id, name, share, spans[first][0], spans[after - 1][1]), strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["doc_id", "license", "containment", "start", "end"])

    return run


