"""License scans: normalised lines, paragraphs and whole texts against templates by Dice over word bigrams.

Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z.  A unit can only reach the wanted
Dice coefficient with templates whose number of distinct bigrams lies between bounds given by its own, so other templates are
passed over; a unit in which too few bigrams of any template occur (counted for whole blocks at once) is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import ALNUM, blocks, lower_ascii, shingle_hashes, span_hashes, text_buffer, words
from quillspark.session import ready

#: Names of licences and the public texts that state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-Rights-Reserved", "All rights reserved."),
)


def bigrams(data: bytes) -> frozenset[tuple[bytes, bytes]]:
    raw = lower_ascii(np.frombuffer(data, np.uint8))
    starts, ends, _ = words(raw, np.array([0, len(raw)]), ALNUM)
    low = raw.tobytes()
    w = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return frozenset(zip(w, w[1:], strict=False))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        self.percent = percent
        self.templates = sorted(((len(g), name, g) for name, text in templates for g in [bigrams(text.encode())] if g), key=lambda x: (x[0], x[1], sorted(x[2])))
        hashes = []
        for _, text in templates:
            raw = lower_ascii(np.frombuffer(text.encode(), np.uint8))
            starts, ends, _ = words(raw, np.array([0, len(raw)]), ALNUM)
            hashes.append(shingle_hashes(span_hashes(raw, starts, ends), 2))
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        least = min((t[0] for t in self.templates), default=1)
        self.hits = max(1, -(-percent * least // (200 - percent)))  # fewest shared bigrams of any match

    def matches(self, data: bytes) -> list[tuple[int, int, str]]:
        """(shared bigrams, both sets' sizes, licence) of every template at least percent alike."""
        g = bigrams(data)
        found = []
        for size, name, t in self.templates:
            # 2 * shared / (a + b) >= p needs min(a, b) >= p * max(a, b) / (2 - p)
            if (200 - self.percent) * min(size, len(g)) < self.percent * max(size, len(g)):
                continue
            shared = len(g & t)
            if 200 * shared >= self.percent * (size + len(g)):
                found.append((shared, size + len(g), name))
        return found

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[dict[str, tuple[int, int]]]:
        """For each text the licences found and the best (shared, sizes) of each."""
        out: list[dict[str, tuple[int, int]]] = [{} for _ in range(len(offsets) - 1)]
        low = lower_ascii(raw)
        starts, ends, bounds = words(low, offsets, ALNUM)
        pair = shingle_hashes(span_hashes(low, starts, ends), 2)
        hit = np.isin(pair, self.known)
        sums = np.r_[0, np.cumsum(hit)]
        breaks = np.flatnonzero(raw == 0x0A)
        double = breaks[:-1][np.diff(breaks) == 1] if len(breaks) > 1 else breaks[:0]
        data = raw.tobytes()
        for units in (breaks + 1, double + 2, breaks[:0]):  # lines, paragraphs, whole texts
            edge = np.unique(np.r_[offsets[:-1], units])
            edge = edge[edge < len(raw)]
            last = np.r_[edge[1:], len(raw)]
            a, b = np.searchsorted(starts, edge), np.searchsorted(starts, last)
            enough = (b - a >= 2) & (sums[np.minimum(np.maximum(b - 1, a), len(pair))] - sums[np.minimum(a, len(pair))] >= self.hits)
            docs = np.searchsorted(offsets, edge, "right") - 1
            for k in np.flatnonzero(enough).tolist():
                for shared, both, name in self.matches(data[edge[k] : last[k]]):
                    old = out[docs[k]].get(name)
                    if old is None or shared * old[1] > old[0] * both:
                        out[docs[k]][name] = (shared, both)
        return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, licenses (names found, sorted and comma-joined; empty if none), best_license and
    best_dice (of the best unit; null if none).

    Units are lines, paragraphs (cut at empty lines) and the whole text. Null and empty texts have none; repeated rows are scanned each.
    Texts and templates of fewer than two words match nothing.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            found: list[dict[str, tuple[int, int]]] = []
            for a, b in blocks(offsets):
                found += scanner.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            best = [min(f.items(), key=lambda x: (-x[1][0] / x[1][1], x[0])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array([x and x[0] for x in best], pa.string()), pa.array([x and 2 * x[1][0] / x[1][1] for x in best], pa.float64())], names=["doc_id", "licenses", "best_license", "best_dice"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, licenses string, best_license string, best_dice double")
