"""License scans (3): MinHash bands over overlapping windows retrieve templates, exact containment decides.

A template is its sequence of 3-word shingles (``t`` of them). It is found where ``t`` consecutive
shingles of a text hold at least ``containment`` of its distinct shingles. Templates of similar
length share windows of ``t + step`` shingles at every ``step``-th place, so any such span lies inside
a window; the least Jaccard similarity this leaves between window and template fixes the number of
bands for which they collide with probability ``PROBABILITY``. Only windows that collide are looked
at, on the words themselves: of the spans of ``t`` shingles that contain enough, the best ones that do not overlap are
reported, so a notice that a text repeats is reported as often. Texts with fewer template shingles than any template needs are passed
over by one look-up each. One scan; the templates, a parameter of the driver, are broadcast.

Defined cases: null, empty or short texts and templates without a shingle match nothing; of overlapping spans of a
template the one of best containment, then the first, is reported; repeated documents give equal rows; other
columns are passed on in a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from railflow.llm import textscan as ts

CONTAINMENT = 0.8
PROBABILITY = 0.9999
SHINGLE = 3
ROWS = 1

#: Notices of well-known licences and their opening or operative sentences, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "AGPL-3.0-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "BSD-3-Clause-names": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-notice": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software.",
}
#: Identifiers of the tags that source files carry.
SPDX = ("0BSD", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}

MATCH = "licenses array<struct<name: string, containment: double, start: bigint, end: bigint>>"


def bands_for(similarity: float, probability: float = PROBABILITY, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima so that sets of that similarity collide with the probability."""
    miss = 1 - similarity**rows
    return 1 if miss <= 0 else max(1, math.ceil(math.log(1 - probability) / math.log(miss)))


class _Shingles:
    """Words of a slice and the hashes of their shingles: ``h[i]`` begins at word ``at[i]``; ``off`` per text."""

    def __init__(self, s: ts.Slice):
        self.low = ts.LOWER[s.buf]
        self.starts, self.ends = s.runs(ts.WORD_BYTES[s.buf])
        words = ts.span_hash(self.low, self.starts, self.ends)
        word_off = s.per_text(self.starts)
        self.h, self.at = ts.windows(words, word_off, SHINGLE)
        self.off = np.searchsorted(self.at, word_off).astype(np.int64)

    def text(self, i: int) -> bytes:
        a = self.at[i]
        return b" ".join(self.low[self.starts[j] : self.ends[j]].tobytes() for j in range(a, a + SHINGLE))


class _Class:
    """Templates of similar length with their windows and bands."""

    def __init__(self, members: list[tuple[str, list[bytes], np.ndarray]], containment: float, probability: float, rows: int):
        sizes = [len(x) for _, x, _ in members]
        self.step = max(1, min(sizes) // 4)
        self.window = max(sizes) + self.step
        least = 1.0
        for _, x, _ in members:
            need = math.ceil(containment * len(set(x)) - 1e-9)
            least = min(least, need / (self.window + len(set(x)) - need))
        self.rows, self.bands = rows, bands_for(least, probability, rows)
        self.members = [(name, len(x), {y: i for i, y in enumerate(dict.fromkeys(x))}) for name, x, _ in members]
        self.hashes = [h for _, _, h in members]

    def index(self, factors: np.ndarray) -> None:
        """Template minima per band, for lookups: sorted keys and the template of each."""
        keys = [np.array([[(h * f).min() for f in factors[: self.bands * self.rows]] for h in self.hashes], np.uint64)]
        minima = keys[0].reshape(len(self.hashes), self.bands, self.rows)
        self.keys = []
        for b in range(self.bands):
            key = _band(minima[:, b, :])
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], order))


def _band(minima: np.ndarray) -> np.ndarray:
    key = np.zeros(len(minima), np.uint64)
    for r in range(minima.shape[1]):
        key = ts.mix(key + minima[:, r])
    return key


class Templates:
    def __init__(self, templates: dict[str, str], containment: float, probability: float, rows: int):
        self.containment = containment
        known = []
        for name, text in sorted(templates.items()):
            x = _Shingles(next(ts.slices(pa.array([text]), 1 << 62)))
            if len(x.h):
                known.append((name, [x.text(i) for i in range(len(x.h))], x.h))
        known.sort(key=lambda k: len(k[1]))
        self.shingles = np.unique(np.concatenate([k[2] for k in known])) if known else np.zeros(0, np.uint64)
        self.fewest = min((math.ceil(containment * len(set(k[1])) - 1e-9) for k in known), default=0)
        self.classes: list[_Class] = []
        while known:
            top = max(len(known[0][1]), int(1.25 * len(known[0][1])))
            own = [k for k in known if len(k[1]) <= top]
            known = known[len(own) :]
            self.classes.append(_Class(own, containment, probability, rows))
        n = max((c.bands * c.rows for c in self.classes), default=0)
        self.factors = np.random.default_rng(3).integers(1, 1 << 62, n, dtype=np.uint64) * ts.U(2) + ts.U(1)
        for c in self.classes:
            c.index(self.factors)

    def candidates(self, x: _Shingles) -> Iterator[tuple[_Class, int, int, int]]:
        """(class, template, first shingle of the window, one after its last) where a band collides."""
        if not len(x.h):
            return
        frames = []
        for c in self.classes:
            size = np.diff(x.off)
            count = -(-size // c.step)  # blocks of a text
            text = np.repeat(np.arange(len(size)), count)
            first = np.cumsum(count) - count
            block = x.off[text] + (np.arange(len(text)) - first[text]) * c.step
            end = np.minimum(block + c.window, x.off[text + 1])
            last = first[text] + count[text] - 1
            frames.append((block, end, last, np.zeros((len(block), c.rows), np.uint64), set()))
        for k, f in enumerate(self.factors):
            value = x.h * f
            for c, (block, end, last, minima, met) in zip(self.classes, frames, strict=True):
                if k >= c.bands * c.rows:
                    continue
                low = np.minimum.reduceat(value, block)
                best = low
                for j in range(1, -(-c.window // c.step)):
                    best = np.minimum(best, low[np.minimum(np.arange(len(low)) + j, last)])
                minima[:, k % c.rows] = best
                if k % c.rows == c.rows - 1:
                    keys, of = c.keys[k // c.rows]
                    key = _band(minima)
                    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        for m in of[lo[i] : hi[i]].tolist():
                            if (i, m) not in met:
                                met.add((i, m))
                                yield c, m, int(block[i]), int(end[i])

    def matches(self, s: ts.Slice) -> list[list[dict]]:
        """Spans found in each text, in order of their starts."""
        out: list[list[dict]] = [[] for _ in range(s.n)]
        x = _Shingles(s)
        hit = self.shingles[np.minimum(np.searchsorted(self.shingles, x.h), len(self.shingles) - 1)] == x.h if len(self.shingles) else np.zeros(len(x.h), bool)
        near = np.flatnonzero(ts.sums(hit, x.off) >= self.fewest)
        if len(near) and len(self.shingles):
            size = s.at[near + 1] - s.at[near]
            buf = np.concatenate([s.buf[s.at[t] : s.at[t + 1]] for t in near])
            for t, found in zip(near.tolist(), self._matches(ts.Slice(0, buf, np.append(0, np.cumsum(size)))), strict=True):
                out[t] = found
        return out

    def _matches(self, s: ts.Slice) -> list[list[dict]]:
        x = _Shingles(s)
        met: dict[tuple[int, str], dict[int, tuple[float, int]]] = {}
        for c, m, lo, hi in self.candidates(x):
            name, t, own = c.members[m]
            hit = [own.get(x.text(i), -1) for i in range(lo, hi)]
            text = int(np.searchsorted(x.off, lo, "right")) - 1
            for i in range(max(1, len(hit) - t + 1)):
                share = len({j for j in hit[i : i + t] if j >= 0}) / len(own)
                if share >= self.containment - 1e-9:
                    met.setdefault((text, name), {})[lo + i] = (share, min(lo + i + t, hi))
        out: list[list[dict]] = [[] for _ in range(s.n)]
        chars = ts.code_points(s.buf)
        for (text, name), spans in met.items():
            taken: list[tuple[int, int]] = []
            for a, (share, b) in sorted(spans.items(), key=lambda e: (-e[1][0], e[0])):
                if all(b <= p or q <= a for p, q in taken):
                    taken.append((a, b))
                    zero = chars[s.at[text]]
                    start, end = x.starts[x.at[a]], x.ends[x.at[b - 1] + SHINGLE - 1]
                    out[text].append({"name": name, "containment": share, "start": int(chars[start] - zero), "end": int(chars[end] - zero)})
        for found in out:
            found.sort(key=lambda f: (f["start"], f["name"]))
        return out


def find_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    probability: float = PROBABILITY,
    rows: int = ROWS,
) -> DataFrame:
    """``doc`` (the columns of ``docs`` other than ``text``) and ``licenses``: the spans found, each with its template, its containment and its
    place in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(  # the size of the given templates
        Templates(TEMPLATES if templates is None else templates, containment, probability, rows)
    )
    kind = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                found = pa.array(shared.value.matches(s), kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), found], ["doc", "licenses"])

    doc = ts.with_doc(docs)
    return doc.mapInArrow(scan, StructType([doc.schema["doc"], *StructType.fromDDL(MATCH).fields]))
