"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates fall into classes of similar length: class L holds those of L / 1.5 to L tokens.  For each
class a text is cut into windows of 1.25 L tokens that start every L / 4: each run of L tokens lies whole in one of them,
so the window that holds a template has a Jaccard similarity of at least 0.53 to it, and of at least
0.4 to one that keeps ``MIN_CONTAINMENT`` of its shingles.  ``BANDS`` bands of ``ROWS`` minima
then collide with probability 1 - (1 - 0.4^2)^48 > 0.9997.
Classes under 6 tokens have windows of L tokens, one at every token.

A retrieved template is a match where at least ``MIN_CONTAINMENT`` of its distinct shingles stand in the window.
So a window with fewer shingles of its class than the least of the class's templates needs cannot match, and is not
signed: the shingles of each class are looked up in a bitmap and counted over the windows.  The rest is signed from its
quarter steps, whose minima are taken once a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runready.llm.spaced_seeds import TokenHasher
from runready.llm.tables import worker_cache

BANDS, ROWS = 48, 2
HASHES = BANDS * ROWS
SHINGLE = 2
MIN_CONTAINMENT = 0.8
CHUNK = 64                   # documents looked at together
PIECE = 20_000               # shingles looked at together: bounds the memory of very long texts
BITMAP_BITS = 18

# Well-known license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}

_rng = np.random.default_rng(20240301)
_MULT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_NUMBER = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(tokens: np.ndarray) -> np.ndarray:
    """Hash of every ``SHINGLE`` tokens in a row."""
    n = len(tokens) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, 1, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ tokens[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def minima(runs: np.ndarray) -> np.ndarray:
    """``HASHES`` minima over each column of shingles."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, x.shape[1]), np.uint32)
    for k in range(HASHES):
        out[k] = (x * _MULT[k] + _ADD[k]).min(0)
    return out


def band_hashes(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (rows) and signature (columns)."""
    h = np.repeat(_NUMBER[:, None], sigs.shape[1], axis=1)
    for k in range(ROWS):
        h = (h ^ sigs[k::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Templates:
    """Templates by length class, their shingle sets, and an index from band keys to templates."""

    def __init__(self, texts: dict[str, list[str]]):
        tokens_of = TokenHasher()
        self.names, self.sets, sizes = [], [], []
        for license_, notices in texts.items():
            for number, notice in enumerate(notices):
                t = tokens_of(notice)
                s = np.unique(shingles(t))
                if len(s):
                    self.names.append((license_, number))
                    self.sets.append(s)
                    sizes.append(len(t))
        self.classes: dict[int, dict[int, list[int]]] = {}
        self.least: dict[int, int] = {}
        for k, size in enumerate(sizes):
            length = 2
            while length < size:
                length = length * 3 // 2
            index = self.classes.setdefault(length, {})
            for key in band_hashes(minima(self.sets[k][:, None]))[:, 0].tolist():
                index.setdefault(key, []).append(k)
            needed = int(np.ceil(MIN_CONTAINMENT * len(self.sets[k]) - 1e-9))
            self.least[length] = min(self.least.get(length, needed), needed)
        self.keys = {c: np.array(sorted(index), np.uint64) for c, index in self.classes.items()}
        # bit c of a bitmap's entry: a shingle with these leading bits stands in a template of the c-th class
        self.bitmap = np.zeros(1 << BITMAP_BITS, np.uint64)
        for c, index in enumerate(self.classes.values()):
            for k in {k for found in index.values() for k in found}:
                self.bitmap[self._place(self.sets[k])] |= np.uint64(1 << c)

    @staticmethod
    def _place(members: np.ndarray) -> np.ndarray:
        return (members >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    def candidates(self, members: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, last shingle + 1) of every window that shares a band key with a template
        and holds enough shingles of its class to match."""
        found = set()
        if not len(members):
            return found
        classes_of = self.bitmap[self._place(members)]
        for c, (length, index) in enumerate(self.classes.items()):
            step = max(1, length // 4)
            # a window is 1.25 lengths; of a few tokens, just those, as one starts at every token
            runs_in_window = -(-5 * length // (4 * step)) if length >= 6 else length - 1
            held = np.concatenate([[0], np.cumsum((classes_of >> np.uint64(c)) & np.uint64(1), dtype=np.int64)])
            first = np.arange(0, len(members), step)
            n_held = held[np.minimum(first + runs_in_window * step, len(members))] - held[first]
            windows = np.flatnonzero(n_held >= self.least[length])
            # a piece of windows lies within PIECE shingles
            piece = windows * step // PIECE
            for own in np.split(windows, np.flatnonzero(np.diff(piece)) + 1):
                if not len(own):
                    continue
                ahead = np.minimum(own[:, None] + np.arange(runs_in_window), len(first) - 1)
                runs, at = np.unique(ahead, return_inverse=True)
                # the last run may be short: its last shingle stands for those beyond the end
                places = np.minimum(runs * step + np.arange(step)[:, None], len(members) - 1)
                least, at = minima(members[places]), at.reshape(ahead.shape)
                sigs = least[:, at[:, 0]]
                for k in range(1, runs_in_window):
                    np.minimum(sigs, least[:, at[:, k]], out=sigs)
                keys = band_hashes(sigs)
                known = self.keys[length]
                hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                for band, window in zip(*np.nonzero(hit), strict=True):
                    start = int(own[window]) * step
                    for k in index[int(keys[band, window])]:
                        found.add((k, start, start + runs_in_window * step))
        return found


_SCHEMA = ("doc_id long, license string, notice int, containment double, first_token long, n_windows long")
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` and license found in it.

    ``notice`` is the template of the license that is held best, ``containment`` the share of its
    shingles in the best window, ``first_token`` where that window begins and ``n_windows`` how many windows match
    the license.  Null, empty and one-token texts match nothing; ids may repeat or be null; whole texts are scanned;
    other columns are not read.  ``texts`` (name to notices) are held by every task: a table of constants.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(texts or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, templates = worker_cache("tokens", TokenHasher), shared.value
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, CHUNK):
                ids = batch.column("doc_id").slice(at, CHUNK).to_pylist()
                each = [shingles(tokens_of(t)) for t in batch.column("text").slice(at, CHUNK).to_pylist()]
                ends = np.cumsum([len(s) for s in each])
                if not ends[-1]:
                    continue
                joined = np.concatenate(each)
                best: dict[tuple[int, str], list] = {}
                for k, a, z in templates.candidates(joined):
                    # a window that runs over the end of a document is verified in each of them
                    d = int(np.searchsorted(ends, a, "right"))
                    while d < len(each) and ends[d] - len(each[d]) < z:
                        start = int(ends[d] - len(each[d]))
                        lo, hi = max(a, start), min(z, int(ends[d]))
                        held = np.isin(templates.sets[k], joined[lo:hi]).mean() if hi > lo else 0.0
                        if held >= MIN_CONTAINMENT:
                            license_, notice = templates.names[k]
                            row = best.setdefault((d, license_), [(0.0, 0, 0), set()])
                            row[0] = max(row[0], (float(held), -notice, -(lo - start)))
                            row[1].add(a)
                        d += 1
                rows += [(ids[d], license_, -top[1], top[0], -top[2], len(windows))
                         for (d, license_), (top, windows) in sorted(best.items())]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where("text is not null").mapInArrow(run, _SCHEMA))


__all__ = ["scan", "Templates", "TEMPLATES", "shingles", "minima"]
