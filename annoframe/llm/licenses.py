"""Licence texts and notices in documents, by Dice coefficient over word bigrams.

A unit of a text (a line, a paragraph, the whole) matches a template if the Dice
coefficient of their sets of word bigrams is high enough. A coefficient of t needs a
template of t / (2 - t) to (2 - t) / t times the unit's bigrams, so templates are looked
up in that range of sizes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annoframe.llm import shared
from annoframe.llm.license_texts import TEXTS
from annoframe.llm.words import ALPHANUMERIC, runs, words_of

LEAST_DICE = 0.8
_SLICE = 2 << 20

#: Wordings of public licence texts and notices, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: Titles in short notices, by SPDX name.
_TITLES = [
    ("Apache-2.0", "the Apache License 2.0"), ("MIT", "the MIT License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("ISC", "the ISC License"),
    ("GPL-2.0", "the GNU General Public License v2.0"), ("GPL-3.0", "the GNU General Public License v3.0"), ("LGPL-2.1", "the GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License v3.0"), ("AGPL-3.0", "the GNU Affero General Public License v3.0"), ("MPL-2.0", "the Mozilla Public License 2.0"), ("Unlicense", "the Unlicense"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC0-1.0", "CC0 1.0"),
]
TEMPLATES += [(name, f"{verb} under {title}.") for name, title in _TITLES for verb in ("Licensed", "Released") if (name, verb) != ("MIT", "Licensed")]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in _TITLES)]
TEMPLATES += TEXTS


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(runs(hashes, 2))


class Templates:
    """Bigram sets of all templates in order of size."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        sets = []
        for name, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            sets.append((name, _bigrams(words_of(raw, np.array([0, len(raw)]), ALPHANUMERIC, lower=True)[2])))
        self.sets = sorted(((n, s) for n, s in sets if len(s)), key=lambda x: (len(x[1]), x[0]))
        self.sizes = np.array([len(s) for _, s in self.sets], np.int64)
        self.every = np.unique(np.concatenate([s for _, s in self.sets])) if self.sets else np.zeros(0, np.uint64)
        self.least = least

    def best(self, bigrams: np.ndarray) -> tuple[float, str] | None:
        """The highest coefficient of templates whose size allows a match, of equals the first name."""
        n = len(bigrams)
        lo = int(np.searchsorted(self.sizes, n * self.least / (2 - self.least) * (1 - 1e-9)))
        hi = int(np.searchsorted(self.sizes, n * (2 - self.least) / self.least * (1 + 1e-9), "right"))
        found = []
        for name, own in self.sets[lo:hi]:
            dice = 2 * int(np.isin(own, bigrams, assume_unique=True).sum()) / (n + len(own))
            if dice >= self.least:
                found.append((-dice, name))
        return (-min(found)[0], min(found)[1]) if found else None


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE, text: str = "text") -> DataFrame:
    """All columns, with ``__license`` and ``__dice`` of the best match (NULL without any) and ``__n_matches``.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased. Units are the lines, the paragraphs (between empty lines) and the whole
    of a text; ``__n_matches`` counts lines, paragraphs and whole that match, each place
    for itself. Ties go to the first name. NULL, empty texts and units of fewer than two
    words match nothing. Equal texts have equal rows; an empty table gives none.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    known = Templates(TEMPLATES if templates is None else templates, least)
    largest = int(known.sizes.max(initial=0) * (2 - least) / least) + 1
    given = spark.sparkContext.broadcast(known)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                data, bounds = shared.utf8(shared.column(piece, text))
                starts, _, hashes, firsts = words_of(data, bounds, ALPHANUMERIC, lower=True)
                pairs = runs(hashes, 2)
                inside = np.concatenate([[0], np.cumsum(np.isin(pairs, known.every))])
                breaks = np.flatnonzero(data == 10)
                licenses: list[str | None] = [None] * piece.num_rows
                dices: list[float | None] = [None] * piece.num_rows
                matches = [0] * piece.num_rows
                for row, (lo, hi, a, b) in enumerate(zip(bounds[:-1], bounds[1:], firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                    if b - a < 2 or inside[b - 1] == inside[a]:
                        continue
                    own = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
                    empty = _paragraph_breaks(own)
                    units = [(a, b)]
                    for cuts in (own, empty):
                        at = [a, *np.searchsorted(starts, cuts).tolist(), b]
                        units += zip(at, at[1:], strict=False)
                    best = None
                    for x, y in units:
                        # Words of a unit that stand in no template leave too few bigrams in common.
                        if y - x < 2 or inside[y - 1] == inside[x]:
                            continue
                        common = inside[y - 1] - inside[x]
                        bigrams = np.unique(pairs[x : y - 1]) if common else None
                        if bigrams is None or len(bigrams) > largest:
                            continue
                        found = known.best(bigrams)
                        if found:
                            matches[row] += 1
                            best = found if best is None else min(best, found, key=lambda f: (-f[0], f[1]))
                    if best:
                        dices[row], licenses[row] = best
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(licenses, pa.string()), pa.array(dices, pa.float64()), pa.array(matches, pa.int64())], names=[*piece.schema.names, "__license", "__dice", "__n_matches"]
                )

    return shared.in_batches(docs, look, ", ".join([*(f"`{n}` {k}" for n, k in docs.dtypes), "__license string, __dice double, __n_matches long"]))


def _paragraph_breaks(breaks: np.ndarray) -> np.ndarray:
    """The second of every two line breaks in a row, from the left, none counted twice."""
    out, at = [], 0
    places = breaks.tolist()
    while at + 1 < len(places):
        if places[at + 1] == places[at] + 1:
            out.append(places[at + 1])
            at += 2
        else:
            at += 1
    return np.array(out, np.int64)
