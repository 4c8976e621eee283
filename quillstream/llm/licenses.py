"""License scans by a trained paragraph classifier (operator 6); scanning uses DataFrame functions only.

Paragraphs are classified by multinomial logistic regression over word bigrams and trigrams into
licence families and `unknown`. It is trained in numpy on the driver, from the templates below (whole,
cut to windows, and with foreign words around them) against decoys, shuffled templates and a bounded
notices of other licences, and a bounded
sample of corpus passages: SAMPLE_WINDOWS passages of WINDOW words with the least hashes, of SAMPLE documents with the
least hashed ids, anywhere in them. Passages that speak of licences are left out, so that none is taught as unknown.
An L1 penalty keeps it sparse. The temperature that calibrates the probabilities, that of `unknown` too, is fitted on what
a first model hasn't seen: short notices whose carrying sentence it doesn't know, long templates that lack words, licences
outside the families, and passages kept back; UNKNOWN wins unless a family reaches CONFIDENT. A prediction is confirmed if the paragraph covers at least COVERED of the bigrams
of one of the family's templates. A notice that a line or paragraph break cuts is confirmed as a run of
neighbouring paragraphs, if a window of about the template's length covers as much and is classified alike.

Scanning explodes word triples and joins them with the model's n-grams, whose number is bounded by the
templates and the bounded training sample; what matches nothing is dropped before any shuffle, so only sums
for paragraphs with matches are exchanged.

Defined results: a document without a predicted paragraph has family null, probability 0 and confirmed
false, and nothing found; null and empty texts have no paragraphs. All predicted paragraphs are returned; the
document's own columns repeat the confirmed one with the highest probability, then the first. Texts of any length are
scanned whole. Repeated rows stay; columns besides doc_id and text are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_array, row_key, sample_ids, small_table, whole_text

#: Typical notices and key paragraphs of public licences, by family.
PARAGRAPHS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the terms of the Apache License 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is licensed under the terms of the GNU GPL v3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is licensed under the terms of the GNU GPL v2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is licensed under the terms of the GNU LGPL.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is licensed under the terms of the GNU AGPL v3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the 3-Clause BSD License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This project is licensed under the terms of the BSD license.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "This project is licensed under the terms of the ISC license.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This project is licensed under the terms of the MPL 2.0.",
        "The contents of this file are subject to the Mozilla Public License Version 2.0; you may not use this file except in compliance with the License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-NonCommercial 4.0 International license.",
        "You may not use the material for commercial purposes.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International license.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ),
}
#: Talk about licences that isn't a licence.
DECOYS = (
    "Please show your driver license and registration at the desk.",
    "The license plate of the car was hard to read in the dark.",
    "All rights reserved. No part of this publication may be reproduced.",
    "The general public is invited to the opening of the free software exhibition.",
    "A license fee is due for each copy of the software sold under this agreement.",
    "The terms of the contract were published by the foundation, in either version.",
    "version 2.0 of the program, you can obtain a copy at the office",
    "the following conditions are met in most cases, with or without a permit",
)

#: The names of each family, and sentences that carry a name. They make short notices.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "mit": ("MIT License",),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU LGPL"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "bsd": ("3-Clause BSD License", "BSD 2-Clause License", "BSD license"),
    "isc": ("ISC License",),
    "mpl-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "public-domain": ("CC0 1.0 Universal dedication",),
}
CARRIERS = (
    "Licensed under the {}.",
    "This project is licensed under the terms of the {}.",
    "Released under the {}.",
    "The code is available under the {}; see the file LICENSE.",
    "Distributed under the {}.",
    "You may use this work under the {}.",
)
#: Notices of licences outside the families.
OTHERS = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Permission is hereby granted to any person or organization obtaining a copy of the software to use, reproduce, display and execute it for evaluation only.",
    "Licensed under the Boost Software License, Version 1.0.",
    "This End User License Agreement is a legal agreement between you and the company for the software product.",
    "Released under the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
)
#: Every template, and which carrier each short notice has.
CARRIER_OF = {carrier.format(name): k for names in NAMES.values() for name in names for k, carrier in enumerate(CARRIERS)}
TEMPLATES = {f: (*group, *(t for name in NAMES[f] for c in CARRIERS if (t := c.format(name)) not in group)) for f, group in PARAGRAPHS.items()}

UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
SAMPLE, SAMPLE_WINDOWS, WINDOW = 200, 2000, 40
HELD_OUT = 2  # of each three carriers (and licences outside the families) those that only the calibration sees
DROPPED = 0.15  # share of words that paragraphs lack in the calibration
WINDOWS = 16  # cut windows of each template
L1, STEPS, RATE = 2e-4, 200, 0.5
CONFIDENT, COVERED = 0.5, 0.6
#: Fixed value: a word of the lower-cased text; numbers keep their dots.
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(found: list[str]) -> list[tuple[str, ...]]:
    return list(zip(found, found[1:])) + list(zip(found, found[1:], found[2:]))


@dataclass(frozen=True)
class Classifier:
    weights: dict[tuple[str, ...], np.ndarray]  # by family, divided by the temperature
    bias: np.ndarray

    def probabilities(self, text: str) -> np.ndarray:
        z = self.bias + sum((self.weights[g] for g in ngrams(words(text)) if g in self.weights), np.zeros(len(FAMILIES)))
        e = np.exp(z - z.max())
        return e / e.sum()


#: Words that speak of licences.
OF_LICENCES = re.compile("licen[cs]|copyright|spdx|gpl|creative commons|public domain|mozilla|warrant")


def speaks_of_licences(passage: str) -> bool:
    """Whether a passage may be part of a notice: it names one, or has several trigrams of one template."""
    found = words(passage)
    have = set(zip(found, found[1:], found[2:]))
    return bool(OF_LICENCES.search(passage.lower())) or any(len(have & t) > 2 for t in _template_trigrams())


@cache
def _template_trigrams() -> list[set[tuple[str, ...]]]:
    return [set(zip(w, w[1:], w[2:])) for group in TEMPLATES.values() for w in map(words, group)]


def _examples(templates: dict[str, list[str]], others: list[str], corpus: list[list[str]], seed: int = 7, dropped: float = 0.0) -> list[tuple[list[str], int]]:
    """Training paragraphs as words, and their class; `dropped`: the share of words that long templates lack."""
    draw = random.Random(seed)
    around = corpus or [words(x) for x in DECOYS]

    def noise(n: int) -> list[str]:
        x = draw.choice(around)
        s = draw.randrange(len(x))
        return x[s : s + n]

    unknown = FAMILIES.index(UNKNOWN)
    out = []
    for family, group in templates.items():
        c = FAMILIES.index(family)
        for whole in map(words, group):
            lacking = lambda t: [x for x in t if draw.random() >= dropped] if len(t) > 16 else t  # noqa: B023, E731
            out += [(lacking(whole), c)] * 4
            for _ in range(WINDOWS):
                t = lacking(whole)
                out.append((noise(draw.randrange(12)) + t + noise(draw.randrange(12)), c))
                if len(t) > 16:
                    k = draw.randrange(12, len(t))
                    s = draw.randrange(len(t) - k + 1)
                    out.append((t[s : s + k], c))
            for _ in range(4):
                out.append((draw.sample(whole, len(whole)), unknown))
    out += [(w, unknown) for w in map(words, (*DECOYS, *others)) for _ in range(6)]
    return out + [(x, unknown) for x in corpus]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Sparse:
    """Counts of n-grams by example: entries in the order of rows, and their order by column."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.rows, self.columns, self.values, w, self.shape[0])

    def transposed_times(self, z: np.ndarray) -> np.ndarray:
        order = self._by_column
        return self._sums(self.columns[order], self.rows[order], self.values[order], z, self.shape[1])

    @cached_property
    def _by_column(self) -> np.ndarray:
        return np.argsort(self.columns, kind="stable")

    @staticmethod
    def _sums(to: np.ndarray, at: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """For each number in the sorted `to` the sum of values times the rows `at` of `of`."""
        out = np.zeros((n, of.shape[1]), np.float32)
        if len(to):
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            out[to[starts]] = np.add.reduceat(values[:, None] * of[at], starts, axis=0)
        return out


def _matrix(examples: list[tuple[list[str], int]], index: dict[tuple[str, ...], int]) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Counts of n-grams, classes, and weights by which all classes weigh the same."""
    rows, columns, values = [], [], []
    y, n = [], []
    empty: dict[int, int] = {}
    for found, c in examples:
        row: dict[int, int] = {}
        for g in ngrams(found):
            if (j := index.get(g)) is not None:
                row[j] = row.get(j, 0) + 1
        if row:
            rows += [len(y)] * len(row)
            columns += row.keys()
            values += row.values()
            y.append(c)
            n.append(1.0)
        else:  # examples without any n-gram only teach the bias: one row stands for all of a class
            empty[c] = empty.get(c, 0) + 1
    y, n = np.array(y + list(empty)), np.array(n + list(empty.values()))
    share = np.bincount(y, n, len(FAMILIES))
    return Sparse(np.array(rows, np.int32), np.array(columns, np.int32), np.array(values, np.float32), (len(y), len(index))), y, n / np.maximum(share, 1)[y]


def _fitted(templates: dict[str, list[str]], others: list[str], corpus: list[list[str]]) -> tuple[dict[tuple[str, ...], int], np.ndarray, np.ndarray]:
    """Index of n-grams, weights and bias: proximal gradient descent with L1."""
    index: dict[tuple[str, ...], int] = {}
    for t in (t for group in templates.values() for t in group):
        for g in ngrams(words(t)):
            index.setdefault(g, len(index))
    x, y, weight = _matrix(_examples(templates, others, corpus), index)
    one = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    squares = np.bincount(x.columns, x.values**2, x.shape[1])
    scale = (1 / np.maximum(1.0, np.sqrt(squares / x.shape[0]))).astype(np.float32)  # common n-grams take shorter steps
    square, share = np.full_like(w, 1e-8), (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(STEPS):
        error = (_softmax(x.times(w) + b) - one) * share
        gradient = x.transposed_times(error)
        square += gradient**2
        step = RATE * scale[:, None] / np.sqrt(square)
        w = w - step * gradient
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(step, 50.0) * L1 * 0.05)
        b -= RATE * error.sum(0)
    return index, w.astype(np.float64), b.astype(np.float64)


def _of_calibration(template: str) -> bool:
    return CARRIER_OF.get(template, 0) % 3 == HELD_OUT


def held_out(passages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, classes and weights of examples that a model of the others hasn't seen: short notices by their carrier, long
    templates with words dropped, licences outside the families, and passages of the corpus."""
    seen = {f: [t for t in group if not _of_calibration(t)] for f, group in TEMPLATES.items()}
    new = {f: [t for t in group if t not in CARRIER_OF or _of_calibration(t)] for f, group in TEMPLATES.items()}
    index, w, b = _fitted(seen, [x for k, x in enumerate(OTHERS) if k % 3 != HELD_OUT], passages[::2])
    others = [x for k, x in enumerate(OTHERS) if k % 3 == HELD_OUT]
    x, y, weight = _matrix(_examples(new, others, passages[1::2], seed=8, dropped=DROPPED), index)
    return x.times(w) + b, y, weight


def train(sample: list[str]) -> Classifier:
    """Fit on the templates and passages of a corpus, those that speak of licences left out."""
    passages = [w for w in map(words, (x for x in sample if not speaks_of_licences(x))) if len(w) > 3]
    z, y, weight = held_out(passages)
    loss = lambda t: -(weight * np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    index, w, b = _fitted(TEMPLATES, list(OTHERS), passages)
    return Classifier({g: w[i] / temperature for g, i in index.items() if np.abs(w[i]).max() > 1e-4}, b / temperature)


def fit(docs: DataFrame) -> Classifier:
    """train() with a bounded sample of docs: SAMPLE documents, of all their passages of WINDOW words the SAMPLE_WINDOWS with
    the least hashes. (Passages of more than 16 characters a word, as in scripts without spaces, aren't sampled.)"""
    # At most SAMPLE rows, so this side is broadcast.
    found = docs.select(F.col("doc_id"), whole_text().alias("text")).join(F.broadcast(sample_ids(docs, SAMPLE)), "doc_id")
    w = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    starts = F.sequence(F.lit(1), F.size(w), F.lit(WINDOW))
    passages = found.select(F.explode(F.transform(starts, lambda k: F.array_join(F.slice(w, k, F.lit(WINDOW)), " "))).alias("t"))
    passages = passages.where(F.char_length("t") <= 16 * WINDOW).distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_WINDOWS)
    return train(sorted(r.t for r in passages.collect()))


def _paragraphs(text: Column) -> Column:
    """Parts between blank lines, or the lines of a text without blank lines."""
    blank = r"\n[\x20\x09\r]*\n"
    return F.when(text.rlike(blank), F.split(text, blank + r"\s*")).otherwise(F.split(text, "\n"))


def _triples(df: DataFrame) -> DataFrame:
    """Each row's text as (a, b, c) for each word that another follows, with the places of the three and the first one's position."""
    parts = F.transform(_paragraphs(F.col("_text")), lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)))
    d = df.select("_row", "doc_id", parts.alias("_parts"))
    # Two empty words in front bring every document through the join.
    w = F.concat(F.array(F.lit(""), F.lit("")), F.flatten("_parts")).alias("_words")
    at = F.concat(F.array(F.lit(0), F.lit(0)), F.flatten(F.transform("_parts", lambda x, i: F.array_repeat(i, F.size(x))))).alias("_at")
    d = d.select("_row", "doc_id", w, at)
    follow = lambda x, k: F.slice(x, k, F.size(x))
    zipped = F.arrays_zip("_words", follow("_words", 2), follow("_words", 3), "_at", follow("_at", 2), follow("_at", 3))
    return d.select("_row", "doc_id", F.posexplode(zipped).alias("_pos", "_z")).select("_row", "doc_id", "_pos", *(F.col("_z").getField(str(k) if k not in (0, 3) else ("_words", "_at")[k // 3]).alias(x) for k, x in enumerate(("a", "b", "c", "_place", "_next", "_last")))).where("b is not null")


def _numbers(values: list[float]) -> Column:
    """A literal array of doubles."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _runs(p: DataFrame, model: Classifier, grams: list[list[float]], tris: list[list[float]], sizes: list[int], lengths: list[int], families: list[int]) -> DataFrame:
    """p with _runs: confirmed notices that only several neighbouring paragraphs cover together.

    _hits are a document's n-grams by position. For each template that they cover, every hit opens a window
    of the template's length and some more; the window of the best coverage among those that are less than that
    length away counts, if the classifier finds the template's family in it. A window opens at the last place
    of its first n-gram. All is done inside the row, with slices as long as a window at most.
    """
    n = len(FAMILIES)
    number = lambda values, t: F.get(long_array(values), t).cast("int")
    spans = [x + x // 4 + 8 for x in lengths]
    own = lambda hits, t: F.filter(hits, lambda h: F.array_contains(h["templates"], t))
    covered = lambda t: F.size(F.array_distinct(F.transform(own(F.col("_hits"), t), lambda h: h["gram"]))) / number(sizes, t) >= COVERED
    several = F.array_max(F.transform("_hits", lambda h: h["last"])) > F.array_min(F.transform("_hits", lambda h: h["place"]))
    p = p.withColumn("_templates", F.when(several, F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["templates"])))), covered)))

    def windows(t: Column, hits: Column) -> Column:
        span = number(spans, t)

        def window(h: Column, i: Column) -> Column:
            rest = F.filter(F.slice(hits, i + 2, span), lambda x: x["pos"] < h["pos"] + span)
            new = F.filter(rest, lambda x: x["first"] < h["pos"])
            share = (F.size(F.array_distinct(F.transform(rest, lambda x: x["gram"]))) + 1) / number(sizes, t)
            again = F.exists(rest, lambda x: x["gram"] == h["gram"])
            end = F.when(F.size(new) > 0, F.get(new, F.size(new) - 1)).otherwise(h)
            return F.struct(h["pos"].alias("pos"), h["at"].alias("at"), end["pos"].alias("end"), h["place"].alias("place"), end["last"].alias("last"), F.when(again, 0.0).otherwise(share).alias("coverage"), t.alias("t"))

        return F.filter(F.transform(hits, window), lambda x: x["coverage"] >= COVERED)

    def best(t: Column, found: Column) -> Column:
        reach = number(lengths, t)
        near = lambda i: F.slice(found, F.greatest(i + 1 - reach, F.lit(1)), reach * 2 + 1)
        better = lambda y, x: (F.abs(y["pos"] - x["pos"]) < reach) & ((y["coverage"] > x["coverage"]) | ((y["coverage"] == x["coverage"]) & (y["pos"] < x["pos"])))
        return F.filter(found, lambda x, i: ~F.exists(near(i), lambda y: better(y, x)))

    # where the same n-gram stood before: a window ends at the last of its n-grams that is new in it
    numbered = F.transform("_hits", lambda h, i: F.struct(h["pos"].alias("pos"), h["gram"].alias("gram"), h["tri"].alias("tri"), h["place"].alias("place"), h["last"].alias("last"), h["templates"].alias("templates"), i.alias("at"), F.coalesce(F.array_max(F.transform(F.filter(F.slice("_hits", F.greatest(i + 1 - max(spans), F.lit(1)), F.least(i, F.lit(max(spans)))), lambda y: y["gram"] == h["gram"]), lambda y: y["pos"])), F.lit(-1)).alias("first")))
    p = p.withColumn("_numbered", F.when(F.size("_templates") > 0, numbered))
    each = F.transform("_templates", lambda t: F.struct(t.alias("t"), own(F.col("_numbered"), t).alias("hits")))
    p = p.withColumn("_each", F.when(F.size("_numbered") > 0, each))
    p = p.withColumn("_windows", F.when(F.size("_each") > 0, F.transform("_each", lambda x: F.struct(x["t"].alias("t"), windows(x["t"], x["hits"]).alias("found")))))
    p = p.withColumn("_kept", F.when(F.size("_windows") > 0, F.filter(F.flatten(F.transform("_windows", lambda x: best(x["t"], x["found"]))), lambda x: x["last"] > x["place"])))
    one, three = _numbers([v for g in grams for v in g]), _numbers([v for g in tris for v in g])

    def scored(x: Column) -> Column:
        inside = F.filter(F.slice("_numbered", x["at"] + 1, x["end"] - x["pos"] + 1), lambda h: h["pos"] <= x["end"])
        weight = lambda h, c: F.get(one, h["gram"] * n + c) + F.coalesce(F.get(three, h["tri"] * n + c), F.lit(0.0))
        total = lambda c: F.aggregate(inside, F.lit(float(model.bias[c])), lambda s, h: s + weight(h, c))
        z = F.array(*map(total, range(n)))
        return F.struct(x.alias("x"), z.alias("z"))

    p = p.withColumn("_scored", F.when(F.size("_kept") > 0, F.when(F.size("_numbered") > 0, F.transform("_kept", scored))))
    probability = lambda y: 1 / F.aggregate(y["z"], F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(y["z"])))
    sure = F.filter("_scored", lambda y: (F.array_position(y["z"], F.array_max(y["z"])) - 1 == number(families, y["x"]["t"])) & (probability(y) >= CONFIDENT))
    run = lambda y: F.struct(y["x"]["pos"].alias("pos"), y["x"]["end"].alias("end"), y["x"]["place"].alias("paragraph"), y["x"]["last"].alias("last"), F.get(F.array(*map(F.lit, FAMILIES)), number(families, y["x"]["t"])).alias("family"), probability(y).alias("probability"), y["x"]["coverage"].alias("coverage"), F.lit(True).alias("confirmed"))
    p = p.withColumn("_sure", F.when(F.size("_scored") > 0, F.sort_array(F.transform(sure, run))))
    # one paragraph that is confirmed alone, or a longer run of the family, stands for a run
    alone = lambda r: F.exists("_ones", lambda f: f["confirmed"] & (f["family"] == r["family"]) & (f["paragraph"] >= r["paragraph"]) & (f["paragraph"] <= r["last"]))
    near = lambda i: F.slice("_sure", F.greatest(i + 1 - 2 * max(spans), F.lit(1)), 4 * max(spans))
    longer = lambda y, r: (y["paragraph"] <= r["paragraph"]) & (y["last"] >= r["last"]) & ((y["last"] - y["paragraph"] > r["last"] - r["paragraph"]) | (y["coverage"] > r["coverage"]))
    # of two families that most of the same words stand for, as those of two versions, the better covered one counts
    shared = lambda y, r: 2 * (F.least(y["end"], r["end"]) - F.greatest(y["pos"], r["pos"]) + 1) > r["end"] - r["pos"] + 1
    surer = lambda y, r: shared(y, r) & ((y["coverage"] > r["coverage"]) | ((y["coverage"] == r["coverage"]) & (y["probability"] > r["probability"])))
    around = lambda r, i: F.exists(near(i), lambda y: F.when(y["family"] == r["family"], longer(y, r)).otherwise(surer(y, r)))
    left = F.filter("_sure", lambda r, i: ~alone(r) & ~around(r, i))
    plain = F.transform(left, lambda r: F.struct(*(r[c].alias(c) for c in ("paragraph", "last", "family", "probability", "coverage", "confirmed"))))
    return p.withColumn("_runs", F.when(F.size("_sure") > 0, F.when(F.size("_ones") >= 0, plain)))


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, family, probability, paragraph and last (numbers, unequal for a run), coverage (of the best template), confirmed; and
    found: the same of every predicted paragraph and every confirmed run of paragraphs, in the order of the text."""
    spark = docs.sparkSession
    n = len(FAMILIES)
    zero = [0.0] * n
    # Bounded by the templates. A trigram is only asked for where its bigram is known.
    two = {g[:2]: zero for g in model.weights} | {g: v.tolist() for g, v in model.weights.items() if len(g) == 2}
    at = {name: i for i, name in enumerate((f, t) for f in TEMPLATES for t in range(len(TEMPLATES[f])))}
    of_template: dict[tuple[str, ...], set[int]] = {}
    sizes = []
    for (family, t), i in at.items():
        found = set(zip(words(TEMPLATES[family][t]), words(TEMPLATES[family][t])[1:]))
        sizes.append(len(found))
        for g in found:
            of_template.setdefault(g, set()).add(i)
    two = {g: two.get(g, zero) for g in two.keys() | of_template.keys()} | {("", ""): zero}
    known = sorted(two.items())
    pairs = small_table(
        spark,
        {"a": [g[0] for g, _ in known], "b": [g[1] for g, _ in known], "w": [[float(x) for x in v] for _, v in known], "templates": [sorted(of_template.get(g, ())) for g, _ in known], "gram": list(range(len(known)))},
        {"a": pa.string(), "b": pa.string(), "w": pa.list_(pa.float64()), "templates": pa.list_(pa.int32()), "gram": pa.int32()},
    )
    three = sorted((g, v.tolist()) for g, v in model.weights.items() if len(g) == 3) or [(("", "", ""), zero)]
    triples = small_table(
        spark,
        {x: [g[k] for g, _ in three] for k, x in enumerate("abc")} | {"w3": [[float(x) for x in v] for _, v in three], "tri": list(range(len(three)))},
        dict.fromkeys("abc", pa.string()) | {"w3": pa.list_(pa.float64()), "tri": pa.int32()},
    )

    text = whole_text()
    # A hash of its columns goes with a row's number: even if a table were read in another order after an executor is lost,
    # sums of two rows never mix.
    d = docs.select("doc_id", text.alias("_text"), F.struct(F.monotonically_increasing_id().alias("number"), row_key(docs)[1].alias("hash")).alias("_row"))
    hits = _triples(d).join(F.broadcast(pairs), ["a", "b"]).join(F.broadcast(triples), ["a", "b", "c"], "left")
    inner, inner3 = F.col("_place") == F.col("_next"), F.col("_place") == F.col("_last")
    sums = [F.sum(F.when(inner, F.get("w", F.lit(i)) + F.when(inner3, F.coalesce(F.get("w3", F.lit(i)), F.lit(0.0))).otherwise(0.0)).otherwise(0.0)).alias(f"z{i}") for i in range(n)]
    z = [F.col(f"z{i}") + float(model.bias[i]) for i in range(n)]
    # Distinct bigrams of the templates: at most as many as the templates have.
    seen = F.collect_set(F.when((F.size("templates") > 0) & inner, F.struct("gram", "templates"))).alias("seen")
    hit = F.struct(F.col("_pos").alias("pos"), "gram", F.coalesce("tri", F.lit(-1)).alias("tri"), F.col("_place").alias("place"), F.col("_next").alias("last"), "templates")
    by_paragraph = hits.groupBy("_row", "doc_id", "_place").agg(*sums, seen, F.collect_list(F.when(F.size("templates") > 0, hit)).alias("_hits"))
    top = F.greatest(*z)
    p = by_paragraph.select("_row", "doc_id", "_place", "seen", "_hits", F.array(*(F.exp(x - top) for x in z)).alias("e"))
    p = p.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).withColumn("best", F.array_position("e", F.array_max("e")).cast("int") - 1)
    p = p.withColumn("probability", F.array_max("e") / F.col("total"))
    predicted = (F.col("best") < n - 1) & (F.col("probability") >= CONFIDENT)
    names = F.array(*map(F.lit, FAMILIES))
    # A family's templates stand one after the other.
    first = long_array([at[f, 0] for f in TEMPLATES])
    last = long_array([at[f, len(TEMPLATES[f]) - 1] for f in TEMPLATES])
    own = F.sequence(F.get(first, F.col("best")), F.get(last, F.col("best")))
    hit = F.flatten(F.transform("seen", lambda x: x["templates"]))
    share = lambda t: F.size(F.filter(hit, lambda x: x == t)) / F.get(long_array(sizes), t.cast("int"))
    p = p.withColumn("family", F.when(predicted, F.get(names, F.col("best"))))
    p = p.withColumn("coverage", F.when(predicted, F.array_max(F.transform(own, share))).otherwise(0.0))
    p = p.withColumn("probability", F.when(predicted, F.col("probability")).otherwise(0.0)).withColumn("confirmed", F.col("coverage") >= COVERED)
    one = F.struct(F.col("_place").alias("paragraph"), F.col("_place").alias("last"), "family", "probability", "coverage", "confirmed")
    p = p.groupBy("_row", "doc_id").agg(F.collect_list(F.when(F.col("family").isNotNull(), one)).alias("_ones"), F.sort_array(F.flatten(F.collect_list("_hits"))).alias("_hits"))
    sizes_in_words = [len(words(TEMPLATES[f][t])) for f, t in at]
    p = _runs(p, model, [v for _, v in sorted(two.items())], [v for _, v in three], sizes, sizes_in_words, [FAMILIES.index(f) for f, _ in at])
    p = p.select("doc_id", F.sort_array(F.concat("_ones", F.coalesce("_runs", F.slice("_ones", 1, 0)))).alias("found"))
    order = lambda x: F.struct(x["confirmed"].alias("a"), x["probability"].alias("b"), (-x["paragraph"]).alias("c"), x.alias("x"))
    p = p.withColumn("best", F.array_max(F.transform("found", order))["x"])
    none = {"probability": F.lit(0.0), "coverage": F.lit(0.0), "confirmed": F.lit(False)}
    return p.select("doc_id", *(F.coalesce(F.col("best")[c], none.get(c, F.lit(None))).alias(c) for c in ("family", "probability", "paragraph", "last", "coverage", "confirmed")), "found")


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan() of every document with a classifier fitted on a bounded sample of them."""
    return scan(docs, fit(docs))
