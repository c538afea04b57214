"""Licence scan: a paragraph classifier that runs as plain column expressions.

A softmax regression over sparse word n-grams (one and two words, common words
alone left out) names the licence family of a paragraph or says unknown.  It is
fitted in numpy on the driver, on the templates below, on distorted copies and
wrapped lines of them, and on paragraphs without a notice.  A temperature fitted
on notices and sentences that are none of these (``HELD_OUT``) calibrates its
probabilities, unknown included.  A predicted family counts as confirmed if the
paragraph contains enough of one of its templates' n-grams.

A paragraph is a line, with the lines that go on from it: a line that begins
with a small letter or a bracket goes on from one that ends without a stop.

Every paragraph is scored.  That is short for those that hold none of
``Model.signals``: each n-gram that speaks for any family against unknown has
one of these words in it, and without any of them unknown wins by its bias
alone, so its score need not be worked out (``signals_of`` proves this for the
fitted numbers, else all are scored in full).

The scan uses DataFrame functions only: no Python runs on executors, no row is
shuffled, and weights are integers, so that sums do not depend on order.

Defined results: a null or empty text has no rows; repeated rows are scanned one
by one; a paragraph of any length is read whole; equal scores go to unknown,
else to the family that comes first; other columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Phrases of public licence notices, by family. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "MIT License",
        "License: MIT",
        "under the MIT License",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Apache 2.0",
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL-3.0": (
        "GPLv3",
        "GPL-3.0",
        "GNU GPL v3",
        "GNU General Public License v3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "GPLv2",
        "GPL-2.0",
        "GNU GPL v2",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    "LGPL": (
        "GNU Lesser General Public License",
        "LGPL",
        "This library is licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "GNU Affero General Public License",
        "AGPL",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "BSD License",
        "BSD-3-Clause",
        "BSD-2-Clause",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "Mozilla Public License 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "CC-BY": (
        "CC BY 4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "CC BY-NC 4.0",
        "Attribution-NonCommercial 4.0 International",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "in the public domain",
        "CC0",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under the CC0 license.",
    ),
    "proprietary": (
        "All rights reserved.",
        "proprietary and confidential",
        "Copyright (c) the company. All rights reserved.",
        "This software is proprietary and confidential; no license is granted without written permission.",
    ),
}
#: Paragraphs that name licences or rights without being a notice. Fixed values.
UNKNOWN_PARAGRAPHS = (
    "You need a driving license to rent a car", "the license plate of the car was lost", "her fishing license expired in May",
    "he asked for permission to leave the room", "permission denied while reading the file", "the warranty covers two years of repair",
    "copyright law has a long history", "a poetic license taken by the author", "the licensed electrician came at noon",
    "the city licensing office is closed", "a public domain name was registered", "parents gave written permission for the trip",
    "redistribution of wealth was debated", "the bar lost its liquor license", "which license should I choose for my work",
    "license", "copyright", "permission", "warranty", "licensed", "the license", "rights reserved seats only",
)
#: Common words of notices and other prose, among them a German one; alone they are no features. Fixed values.
COMMON = frozenset("a an and any are as at be but by can copy either for free from has have if in is it its may mit more new no not of on one or other part person public see so source such terms that the this to under use used version will with without work you your".split())
#: Notices and other sentences that the fit has not seen, for the temperature. Fixed values.
HELD_OUT: tuple[tuple[str, str], ...] = (
    ("MIT", "Distributed under the MIT License. See LICENSE for more information."), ("MIT", "The MIT License (MIT)"), ("MIT", "licensed under MIT"),
    ("Apache-2.0", "Apache License v2.0"), ("Apache-2.0", "This file is licensed to you under the Apache License, Version 2.0"), ("Apache-2.0", "License: Apache-2.0"),
    ("GPL-3.0", "GNU General Public License v3 or later"), ("GPL-3.0", "Distributed under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "License: GPL-2.0-only"), ("GPL-2.0", "free software under the GNU General Public License version 2"),
    ("LGPL", "GNU Lesser General Public License for more details"), ("AGPL-3.0", "terms of the GNU Affero General Public License"),
    ("BSD", "Use of this source code is governed by a BSD license"), ("BSD", "the 3-clause BSD license"), ("MPL-2.0", "Mozilla Public License"), ("ISC", "under the ISC license"),
    ("CC-BY", "Creative Commons Attribution 4.0"), ("CC-BY-SA", "shared under CC BY-SA"), ("CC-BY-NC", "a CC BY-NC license"),
    ("public-domain", "released into the public domain"), ("proprietary", "(c) 2020, all rights reserved by the authors"), ("proprietary", "This document is proprietary and confidential."),
    ("unknown", "the driver has a license"), ("unknown", "a work of art"), ("unknown", "free of charge until May"), ("unknown", "this program was on the radio"),
    ("unknown", "software and other goods"), ("unknown", "permission to land"), ("unknown", "the general public was warned"), ("unknown", "version 3 of the story"),
    ("unknown", "the international attribution of the painting"), ("unknown", "copyright is a right"), ("unknown", "conditions of the road"), ("unknown", "mit der Bahn nach Hause"),
)
WORD_PATTERN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A line end within a sentence.
WRAP_PATTERN = r"(?<=[^.!?:;\n])\n(?=[a-z(])"
#: The same for DuckDB, which can't look around: replaced twice, as a match takes the letters at both sides with it.
WRAP_GROUPS = r"([^.!?:;\n])\n([a-z(])"
SCALE = 1000
#: Paragraphs without a notice that the fit learns from.
PROSE = 400


def words(text: str) -> list[str]:
    return re.findall(WORD_PATTERN, text.lower())


def ngrams(text: str) -> list[str]:
    w = words(text)
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def _said(gram: str) -> bool:
    """Whether an n-gram is more than common words."""
    return not set(gram.split()) <= COMMON


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the first is unknown
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]  # by n-gram, in thousandths, divided by the temperature
    bias: tuple[int, ...]
    signals: tuple[str, ...] | None  # None: nothing can be left unscored


def signals_of(vocabulary: tuple[str, ...], weights: np.ndarray, bias: np.ndarray) -> tuple[str, ...] | None:
    """Words without any of which unknown wins: they are in every n-gram that speaks for a family against unknown."""
    if (bias[1:] >= bias[0]).any():
        return None
    found: set[str] = set()
    pairs = [g for g, w in zip(vocabulary, weights, strict=True) if (w[1:] > w[0]).any()]
    for g in sorted(pairs, key=lambda g: (" " in g, g)):
        if found.isdisjoint(g.split()):
            found.add(max(set(g.split()) - COMMON, key=lambda w: (len(w), w)))
    return tuple(sorted(found))


def _distorted(text: str, rng: random.Random) -> str:
    w = text.split()
    start = rng.randrange(0, max(1, len(w) // 3)) if len(w) > 8 else 0
    stop = len(w) - (rng.randrange(0, max(1, len(w) // 3)) if len(w) > 8 else 0)
    w = [x for x in w[start:stop] if len(w) <= 4 or rng.random() > 0.08]
    noise = lambda: ["".join(rng.choice(("th", "er", "in", "on", "re", "ha")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 8))]
    return " ".join(noise() + w + noise())


def _wrapped(text: str, rng: random.Random) -> str:
    """A line of a hard-wrapped copy."""
    w = text.split()
    n = rng.randint(7, 14)
    start = rng.randrange(0, max(1, len(w) - n + 1))
    return " ".join(w[start : start + n])


def _prose(terms: list[str], rng: random.Random) -> str:
    """Common words, more of them the longer the paragraph, and a few of the vocabulary's words out of context."""
    share = rng.random()
    w = [x for x in sorted(COMMON) if rng.random() < share] + rng.sample(terms, rng.randint(0, 2))
    rng.shuffle(w)
    return " ".join(w)


@lru_cache(maxsize=1)
def fit(seed: int = 5, copies: int = 24, steps: int = 500, ridge: float = 4e-4) -> Model:
    """Softmax regression by gradient descent with momentum, then a temperature by the likelihood of HELD_OUT."""
    rng = random.Random(seed)
    families = (UNKNOWN, *TEMPLATES)
    vocabulary = tuple(sorted(g for g in {g for t in TEMPLATES.values() for x in t for g in ngrams(x)} | {g for x in UNKNOWN_PARAGRAPHS for g in words(x)} if _said(g)))
    at = {g: i for i, g in enumerate(vocabulary)}
    terms = [g for g in vocabulary if " " not in g]
    rows = []
    for k, family in enumerate(families):
        for text in TEMPLATES.get(family, UNKNOWN_PARAGRAPHS):
            rows.append((text, k))
            rows += [(_distorted(text, rng), k) for _ in range(copies if k else 10)]
            if k and len(text.split()) > 14:
                rows += [(_wrapped(text, rng), k) for _ in range(copies)]
    rows += [(_prose(terms, rng), 0) for _ in range(PROSE)]

    def table(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, (text, _) in enumerate(rows):
            x[i, [at[g] for g in set(ngrams(text)) if g in at]] = 1
        return x, np.array([k for _, k in rows])

    x, y = table(rows)
    hx, hy = table([(t, families.index(f)) for f, t in HELD_OUT])
    w, speed = np.zeros((x.shape[1], len(families))), 0.0
    goal = np.eye(len(families))[y]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.8 * (x.T @ (p - goal) / len(x) + ridge * w)
        w += speed

    def loss(t: float) -> float:
        z = hx @ w / t
        z -= z.max(1, keepdims=True)
        return float(-(z[np.arange(len(hy)), hy] - np.log(np.exp(z).sum(1))).mean())

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    scaled = np.rint(w / temperature * SCALE).astype(int)
    weights, bias = scaled[:-1], scaled[-1]
    return Model(families, vocabulary, tuple(tuple(int(v) for v in r) for r in weights), tuple(int(v) for v in bias), signals_of(vocabulary, weights, bias))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _scores(grams: str, m: Model) -> Column:
    weights = _constant(dict(zip(m.vocabulary, m.weights, strict=True)), "map<string,array<bigint>>")
    known = F.array_intersect(grams, _constant(list(m.vocabulary), "array<string>"))
    return F.aggregate(known, _constant(list(m.bias), "array<bigint>"), lambda z, g: F.zip_with(z, F.element_at(weights, g), lambda a, b: a + b))


def _any_of(found: tuple[str, ...]) -> str:
    """A pattern for any of the words, by first letter; what is no letter or digit bounds a word."""
    by_first: dict[str, list[str]] = {}
    for w in found:
        by_first.setdefault(w[0], []).append(w[1:].replace(".", "[.]"))
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by_first.items())) + ")(?![a-z0-9])"


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, least_similarity: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed, notice): a row for each paragraph with a licence."""
    m = model or fit()
    templates = _constant({f: [sorted(set(ngrams(t))) for t in TEMPLATES[f]] for f in m.families[1:]}, "map<string,array<array<string>>>")
    families = _constant(list(m.families), "array<string>")

    joined = F.regexp_replace(F.col("_text"), WRAP_PATTERN, " ")
    lines = F.transform(F.split(joined, "\n"), lambda line, i: F.struct(i.alias("paragraph"), line.alias("notice")))
    if m.signals is not None:
        lines = F.filter(lines, lambda s: F.lower(s["notice"]).rlike(_any_of(m.signals)))
    rows = (
        df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
        .select("doc_id", F.explode(lines).alias("s")).select("doc_id", "s.paragraph", "s.notice")
    )
    w = F.regexp_extract_all(F.lower("notice"), F.lit(f"({WORD_PATTERN})"), 1)
    rows = rows.withColumn("_w", w)
    pairs = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_grams", F.array_distinct(F.concat("_w", pairs)))
    rows = rows.withColumn("_z", _scores("_grams", m)).withColumn("_top", F.array_max("_z"))
    best = F.array_position("_z", F.col("_top")).cast("int")
    total = F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp((z - F.col("_top")) / SCALE))
    rows = rows.select("doc_id", "paragraph", "notice", "_grams", F.element_at(families, best).alias("family"), F.round(1.0 / total, 4).alias("probability")).where(F.col("family") != UNKNOWN)
    share = F.array_max(F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("_grams"))) / F.size(t)))
    return rows.select("doc_id", "paragraph", "family", "probability", F.round(share, 4).alias("similarity"), (share >= least_similarity).alias("confirmed"), "notice")


def scan_sql(model: Model | None = None, table: str = "documents", least_similarity: float = 0.5) -> str:
    """The scan as DuckDB SQL with the model's numbers written out; every paragraph is scored in full."""
    m = model or fit()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    vocabulary = ",\n".join(f"({text(g)}, {list(w)})" for g, w in zip(m.vocabulary, m.weights, strict=True))
    templates = ",\n".join(f"({text(f)}, [{', '.join(map(text, sorted(set(ngrams(t)))))}])" for f in m.families[1:] for t in TEMPLATES[f])
    return f"""
WITH v(g, w) AS (VALUES {vocabulary}),
t(family, grams) AS (VALUES {templates}),
joined AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{WRAP_GROUPS}', '\\1 \\2', 'g'), '{WRAP_GROUPS}', '\\1 \\2', 'g'), chr(10)) AS lines FROM {table}
), lines AS (
  SELECT doc_id, unnest(lines) AS notice, generate_subscripts(lines, 1) - 1 AS paragraph FROM joined
), w AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(paragraph AS INTEGER) AS paragraph, notice, regexp_extract_all(lower(notice), '{WORD_PATTERN}') AS w FROM lines
), g AS (
  SELECT r, doc_id, paragraph, notice, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS grams FROM w
), hit AS (
  SELECT r, unnest(grams) AS g FROM g
), z AS (
  SELECT hit.r, {", ".join(f"{b} + sum(v.w[{k + 1}]) AS z{k}" for k, b in enumerate(m.bias))}
  FROM hit JOIN v ON v.g = hit.g GROUP BY hit.r
), a AS (
  SELECT r, [{", ".join(f"CAST(z{k} AS BIGINT)" for k in range(len(m.bias)))}] AS z FROM z
), p AS (
  SELECT r, [{", ".join(map(text, m.families))}][list_position(z, list_max(z))] AS family,
         round(1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {SCALE}.0))), 4) AS probability FROM a
), s AS (
  SELECT g.r, p.family, p.probability, max(len(list_intersect(t.grams, g.grams)) / len(t.grams)) AS share
  FROM g JOIN p ON p.r = g.r JOIN t ON t.family = p.family GROUP BY ALL
)
SELECT g.doc_id, g.paragraph, s.family, s.probability, round(s.share, 4) AS similarity, s.share >= {least_similarity} AS confirmed, g.notice
FROM g JOIN s ON s.r = g.r
"""
