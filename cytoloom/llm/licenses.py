"""Licence texts inside documents: MinHash bands retrieve templates, exact shingle containment decides.

Documents and templates are words (lower-cased, cut at ASCII punctuation) in shingles of five. Retrieval works on overlapping
windows. A window class is (shortest template, words in a window, step in documents, bands); templates are windowed at every
word, so a step only has to hit some offset of the template:

* templates of 5 to 15 words: windows of 5 words at every word. Such a window has one shingle, which is its own MinHash: a
  document that shares any shingle collides with probability 1.
* templates of 16 words or more: windows of 16 words (12 shingles) at every 8th word and at the end, 4 bands of one row each. The MinHash
  of a band is the smallest value of ``hash xor band key``. An unchanged stretch of 23 words holds a whole window, which collides
  with probability 1; a window whose similarity to some template window is s collides with 1 - (1 - s)^4: 0.97 at s = 0.6,
  and a text with 80 % of a template's shingles has several such windows.

Templates are parameters, so their bands and shingles are literals: there is no join and no shuffle, and every text is read once.

Defined cases: null, empty and wordless texts match nothing; a template that occurs often in one document is reported once, with its
first and last word; a document may match several templates; repeated rows repeat their matches.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm.decontam import words
from cytoloom.llm.tables import let

SHINGLE = 5
#: (fewest words of a template, words in a window, step in documents, keys of the bands); keys are arbitrary odd numbers.
CLASSES = (
    (5, 5, 1, (0,)),
    (16, 16, 8, (0x1B873593CC9E2D51, 0x2127599BF4325C37, 0x3C6EF372FE94F82B, 0x510E527FADE682D1)),
)

# Published licence texts and the notices that name them.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    'required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
}


def _shingles(ws: Column) -> Column:
    """Hash of the five words from each word on; empty for fewer words."""
    return F.when(
        F.size(ws) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(ws) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE))),
    ).otherwise(F.array().cast("array<bigint>"))


def _band(shingles: Column, window: int, step: int, key: int) -> Column:
    """MinHash of each window of words."""
    held = window - SHINGLE + 1
    if held == 1 and step == 1:
        return F.transform(shingles, lambda h: h.bitwiseXOR(F.lit(key).cast("long"))) if key else shingles
    last = F.greatest(F.size(shingles) - held, F.lit(0)) + 1
    starts = F.array_append(F.sequence(F.lit(1), last, F.lit(step)), last)
    return let(
        F.transform(shingles, lambda h: h.bitwiseXOR(F.lit(key).cast("long"))),
        lambda hs: F.transform(starts, lambda p: F.array_min(F.slice(hs, p, held))),
    )


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")


def prepare_templates(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Shingles and bands of each template, as plain lists: as large as the templates, which are parameters."""
    df = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    ws = words(F.col("text"))
    rows = df.select("license", F.size(ws).alias("n"), let(ws, _shingles).alias("shingles")).collect()
    ready = []
    for r in rows:
        fitting = [c for c in CLASSES if r["n"] >= c[0]]
        if not fitting:
            raise ValueError(f"template {r['license']} has fewer than {SHINGLE} words")
        least, window, _, keys = fitting[-1]
        held = window - SHINGLE + 1
        bands = {}
        for key in keys:
            hs = [h ^ key for h in r["shingles"]]
            bands[key] = sorted({min(hs[p : p + held]) for p in range(max(1, len(hs) - held + 1))})
        ready.append({"license": r["license"], "class": least, "shingles": sorted(set(r["shingles"])), "bands": bands})
    return ready


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """All columns of ``docs(text, ...)`` and ``matches``: array of (license, n_template, n_shared, first_word, last_word).

    A template matches when at least ``containment`` of its distinct shingles occur in the document.
    """
    ready = prepare_templates(docs.sparkSession, templates)

    def judge(sh: Column) -> Column:
        def decide(*bands: Column) -> Column:
            own = dict(zip(order, bands, strict=True))

            def collides(some: list[dict]) -> Column:
                return reduce(
                    or_,
                    [
                        F.arrays_overlap(own[least, key], _longs(sorted({v for t in some if t["class"] == least for v in t["bands"][key]})))
                        for least, key in order
                        if any(t["class"] == least for t in some)
                    ],
                )

            def match(t: dict) -> Column:
                all_of = _longs(t["shingles"])
                shared = F.size(F.array_intersect(sh, all_of))
                inside = F.transform(sh, lambda h: F.array_contains(all_of, h))
                return F.when(
                    collides([t]) & (shared >= F.lit(containment * len(t["shingles"]))),
                    F.struct(
                        F.lit(t["license"]).alias("license"),
                        F.lit(len(t["shingles"])).alias("n_template"),
                        shared.alias("n_shared"),
                        (F.array_position(inside, F.lit(True)) - 1).cast("int").alias("first_word"),
                        (F.size(sh) - F.array_position(F.reverse(inside), F.lit(True)) + SHINGLE - 1).cast("int").alias("last_word"),
                    ),
                )

            return F.when(collides(ready), F.array_compact(F.array(*[match(t) for t in ready])))

        order = [(least, key) for least, _, _, keys in CLASSES for key in keys]
        made = F.struct(
            *[
                _band(sh, window, step, key).alias(f"b{i}")
                for i, (window, step, key) in enumerate((w, s, k) for _, w, s, keys in CLASSES for k in keys)
            ]
        )
        return let(made, lambda b: decide(*[b[f"b{i}"] for i in range(len(order))]))

    kept = [c for c in docs.columns if c != "matches"]
    # One expression from the text to the matches: every array is made once per row.
    return docs.select(*kept, let(words(F.col("text")), lambda ws: let(_shingles(ws), judge)).alias("matches"))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """One row per document and matching template: ``doc_id, license, n_template, n_shared, first_word, last_word``."""
    found = scan_licenses(docs.select("doc_id", "text"), templates, containment)
    return found.select("doc_id", F.explode_outer("matches").alias("m")).where("m is not null").select("doc_id", "m.*")
