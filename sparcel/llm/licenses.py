"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Texts and templates are lower-case words and their five-word shingles. A template of t distinct shingles belongs to the size s, the
next power of two, and is looked for in windows of 2 s shingles that begin every s, so any passage of up to s shingles lies in one
window whole. A window's MinHash has ``BANDS`` values of one row each; it retrieves the templates of its size with which it agrees
on any band. A window that holds a share of ``SIMILARITY`` of a template's shingles is missed with a probability of at most
``miss_probability()``, about 2e-9. Retrieved templates are verified by the exact share of their shingles in the window.

Only windows with at least one shingle of some template are looked at; the others cannot be verified.

Defined results: NULL and empty texts, and texts of fewer than five words, have no license; a text may have several; a license
found in several windows is reported once, with its largest share and the first window that has it; repeated rows are scanned
alike; an empty table gives an empty result; other columns are never touched. Templates of fewer than five words are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, free, fresh

SHINGLE, SIMILARITY, BANDS = 5, 0.8, 96

#: The wording of notices and of the texts they stand for.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def miss_probability(similarity: float = SIMILARITY, bands: int = BANDS) -> float:
    """The largest probability that no band of a window agrees with a template it holds ``similarity`` of.

    The least Jaccard similarity is that of a template just over half its size: it shares ``similarity`` s / 2 shingles with a
    window of 2 s.
    """
    least = (similarity / 2) / (2 + (1 - similarity) / 2)
    return (1 - least) ** bands


def shingles(text: str) -> Column:
    """The hashes of a text's five-word shingles, in order."""
    words = r"filter(split(lower(%s), '[^\\p{L}\\p{N}]+'), w -> w <> '')" % text
    some = ", ".join(f"h[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"""
        transform(array(transform({words}, w -> xxhash64(w))), h -> CASE WHEN size(h) < {SHINGLE} THEN cast(array() AS array<bigint>)
          ELSE transform(sequence(0, size(h) - {SHINGLE}), i -> xxhash64({some})) END)[0]""")


def _signature(window: str) -> str:
    """MinHash values of an array of shingles."""
    return f"transform(sequence(1, {BANDS}), z -> array_min(transform({window}, g -> xxhash64(g, z))))"


def prepare(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Size, shingles and signature of each template, worked out by the same expressions as those of the texts."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    rows = rows.select("license", F.array_distinct(shingles("text")).alias("shingles")).withColumn("signature", F.expr(_signature("shingles")))
    found = [r.asDict() for r in rows.orderBy("license").collect()]
    for r in found:
        if not r["shingles"]:
            raise ValueError(f"template {r['license']} has fewer than {SHINGLE} words")
        r["size"] = 1 << (len(r["shingles"]) - 1).bit_length()
        r["least"] = math.ceil(SIMILARITY * len(r["shingles"]) - 1e-9)
    return found


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None, name: str = "licenses", text: str = "text") -> DataFrame:
    """``documents`` with an array ``name`` of ``license``, ``share`` of its shingles, and ``window`` (its first shingle), by license.

    A table that has a column ``name`` already is an error.
    """
    free(documents, name)
    known = prepare(documents.sparkSession, TEMPLATES if templates is None else templates)
    source, found, every = fresh(documents, "text"), fresh(documents, "shingles"), f"array({', '.join(f'{h}L' for h in sorted({h for r in known for h in r['shingles']}))})"
    every = every.replace(f"{-(1 << 63)}L", "(-9223372036854775807L - 1L)")
    kind = "array<struct<license: string, share: double, window: int>>"
    parts = []
    for size in sorted({r["size"] for r in known}):
        cases = []
        for r in (r for r in known if r["size"] == size):
            signature, own = (f"array({', '.join(f'{h}L' for h in r[c])})" for c in ("signature", "shingles"))
            verified = f"size(array_intersect(w.part, {own}))"
            cases.append(f"""transform(array(IF(exists(zip_with(w.signature, {signature}, (a, b) -> a = b), e -> e), {verified}, 0)), n ->
                IF(n >= {r['least']}, struct({literal(r['license'])} AS license, n / {len(r['shingles'])}D AS share, w.at AS window), NULL))[0]""")
        parts.append(f"""
            flatten(transform(array_distinct(flatten(transform(hits, p -> array(p DIV {size} - 1, p DIV {size})))), k ->
              transform(transform(transform(array(greatest(cast(k AS int), 0) * {size}),
                at -> struct(at, slice({found}, at + 1, {2 * size}) AS part)),
                w -> struct(w.at AS at, w.part AS part, {_signature('w.part')} AS signature)),
                w -> filter(array({', '.join(cases)}), m -> m IS NOT NULL))[0]))""")
    matches = f"""
        CASE WHEN NOT arrays_overlap({found}, {every}) THEN cast(array() AS {kind}) ELSE
          transform(array(array_intersect({found}, {every})), some ->
            transform(array(filter(sequence(0, size({found}) - 1), i -> array_contains(some, {found}[i]))), hits ->
              cast(concat({', '.join(parts)}) AS {kind}))[0])[0] END"""
    raw = fresh(documents, "matches")
    # of each license the largest share, then the first window
    best = f"""array_sort(filter({raw}, m -> NOT exists({raw}, o -> o.license = m.license AND (o.share > m.share OR (o.share = m.share AND o.window < m.window)))))"""
    out = documents.withColumn(source, document_text(text)).withColumn(found, shingles(source)).withColumn(raw, F.expr(matches))
    return out.withColumn(name, F.array_distinct(F.expr(best))).drop(source, found, raw)
