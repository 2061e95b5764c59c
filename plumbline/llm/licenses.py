"""Operator 5: license scans with MinHash bands over overlapping windows, DataFrame functions only.

A text's five-word shingles are hashed and cut into overlapping windows of three sizes.  The bands of a window are its
least 8, 12 or 16 different hashes (bottom-k MinHash: one order of all shingles, drawn without replacement); each band retrieves
the passages that hold the shingle.  Candidates are verified exactly: the share of the passage's shingles that the
window holds.  For passages of under eight shingles every shingle is a band, looked for in the window in whose first
stride it lies.

A window is four strides long and begins at every stride, so a passage of at most three strides and one shingle lies in
one of them whole.  A shingle that a window repeats counts once, in bands and in containment.  A passage with ``LEAST`` of
its shingles has at least x = 7, 12 or 21 of the w different ones there, w being 16, 32 or 64 at most; all k bands miss it
with probability C(w - x, k) / C(w, k), which is under 0.0007 for each size and less for smaller w; passages of
single-shingle bands are never missed.  A passage that repeats a shingle is cut before it, so its pieces repeat none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE, LEAST, SHORT = 5, 0.8, 7
BANDS = {4: 8, 8: 12, 16: 16}  # by stride, in shingles; a window has four strides
STRIDES = tuple(BANDS)
BROADCAST_ROWS = 100_000  # of passages' shingles; beyond it Spark joins as it sees fit

# The standard wordings of common license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

WORD = "[a-z0-9]+"


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _unrepeated(shingles: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for x in shingles:
        if x in out[-1]:
            out.append([])
        out[-1].append(x)
    return [x for x in out if x]


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, int, str]]:
    """(license, passage, stride, shingle); passages of over 49 shingles are cut into pieces.  Stride 0: ``SHORT`` at most."""
    rows, longest = [], 3 * STRIDES[-1] + 1
    for name, passages in templates.items():
        n = 0
        for passage in passages:
            words = template_words(passage)
            shingles = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
            for whole in _unrepeated(shingles):
                pieces = -(-len(whole) // longest)
                for k in range(pieces):  # pieces of like length
                    part = whole[len(whole) * k // pieces : len(whole) * (k + 1) // pieces]
                    stride = 0 if len(part) <= SHORT else next(s for s in STRIDES if len(part) <= 3 * s + 1)
                    rows += [(name, n, stride, x) for x in part]
                    n += 1
    return rows


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shingles(text: Column) -> Column:
    """The hashes of a text's shingles, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def hashed(w: Column) -> Column:
        at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))

    return _bound(words, hashed)


def _windows(h: Column, stride: int) -> Column:
    """(stride, first shingle, the window's shingles) for every window."""
    starts = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / stride).cast("int"))
    return F.transform(starts, lambda j: F.struct(F.lit(stride).alias("stride"), (j * stride).alias("at"), F.slice(h, j * stride + 1, 4 * stride).alias("have")))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs`` and license found: doc_id, license, containment (of the best passage), first_word.

    Words are runs of ASCII letters and digits in lower case; a passage counts where a window holds ``least`` of its
    distinct shingles; ``first_word`` is the first word of such a passage's first shingle there.  Null and empty texts
    and those under five words find nothing; repeated rows, also of one or no identifier, are scanned each by itself; an
    empty input gives no row.  The passages are broadcast up to ``BROADCAST_ROWS`` of their shingles."""
    spark: SparkSession = docs.sparkSession
    rows = template_rows(templates or TEMPLATES)
    known = spark.createDataFrame(rows, "license string, passage int, stride int, shingle string").distinct()
    words5 = F.split("shingle", " ")
    hashed = known.select("license", "passage", "stride", F.xxhash64(*[words5[i] for i in range(SHINGLE)]).alias("h"))
    templ = hashed.groupBy("license", "passage", "stride").agg(F.collect_set("h").alias("template"))
    lookup = templ.select("license", F.col("stride").alias("kind"), "template", F.explode("template").alias("value"))
    lookup = F.broadcast(lookup) if len(rows) <= BROADCAST_ROWS else lookup

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _shingles(F.col(text_col)).alias("h")).filter(F.size("h") > 0)
    windows = texts.select("row", "doc_id", F.explode(F.concat(*[_windows(F.col("h"), s) for s in STRIDES])).alias("w")).select("row", "doc_id", "w.stride", "w.at", "w.have")
    k = F.when(F.col("stride") == STRIDES[0], BANDS[4]).when(F.col("stride") == STRIDES[1], BANDS[8]).otherwise(BANDS[16])
    single = F.when(F.col("stride") == STRIDES[0], F.slice("have", 1, STRIDES[0])).otherwise(F.array().cast("array<bigint>"))
    bands = windows.select("*", F.posexplode(F.concat(single, F.slice(F.sort_array(F.array_distinct("have")), F.lit(1), k))).alias("band", "value"))
    first_stride = (F.col("stride") == STRIDES[0]) & (F.col("band") < F.least(F.size("have"), F.lit(STRIDES[0])))
    met = bands.withColumn("kind", F.when(first_stride, 0).otherwise(F.col("stride"))).join(lookup, ["kind", "value"])
    share = F.size(F.array_intersect("have", "template")) / F.size("template")
    first = F.array_min(F.transform("template", lambda t: F.nullif(F.array_position("have", t), F.lit(0)))) + F.col("at") - 1
    good = met.withColumn("containment", share).filter(F.col("containment") >= least).withColumn("first", first)
    return good.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word")).drop("row")


def oracle(templates: dict[str, list[str]] | None = None) -> str:
    """DuckDB SQL: every window against every passage, by exact containment alone."""
    rows = sorted(set(template_rows(templates or TEMPLATES)))
    values = ", ".join("('{}', {}, {}, '{}')".format(*r) for r in rows)
    wide = " UNION ALL ".join(f"SELECT row, doc_id, sh, pos, {s} AS stride, pos // {s} - k AS win FROM hits, range(4) r(k) WHERE pos // {s} >= k" for s in STRIDES)
    return f"""
WITH templ(license, passage, stride, sh) AS (VALUES {values}),
sizes AS (SELECT license, passage, stride, count(*) AS n FROM templ GROUP BY ALL),
words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
sh AS (SELECT row, doc_id, unnest(range(greatest(len(w) - {SHINGLE - 1}, 0))) AS pos, w FROM words),
grams AS (SELECT row, doc_id, pos, array_to_string(w[pos + 1:pos + {SHINGLE}], ' ') AS sh FROM sh),
hits AS (SELECT * FROM grams WHERE sh IN (SELECT sh FROM templ)),
met AS (
  SELECT w.row, w.doc_id, t.license, t.passage, t.stride, w.win, count(DISTINCT w.sh) AS have, min(w.pos) AS first FROM ({wide}) w JOIN templ t USING (stride, sh) GROUP BY ALL
  UNION ALL
  SELECT w.row, w.doc_id, t.license, t.passage, t.stride, w.win, count(DISTINCT w.sh), min(w.pos) FROM ({wide}) w JOIN templ t ON t.stride = 0 AND w.stride = {STRIDES[0]} AND t.sh = w.sh
  GROUP BY ALL HAVING min(w.pos) < {STRIDES[0]} * (w.win + 1))
SELECT m.doc_id, m.license, max(m.have::DOUBLE / s.n) AS containment, min(m.first)::BIGINT AS first_word
FROM met m JOIN sizes s USING (license, passage, stride) WHERE m.have::DOUBLE / s.n >= {LEAST} GROUP BY m.row, m.doc_id, m.license"""
