"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Everything here is a DataFrame or SQL expression.

Texts are lower-cased words (runs of letters and digits) and their five-word shingles. Templates fall
into length classes; within a class the longest has at most 3/2 of the shortest's shingles. A text
is cut into overlapping windows of 3/2 of the class's longest template, by half of it, so that any
copy of a template lies whole in some window.

A window whose template copy holds 80 % of the shingles has a Jaccard similarity of at least
``least_similarity`` with it; ``bands_for`` picks so many bands of ROWS minima that such a window
meets its template in some band with probability PROBABILITY. Windows without a single shingle of
their class's templates are left out first: they could not pass the last step.
Retrieved pairs are verified exactly: the share of the template's distinct shingles in the window.

Templates are bounded (MAX_SHINGLES in all, checked): only they are broadcast.

Defined results: null text has no words and matches nothing. Texts are told apart by (doc_id, hash
of the text); repeated rows give one result. Templates of fewer than five words are refused. Of windows
with equally many shingles the first counts; very long texts are cut into windows whole; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents

SHINGLE, CONTAINMENT, ROWS, PROBABILITY, MAX_SHINGLES = 5, 0.8, 1, 0.99999, 20_000

# fixed values: the notices and license texts that are looked for
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda h: F.when(F.size(h) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE)))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def least_similarity(shortest: int, longest: int) -> float:
    """The Jaccard similarity of a window with a template of which it holds CONTAINMENT."""
    window = window_of(longest)
    return min(CONTAINMENT * n / (window + n - CONTAINMENT * n) for n in (shortest, longest))


def window_of(longest: int) -> int:
    return longest + max(1, longest // 2) - 1 + (longest > 1)


def stride_of(longest: int) -> int:
    return max(1, longest // 2)


def bands_for(similarity: float) -> int:
    """So many bands that the chance to share none is under 1 - PROBABILITY."""
    return math.ceil(math.log(1 - PROBABILITY) / math.log(1 - similarity**ROWS))


def minima(window: Column, bands: int) -> Column:
    """The band keys of a window: ROWS least values of seeded hashes each."""
    seeds = F.sequence(F.lit(0), F.lit(bands - 1))
    least = lambda seed: F.array_min(F.transform(window, lambda x: F.xxhash64(x, seed)))
    return F.transform(seeds, lambda b: F.xxhash64(b, *(least(b * ROWS + r) for r in range(ROWS))))


def classes(counts: list[int]) -> list[tuple[int, int]]:
    """(shortest, longest) shingle counts of the length classes."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(counts)):
        if out and n <= out[-1][0] * 3 / 2:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def license_matches(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """doc_id, template, n_shingles (the template's), n_matched (in the best window), first_window: where
    the first verified window begins, counted in shingles."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "licenses")
    known = spark.createDataFrame(list(templates.items()), "template string, text string").select("template", F.array_distinct(shingles(F.col("text"))).alias("own"))
    own = {r["template"]: r["own"] for r in known.collect()}
    if any(not v for v in own.values()) or sum(map(len, own.values())) > MAX_SHINGLES:
        raise ValueError("a template has under five words, or there are too many")
    every = sorted({x for v in own.values() for x in v})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "doc_id").alias("row"), F.col("text").cast("string").alias("text"))

    def hits(h: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(every))

    marked = texts.select("doc_id", "row", let(shingles(F.col("text")), lambda h: F.when(F.size(h) > 0, let(hits(h), lambda x: F.when(F.size(x) > 0, F.struct(h.alias("h"), x.alias("hits")))))).alias("m"))
    found = work.keep(marked.where("m is not null").select("doc_id", "row", "m.h", "m.hits"), "found").dropDuplicates(["doc_id", "row"])
    out = None
    for number, (shortest, longest) in enumerate(classes([len(v) for v in own.values()])):
        mine = {t: v for t, v in own.items() if shortest <= len(v) <= longest}
        inside = sorted({x for v in mine.values() for x in v})
        width, stride = window_of(longest), stride_of(longest)
        bands = bands_for(least_similarity(shortest, longest))
        of_class = F.filter("hits", lambda i: F.get(F.col("h"), i).isin(inside))
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - width + 1) / stride)).cast("int")
        starts = F.array_distinct(F.flatten(F.transform(of_class, lambda i: F.sequence(first(i), F.floor(i / stride).cast("int")))))
        windows = found.select("doc_id", "row", "h", F.explode(starts).alias("w")).select("doc_id", "row", (F.col("w") * stride).cast("long").alias("start"), F.array_distinct(F.slice("h", F.col("w") * stride + 1, F.lit(width))).alias("window"))
        rows = spark.createDataFrame([(t, v) for t, v in mine.items()], "template string, own array<bigint>")
        keys = rows.select("template", F.explode(F.array_distinct(minima(F.col("own"), bands))).alias("key"))
        retrieved = windows.select("*", F.explode(F.array_distinct(minima(F.col("window"), bands))).alias("key")).join(F.broadcast(keys), "key").drop("key")
        pairs = retrieved.groupBy("doc_id", "row", "start", "template").agg(F.first("window").alias("window"))
        checked = pairs.join(F.broadcast(rows), "template").select("doc_id", "row", "template", F.size("own").cast("long").alias("n_shingles"), F.size(F.array_intersect("own", "window")).cast("long").alias("n_matched"), "start")
        checked = checked.where(F.col("n_matched") >= CONTAINMENT * F.col("n_shingles"))
        out = checked if out is None else out.unionByName(checked)
    best = out.groupBy("doc_id", "row", "template").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_matched").alias("n_matched"), F.min("start").alias("first_window"))
    return best.drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir), TEMPLATES)


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
