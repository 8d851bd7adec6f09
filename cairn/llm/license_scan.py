"""License scans (operator 5), DataFrame functions only: MinHash bands over overlapping text windows
retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._work import read_table, stored, text_or_empty, with_rows

WIDTH = 5
#: Shingles of a window and between the starts of two windows of a text. A template is cut to windows of the
#: largest size that it holds one and a half times, at every place.
SCALES = ((16, 8), (2, 2))
#: Permutations; the least and the largest shingle under each are two bands of one row. Windows of two
#: shingles show both with the first.
PERMUTATIONS = 2
# Notices and paragraphs of well-known licences.
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **{f"cc-{k}-4.0-notice": f"Licensed under CC {k.upper()} 4.0." for k in _CC},
    **{f"cc-{k}-4.0": f"This work is licensed under a Creative Commons {name} 4.0 International License." for k, name in {**_CC, "by-nc": "Attribution-NonCommercial"}.items()},
}


def collision_probability(similarity: float, rows: int = 1, bands: int = 2 * PERMUTATIONS) -> float:
    """Chance that two windows of such a Jaccard similarity share a band. Four fifths of a window's shingles
    in place make a similarity of 2/3, found with 0.988 by each of the text's windows, of which a template of 24
    shingles or more meets two at least; a stretch equal to one and a half windows of a template holds an
    equal window, which is found for certain. Any shingle that a shorter template shares with a text is the
    least or the largest of some window of two, so those are found for certain too."""
    return 1 - (1 - similarity**rows) ** bands


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.xxhash64(w))


def shingles(h: Column) -> Column:
    """Hashes of the five-word shingles in order, from a column of word hashes."""
    at = F.when(F.size(h) >= WIDTH, F.sequence(F.lit(0), F.size(h) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))


def _over(a: str, offsets: list[int] | range, step: int = 1) -> Column:
    """[least and largest of a[i + each offset]] for every i that is a step apart; arrays are read by place, and
    places beyond the end count for nothing."""
    at = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    pick = F.greatest if a.startswith("high") else F.least
    return F.transform(at, lambda i: pick(*[F.get(a, i + k) for k in offsets]))


def _permuted(grams: DataFrame, *keys: str) -> DataFrame:
    """Columns low0 and high0 (the shingles), low1 and high1 (under the first permutation) and so on."""
    hashed = lambda k: F.transform("s", lambda x: F.xxhash64(x, F.lit(k))) if k else F.col("s")
    moved = grams.select(*keys, "s", *[hashed(k).alias(f"p{k}") for k in range(PERMUTATIONS)])
    return moved.select(*keys, *[F.col(f"p{k}").alias(f"{end}{k}") for k in range(PERMUTATIONS) for end in ("low", "high")])


def text_bands(grams: DataFrame, *keys: str) -> DataFrame:
    """(keys, band) of the windows of texts. Windows of 16 are put together from blocks of 8, so a shingle is
    looked at once a permutation."""
    ends = [f"{end}{k}" for k in range(PERMUTATIONS) for end in ("low", "high")]
    df = _permuted(grams, *keys)
    df = df.select(*keys, *[_over(e, range(2), 2).alias(f"{e}_2") for e in ends[:2]], *[_over(e, range(8), 8).alias(f"{e}_8") for e in ends])
    df = df.select(*keys, "low0_2", "high0_2", *[_over(f"{e}_8", range(2)).alias(f"{e}_16") for e in ends])
    return df.select(*keys, F.explode(F.concat("low0_2", "high0_2", *[f"{e}_16" for e in ends])).alias("band"))


def template_bands(grams: DataFrame, wide: int, *keys: str) -> DataFrame:
    """(keys, band) of the windows of so many shingles at every place of a template."""
    ends = [f"{end}{k}" for k in range(PERMUTATIONS if wide > 2 else 1) for end in ("low", "high")]
    found = _permuted(grams, *keys).select(*keys, *[_over(e, range(wide)).alias(e) for e in ends])
    return found.select(*keys, F.explode(F.concat(*ends)).alias("band"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(id, text) of a dict of templates."""
    rows = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(t).alias("text")) for k, t in templates.items()]) if templates else F.array().cast("array<struct<id:string,text:string>>")
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.id", "t.text")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast if a count says that it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def license_scan(docs: DataFrame, templates: DataFrame | dict[str, str] = TEMPLATES, percent: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_words, n_licenses, licenses (matched template ids, sorted and
    comma-joined), best_percent (whole percent of the best match's containment, 0 without one).

    A template matches where a stretch of a text, 1.25 times its shingles long and starting at one of
    them, holds at least ``percent`` of its distinct five-word shingles. Null, empty and wordless texts
    match nothing; templates of fewer than five words or without an id can't match, and texts of one id are
    one template. Repeated rows and null ids are judged row by row; other columns aren't carried.

    Templates are a table (id, text) of any size. Their bands are joined to those of the texts by equality; a
    band that both have names a candidate. Only candidates' texts are read again, and the shingles they share
    with a template are counted over stretches. A table is broadcast if it has at most ``most_broadcast``
    rows of two numbers or an id and a number, else both sides shuffle."""
    spark = docs.sparkSession
    table = template_table(spark, templates) if isinstance(templates, dict) else templates.select(F.col("id").cast("string").alias("id"), text_or_empty(F.col("text")).alias("text"))
    known = table.filter("id is not null").select("id", word_hashes(F.col("text")).alias("h")).select("id", shingles(F.col("h")).alias("s")).filter(F.size("s") > 0)
    known = stored(known, "templates")
    own = stored(known.select("id", F.explode("s").alias("s")).distinct(), "template-shingles")
    size = stored(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.expr("(5 * n + 3) div 4")), "template-sizes")
    n, found = F.size("s"), []
    for k, (wide, _) in enumerate(SCALES):
        fit = (n * 2 >= wide * 3 if wide > 2 else F.lit(True)) & (n * 2 < SCALES[k - 1][0] * 3 if k else F.lit(True))
        found.append(template_bands(known.filter(fit), wide, "id"))
    index = stored(found[0].unionByName(found[1]).distinct(), "template-bands")

    rows = with_rows(docs.select("doc_id", "text")).select("row_", "doc_id", text_or_empty(F.col("text")).alias("text"))
    grams = lambda df, *keys: df.select(*keys, word_hashes(F.col("text")).alias("h")).select(*keys, shingles(F.col("h")).alias("s"))
    met = text_bands(grams(rows, "row_"), "row_").join(_small(index, most_broadcast), "band").select("row_", "id").distinct()
    near = stored(met.groupBy("row_").agg(F.collect_set("id").alias("ids")), "candidates")

    shared = grams(rows.join(_small(near, most_broadcast // 10), "row_"), "row_", "ids").select("row_", "ids", F.posexplode_outer("s").alias("pos", "s"))
    # (the outer kind keeps the optimizer from a filter below that would make the shingles anew for each place)
    hits = shared.select("row_", "pos", "s", F.explode("ids").alias("id")).join(_small(own, most_broadcast), ["id", "s"])
    # a shingle counts in the stretches that begin behind its last occurrence, and that reach it
    before = F.lag("pos").over(Window.partitionBy("row_", "id", "s").orderBy("pos"))
    begin = F.greatest(F.coalesce(before, F.lit(-1)), F.col("pos") - F.col("span")) + 1
    hits = hits.join(_small(size, most_broadcast), "id").select("row_", "id", "n", begin.alias("begin"), "pos")
    steps = hits.select("row_", "id", "n", F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy("row_", "id", "n", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    held = F.sum("d").over(Window.partitionBy("row_", "id").orderBy("at"))
    best = steps.withColumn("held", held).groupBy("row_", "id", "n").agg(F.max("held").alias("held")).filter(F.col("held") * 100 >= percent * F.col("n"))
    best = best.groupBy("row_").agg(F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("licenses"), F.max(F.expr("100 * held div n")).alias("best_percent"))
    best = stored(best, "matches")

    words = rows.select("row_", "doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).cast("long").alias("n_words"))
    out = words.join(_small(best, most_broadcast // 10), "row_", "left")
    none = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    return out.select("doc_id", "n_words", none("n_licenses", 0).cast("long"), none("licenses", ""), none("best_percent", 0).cast("long"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


_ROWS = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())
OP5_SQL = rf"""
WITH t AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_ROWS}) v(id, text)),
ts AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT id, count(*) AS n, (5 * count(*) + 3) // 4 AS span FROM ts GROUP BY id),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hits AS (SELECT doc_id, id, i, g FROM ds JOIN ts USING (g)),
reg AS (SELECT a.doc_id, a.id, a.i, count(DISTINCT b.g) AS m FROM hits a JOIN tn USING (id) JOIN hits b ON a.doc_id = b.doc_id AND a.id = b.id AND b.i BETWEEN a.i AND a.i + span - 1 GROUP BY ALL),
best AS (SELECT doc_id, id, 100 * max(m) // any_value(n) AS p, 100 * max(m) >= 80 * any_value(n) AS ok FROM reg JOIN tn USING (id) GROUP BY doc_id, id),
m AS (SELECT doc_id, count(*) AS n_licenses, string_agg(id, ',' ORDER BY id) AS licenses, max(p) AS best_percent FROM best WHERE ok GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, cast(coalesce(best_percent, 0) AS bigint) AS best_percent
FROM d LEFT JOIN m USING (doc_id)
"""
