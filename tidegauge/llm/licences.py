"""Licences of raw artifacts: what a file says itself, or what the nearest directory above it says.

1. Every text is read whole and cut into notices: runs of lines that speak of licensing, gaps of up to ``MAX_GAP`` lines
   included. A licence file (by its name) is also one notice as a whole, and is compared as a whole with the full texts
   of ``licence_texts``, by cosine over an inverse document frequency of these texts alone.
2. Distinct notices become sparse TF-IDF vectors, inverse document frequencies taken over all distinct notices and the
   templates, and are compared with the templates by cosine. The templates are a constant of this module, so their
   terms can be broadcast; a notice that thousands of files repeat is compared once.
3. A file without a notice of its own inherits from the nearest ancestor directory that holds a licence file: the
   distinct directories are joined with their ancestors by path, then the files with their directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

MIN_COSINE = 0.6
MAX_GAP = 2

# Public licence notices and short forms.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
            " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
            " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
            " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
            " shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
                   " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
                   " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
                   " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
                   " governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
                " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
                " as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
                 " License as published by the Free Software Foundation; either version 3 of the License, or any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
                " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
                     " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
                     " conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its"
                     " contributors may be used to endorse or promote products derived from this software without specific prior"
                     " written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
            " provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
# What a line about licensing contains.
SIGNALS = (
    "licen[cs]e", "licen[cs]ing", "copyright", "all rights reserved", "spdx", "permission", "redistribut", "warrant", "public domain",
    "creative commons", "free software", "cc by", "cc0", "copyleft", "limitations under", "as published by",
)
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright|notice)([-._][^/]*)?$"

_SIGNAL = re.compile("|".join(SIGNALS), re.IGNORECASE)
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    """Lower-cased words and version numbers."""
    return _TERM.findall(text.lower())


def notices(text: str, whole: bool) -> list[str]:
    """Distinct notices of a text, each as its terms joined by blanks."""
    found = [text] if whole else []
    if _SIGNAL.search(text):
        lines, runs = text.split("\n"), []
        for at, line in enumerate(lines):
            if _SIGNAL.search(line):
                if runs and at - runs[-1][1] <= MAX_GAP + 1:
                    runs[-1][1] = at
                else:
                    runs.append([at, at])
        found += ["\n".join(lines[a:b + 1]) for a, b in runs]
    return [x for x in dict.fromkeys(" ".join(terms(f)) for f in found) if x]


@cache
def full_texts() -> tuple[list[str], dict[str, tuple[int, float]], float, np.ndarray]:
    """Names of the full licence texts, place and weight of each of their terms, the weight of others, unit vectors as rows."""
    files = sorted((f for f in resources.files("tidegauge.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    counts = [Counter(terms(f.read_text(encoding="utf-8"))) for f in files]
    df = Counter(t for c in counts for t in c)
    known = {t: (i, math.log((len(files) + 1) / (df[t] + 1)) + 1) for i, t in enumerate(sorted(df))}
    rows = np.zeros((len(files), len(known)))
    for row, c in zip(rows, counts):
        for t, n in c.items():
            row[known[t][0]] = n * known[t][1]
    return [f.name.removesuffix(".txt") for f in files], known, math.log(len(files) + 1) + 1, rows / np.linalg.norm(rows, axis=1, keepdims=True)


def full_text_of(text: str, model: tuple) -> tuple[str | None, float]:
    """The most similar full licence text and its cosine; ties: first name."""
    names, known, other, rows = model
    own, square = np.zeros(len(known)), 0.0
    for t, n in Counter(terms(text)).items():
        at, weight = known.get(t, (None, other))
        square += (n * weight) ** 2
        if at is not None:
            own[at] = n * weight
    if not square:
        return None, 0.0
    cosines = np.round(rows @ own / math.sqrt(square), 9)
    return names[int(cosines.argmax())], float(cosines.max())


def _notices(batches: Iterator[pa.RecordBatch], model: tuple, min_cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, names, cosines = [], [], [], []
        for row, (text, whole) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            own = notices(text or "", whole)
            rows += [row] * len(own)
            found += own
            names += [None] * len(own)
            cosines += [None] * len(own)
            if whole and (full := full_text_of(text or "", model))[0] and full[1] >= min_cosine:
                rows.append(row)
                found.append(None)
                names.append(full[0])
                cosines.append(full[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array(names, pa.string()), pa.array(cosines, pa.float64()), batch.column(2).take(pa.array(rows, pa.int64()))],
            names=["notice", "licence", "similarity", "artifact_path"])


def _counted(notices_: DataFrame, *keys: str) -> DataFrame:
    return notices_.select(*keys, F.explode(F.split("notice", " ")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def compared(distinct: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The best template of each row of ``distinct(notice)``: ``notice, licence, similarity``; none below ``min_cosine``."""
    spark = distinct.sparkSession
    templates = spark.createDataFrame([(i, name, " ".join(terms(text))) for i, (name, text) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    numbered = materialise(distinct.select(F.xxhash64("notice").alias("number"), "notice"))
    own, theirs = materialise(_counted(numbered, "number")), _counted(templates, "template", "licence")
    n = numbered.count() + len(TEMPLATES)
    frequency = own.select("term").unionByName(theirs.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialise(frequency.select("term", (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf")))
    weight = (F.col("tf") * F.col("idf")).alias("w")
    own = own.join(idf, "term").select("number", "term", weight)
    # A constant of this module: a few hundred rows.
    theirs = F.broadcast(theirs.join(idf, "term").select("template", "licence", "term", weight.alias("v")))
    own_norm = own.groupBy("number").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("own_norm"))
    their_norm = F.broadcast(theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("their_norm")))
    dots = own.join(theirs, "term").groupBy("number", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = (F.col("dot") / (F.col("own_norm") * F.col("their_norm"))).alias("similarity")
    scored = dots.join(own_norm, "number").join(their_norm, "template").select("number", "licence", "template", cosine)
    best = scored.groupBy("number").agg(F.max(F.struct(F.round("similarity", 9).alias("similarity"), -F.col("template"), "licence")).alias("best"))
    return numbered.join(best.where(F.col("best.similarity") >= min_cosine), "number").select("notice", "best.licence", "best.similarity")


def directory(artifact_path: Column) -> Column:
    """All of a path before its last ``/``; empty at the top."""
    return F.regexp_extract(artifact_path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, with their depths."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


def scan(artifacts: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The licence of every row of ``artifacts(artifact_path, raw_text, ...)``.

    Returns one row per input row: ``artifact_path, licence, similarity, basis`` and ``licence_path``. ``basis`` is
    ``own`` when a notice of the file itself, or all of a licence file, matches (the best counts; ties: first template), ``inherited`` when
    the nearest ancestor directory with a matching licence file decides (of several there the most similar, then the
    first path), else null with the rest. A null or empty text has no notice. A null path has no directory and inherits
    nothing; rows that repeat a path share the path's best notice. Other columns are ignored; an empty table gives an
    empty result.
    """
    is_file = F.coalesce(F.col("artifact_path").rlike(LICENCE_FILE), F.lit(False))
    read = artifacts.select("raw_text", is_file.alias("whole"), "artifact_path")
    made = schema("notice string, licence string, similarity double", ("artifact_path", artifacts.schema["artifact_path"].dataType))
    found = materialise(read.mapInArrow(partial(_notices, model=full_texts(), min_cosine=min_cosine), made))
    named = found.where("notice IS NOT NULL").select("notice", "artifact_path")
    matched = materialise(compared(named.select("notice").distinct(), min_cosine))
    full = found.where("notice IS NULL").select("artifact_path", "licence", "similarity")
    own = materialise(
        named.join(matched, "notice").select("artifact_path", "licence", "similarity").unionByName(full).groupBy("artifact_path").agg(F.max(F.struct("similarity", "licence")).alias("own"))
        .select("artifact_path", "own.licence", "own.similarity"))

    decided = own.where(F.col("artifact_path").rlike(LICENCE_FILE)).groupBy(F.array_join(
        F.filter(F.split(directory(F.col("artifact_path")), "/"), lambda p: p != ""), "/").alias("above")).agg(
        F.min(F.struct((-F.col("similarity")).alias("order"), "artifact_path", "licence", "similarity")).alias("file"))
    folders = artifacts.where("artifact_path IS NOT NULL").select(directory(F.col("artifact_path")).alias("folder")).distinct()
    # Written, so that the join below meets it in an exchange of its own and a folder with a third of all files can be split.
    inherited = materialise(
        folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("up")).select("folder", "up.depth", "up.above")
        .join(decided, "above").groupBy("folder").agg(F.max_by("file", "depth").alias("file")))

    rows = artifacts.select("artifact_path", directory(F.col("artifact_path")).alias("folder"))
    joined = rows.alias("r").join(own.alias("o"), F.col("r.artifact_path").eqNullSafe(F.col("o.artifact_path")), "left").join(inherited, "folder", "left")
    itself = F.col("o.licence").isNotNull()
    return joined.select(
        "r.artifact_path", F.coalesce("o.licence", "file.licence").alias("licence"), F.coalesce("o.similarity", "file.similarity").alias("similarity"),
        F.when(itself, "own").when(F.col("file").isNotNull(), "inherited").alias("basis"),
        F.when(itself, F.col("r.artifact_path")).otherwise(F.col("file.artifact_path")).alias("licence_path"))
