"""Licence detection by TF-IDF cosine to templates, inherited along directories.

A file's headers are its lines that hold a licence cue, each compared with every
template; a licence file (by its name) is compared as a whole as well. Files without a
licence of their own take that of the licence file in the nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import spread_join, whole

#: Words that mark a header line, names of licence files, and words of the vectors.
CUE = r"(?i)licen[cs]|copyright|spdx|permission|redistribut|warrant"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.\-][^/]*)?$"
TERM = "[a-z0-9]+"
#: Cosine from which a text counts as the licence.
LEAST = 0.5

# Names of licences as SPDX lists them, with their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
}


def vectors(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple], list[tuple], float]:
    """Unit vectors (template, licence, term, weight), terms with their inverse
    frequency, and that of a term in no template: ln((1 + T) / (1 + df)) + 1."""
    forms = [(name, Counter(re.findall(TERM, form.lower()))) for name, all_forms in templates.items() for form in all_forms]
    seen = Counter(t for _, terms in forms for t in terms)
    idf = {t: math.log((1 + len(forms)) / (1 + n)) + 1 for t, n in seen.items()}
    out = []
    for i, (name, terms) in enumerate(forms):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        out += [(i, name, t, n * idf[t] / norm) for t, n in terms.items()]
    return out, sorted(idf.items()), math.log(1 + len(forms)) + 1


def similarities(units: DataFrame, keys: list[str], text: str, spark: SparkSession) -> DataFrame:
    """keys, licence, similarity: each unit's cosine to its best template if that is at
    least ``LEAST``; ties go to the smaller licence name."""
    weights, idf, rare = vectors()
    own = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))
    terms = units.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")).join(own, "term", "left")
    counts = counts.withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(rare)))
    of_template = F.broadcast(spark.createDataFrame(weights, "template int, licence string, term string, share double"))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = counts.where("idf is not null").join(of_template, "term").groupBy(*keys, "template", "licence").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    found = dots.join(norms, keys).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= LEAST)
    best = F.min(F.struct((-F.col("similarity")).alias("neg"), F.col("licence")))
    return found.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.licence").alias("licence"), (-F.col("best.neg")).alias("similarity"))


def directory(path: Column) -> Column:
    """The path without its last part; the root is empty."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``files``: path, licence, similarity, origin, licence_path and
    the columns to ``keep``.

    ``origin`` is ``header`` (a cue line), ``file`` (a whole licence file), ``inherited``
    or null; ``licence_path`` is the file the licence was found in. A file's best unit
    counts, a whole file before a header at equal similarity; of several licence files
    of a directory the most similar one is inherited, then the smaller path. A null text
    has no licence, a null path is a file of that empty name in the root; rows that
    repeat a path are one file with the units of all its rows. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = files.sparkSession
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    own = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), whole(text).alias("text"), *kept)
    marked = own.where(F.col("text").rlike(CUE))
    lines = marked.select("path", F.explode(F.split("text", "\n")).alias("unit")).where(F.col("unit").rlike(CUE))
    lines = lines.select("path", F.lit("header").alias("origin"), F.col("unit"))
    complete = own.where(F.col("path").rlike(FILE_NAME)).select("path", F.lit("file").alias("origin"), F.col("text").alias("unit"))
    # equal units are compared once
    units = lines.unionByName(complete).distinct().withColumn("digest", F.md5("unit"))
    units = materialize(units)
    judged = materialize(similarities(units.select("digest", "unit").distinct(), ["digest"], "unit", spark))
    sizes = materialize(units.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(judged, "digest"))
    hits = spread_join(units.select("path", "origin", "digest"), sizes, "digest", "n").where("licence is not null")
    best = F.min(F.struct((-F.col("similarity")).alias("neg"), F.col("origin"), F.col("licence")))
    found = hits.groupBy("path").agg(best.alias("best"))
    found = materialize(found.select("path", F.col("best.licence").alias("own_licence"), (-F.col("best.neg")).alias("own_similarity"), F.col("best.origin").alias("own_origin")))

    above = found.where(F.col("path").rlike(FILE_NAME)).withColumn("dir", directory(F.col("path")))
    pick = F.min(F.struct((-F.col("own_similarity")).alias("neg"), F.col("path"), F.col("own_licence").alias("licence")))
    above = materialize(above.groupBy("dir").agg(pick.alias("pick")).select(F.col("dir").alias("holder"), "pick"))
    dirs = materialize(own.select(directory(F.col("path")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n")))
    parts = F.split("dir", "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    climbed = dirs.where("dir <> ''").select("dir", "n", F.explode(ways).alias("holder")).unionByName(dirs.where("dir = ''").select("dir", "n", F.lit("").alias("holder")))
    nearest = climbed.join(above, "holder").groupBy("dir", "n").agg(F.max(F.struct(F.length("holder").alias("depth"), F.col("pick"))).alias("near"))
    nearest = materialize(nearest.select("dir", "n", F.col("near.pick.licence").alias("up_licence"), (-F.col("near.pick.neg")).alias("up_similarity"), F.col("near.pick.path").alias("up_path")))

    rows = own.drop("text").withColumn("dir", directory(F.col("path")))
    rows = spread_join(rows, nearest, "dir", "n").drop("n").join(found, "path", "left")
    has = F.col("own_licence").isNotNull()
    return rows.select(
        F.col("path").alias(path),
        F.coalesce("own_licence", "up_licence").alias("licence"),
        F.coalesce("own_similarity", "up_similarity").alias("similarity"),
        F.when(has, F.col("own_origin")).when(F.col("up_licence").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("up_path")).alias("licence_path"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
