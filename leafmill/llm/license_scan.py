"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts become arrays of five-word shingle hashes.  Templates fall into size
classes that double; for each class the text is covered by overlapping windows
of one and a half times the class's size at half-size steps, so every template
lies whole in some window.  A window and a template share a candidate if any
of ``bands`` minima agree.  A window that holds 80 % of a template has a
Jaccard similarity of at least 1/6 to it, so 40 one-row bands miss it with a
probability below 0.001.  Candidates are verified by exact containment.

Two exact prefilters drop what cannot match: texts and windows without any
template shingle.

Everything on this path is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 40

#: Short notices that name a license, and opening paragraphs of common license texts (fixed values).
TEMPLATES: dict[str, str] = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT (line)": "Released under the MIT License.",
    "MIT (grant)": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "ISC (grant)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD (grant)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MPL-2.0 (notice)": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense (notice)": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (short line)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (short line)": "Licensed under CC BY-SA 4.0.",
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; the optimizer would otherwise repeat it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of the ``k``-word shingles in order (none for fewer than ``k`` words); words are runs of a-z and 0-9."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return _let(
        words,
        lambda w: F.when(
            F.size(w) >= k,
            F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _minima(h: Column, bands: int) -> Column:
    """The least value of each of ``bands`` hash functions over an array of hashes."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[least(j) for j in range(bands)])


def template_table(spark: SparkSession, templates: dict[str, str], k: int = SHINGLE) -> DataFrame:
    """``(license, _set, _class)``: each template's shingle set and size class (4, 8, 16, ...)."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, _text string")
    n = F.size("_set")
    return (
        rows.select("license", F.array_distinct(_hashes(F.col("_text"), k)).alias("_set"))
        .where(n > 0)
        .withColumn("_class", F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")))
    )


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    bands: int = BANDS,
) -> DataFrame:
    """``(<id_col>, license, containment, first_word, n_words)`` for every match.

    ``containment`` is the share of the template's shingles found in the best
    window (the earliest of equals); ``first_word`` and ``n_words`` place that
    window in the text's words.  One row per id and license whose containment
    is ``least`` or more.

    Defined cases: null, empty and short texts match nothing; templates of
    fewer than five words are ignored; repeated rows of an id merge into one
    row per license; a null id is an id like any other; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    found = template_table(spark, TEMPLATES if templates is None else templates)
    # The template set is configuration: its hashes become literals of the plan.
    sets: dict[int, set[int]] = {}
    for r in found.select("_class", "_set").collect():
        sets.setdefault(r["_class"], set()).update(r["_set"])
    names = found.select("license", "_class", "_set", F.posexplode(_minima(F.col("_set"), bands)).alias("_band", "_least"))
    lit = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<bigint>")
    every = set().union(*sets.values())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def windows(h: Column, size: int) -> Column:
        step = size // 2
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - step), F.lit(step))
        cut = F.transform(
            starts, lambda s: F.struct(F.lit(size).alias("size"), s.alias("start"), F.slice(h, s, size + step).alias("h"))
        )
        return F.filter(cut, lambda x: F.arrays_overlap(x["h"], lit(sets[size])))

    def candidates(h: Column) -> Column:
        return F.when(F.arrays_overlap(h, lit(every)), F.concat(*[windows(h, c) for c in sorted(sets)]))

    if not sets:
        return texts.limit(0).select(
            F.col("_id").alias(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"),
            F.lit(0).alias("first_word"), F.lit(0).alias("n_words"),
        )
    shown = texts.select("_id", F.explode(_let(_hashes(F.col("_text")), candidates)).alias("_x")).select(
        "_id", F.col("_x.size").alias("_class"), F.col("_x.start").alias("_start"), F.col("_x.h").alias("_h")
    )
    signed = shown.select("*", F.posexplode(_minima(F.col("_h"), bands)).alias("_band", "_least"))
    matched = signed.join(F.broadcast(names), ["_class", "_band", "_least"]).select(
        "_id",
        "license",
        "_start",
        (F.size("_h") + SHINGLE - 1).alias("_words"),
        (F.size(F.array_intersect("_h", "_set")) / F.size("_set")).alias("_share"),
    )
    best = (
        matched.where(F.col("_share") >= least)
        .groupBy("_id", "license")
        .agg(F.max(F.struct("_share", (-F.col("_start")).alias("_first"), (-F.col("_words")).alias("_words"))).alias("_best"))
    )
    return best.select(
        F.col("_id").alias(id_col),
        "license",
        F.round("_best._share", 6).alias("containment"),
        (-F.col("_best._first") - 1).cast("int").alias("first_word"),
        (-F.col("_best._words")).cast("int").alias("n_words"),
    )
