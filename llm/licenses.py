"""License scans: min-hash bands over overlapping windows, then exact containment.

DataFrame functions only. Words make five-word shingles. A template is compared with
windows of a fixed number of shingles that overlap by half, so any stretch as long as the
template lies whole in one of them. Windows that share the value of one band with a
template are its candidates; they match if they hold most of its shingles, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, quoted, stored

SHINGLE = 5
#: Part of a template's shingles that a text must hold, and the probability with which a
#: window that holds as much shares a band.
CONTAINMENT, RECALL = 0.8, 0.9999

_WORD = r"[\p{L}\p{N}]+"
_HASHES = "array<bigint>"

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "{} as published by the Free Software Foundation, either version {} of the License, "
    "or (at your option) any later version."
)
_GNU_LINE = "This work is licensed under the GNU {}, version {}."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_CC_LINE = "This work is licensed under a Creative Commons {} 4.0 International License."
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)

# License notices by name; a suffix from _FORMS tells notices of one license apart. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions"
    ),
    "AGPL-3.0": _GNU_LINE.format(_AGPL, 3),
    "AGPL-3.0-header": _GNU.format(_AGPL, 3),
    "BSD-2-Clause-text": _BSD_2 + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause-text": _BSD_2
    + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "CC-BY-NC-4.0-line": _CC_LINE.format("Attribution-NonCommercial"),
    "CC-BY-SA-4.0-line": _CC_LINE.format("Attribution-ShareAlike"),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide."
    ),
    "GPL-2.0": _GNU_LINE.format(_GPL, 2),
    "GPL-2.0-header": _GNU.format(_GPL, 2),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1": _GNU_LINE.format(_LGPL, "2.1"),
    "LGPL-2.1-header": _GNU.format(_LGPL, "2.1"),
    "LGPL-3.0": _GNU_LINE.format(_LGPL, 3),
    "LGPL-3.0-header": _GNU.format(_LGPL, 3),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
_FORMS = "-(header|line|permission|text)$"


def window_size(shingles: int) -> int:
    """Shingles per window for a template: the power of two from twice its own number on.

    Windows start every half window, so a stretch of half a window lies whole in one.
    """
    return 1 << (2 * shingles - 1).bit_length()


def bands_needed(shingles: int) -> int:
    """Bands of one value each, so that a window with ``CONTAINMENT`` of a template's
    shingles, all others different, shares one with probability ``RECALL``."""
    size, shared = window_size(shingles), math.ceil(CONTAINMENT * shingles)
    jaccard = shared / (size + shingles - shared)
    return 1 if jaccard >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - jaccard))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _shingle_hashes(words: Column) -> Column:
    """A hash for every shingle of the words; none if there are too few."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]),
    )
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.expr(f"cast(array() as {_HASHES})"))


def _shingle_texts(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: F.array_join(F.slice(words, i + 1, F.lit(SHINGLE)), " "),
    )


def _band(hashes: Column, band: Column) -> Column:
    """The min-hash of a band."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """One row per template: name, its shingles' texts and hashes, window size, bands."""
    pairs = [F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in templates.items()]
    rows = (
        spark.range(1).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
        if pairs
        else spark.range(0).selectExpr("'' as license", "'' as text")
    )
    sized = (
        rows.withColumn("words", _words(F.col("text")))
        .where(F.size("words") >= SHINGLE)
        .select(
            "license",
            F.array_distinct(_shingle_texts(F.col("words"))).alias("shingles"),
            F.array_distinct(_shingle_hashes(F.col("words"))).alias("hashes"),
        )
    )
    numbers = [r[0] for r in sized.select(F.size("hashes")).distinct().collect()]
    window, bands = F.lit(1), F.lit(1)
    for n in numbers:
        window = F.when(F.size("hashes") == n, F.lit(window_size(n))).otherwise(window)
        bands = F.when(F.size("hashes") == n, F.lit(bands_needed(n))).otherwise(bands)
    return sized.withColumns({"window": window, "bands": bands})


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    decide: bool = False,
) -> DataFrame:
    """(doc_id, license, containment, first_word, last_word): the templates in each text.

    One row per row of ``docs`` and template: of the windows that hold the largest part of
    the template's shingles the first one, with the places of the first and the last word
    of these shingles in the text, counted from 0.

    With ``decide``, a place where another license was found over the same words, with all
    the shingles found of this one and more, doesn't count: GPL 2 and 3 differ by a number.
    If neither license has more of the text, both count.

    A window can only share a band with a template if it holds the shingle that is the
    template's minimum there. Texts without any of those shingles are left out first; this
    loses nothing. The table of templates is the caller's and small; it is broadcast.

    Defined cases: null, empty and too short texts match nothing; equal rows match each
    for itself; an empty table, or templates of fewer than five words, give no rows;
    other columns are not read.
    """
    table = template_table(docs.sparkSession, templates)
    minima = (
        table.select(
            "license",
            "shingles",
            "window",
            F.explode(
                F.expr(
                    "transform(sequence(1, bands), b -> named_struct('band', b, 'value', "
                    "array_min(transform(hashes, h -> xxhash64(h, b))), 'least', "
                    "array_min(transform(hashes, h -> named_struct('x', xxhash64(h, b), 'h', h))).h))"
                )
            ).alias("x"),
        )
        .select("license", "shingles", "window", "x.*")
    )
    # A few numbers per template of the caller's.
    told = [r["least"] for r in minima.select("least").distinct().collect()]
    sizes = {r["window"]: r["bands"] for r in table.groupBy("window").agg(F.max("bands").alias("bands")).collect()}
    rows = docs.select(
        quoted(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("_row"),
        _words(quoted(text_col)).alias("words"),
    ).withColumn("hashes", _shingle_hashes(F.col("words")))
    marked = F.array(*[F.lit(h) for h in told]).cast(_HASHES)
    rows = rows.where(F.arrays_overlap("hashes", marked))
    if not sizes:
        none = "doc_id, cast('' as string) license, 0D containment, 0L first_word, 0L last_word"
        return rows.where("false").selectExpr(*none.split(", "))
    # Windows that hold none of the marked shingles share no band either.
    windows = F.flatten(
        F.array(
            *[
                F.filter(_windows(size, bands), lambda w: F.arrays_overlap(w["hashes"], marked))
                for size, bands in sorted(sizes.items())
            ]
        )
    )
    cut = rows.select("doc_id", "_row", "words", F.explode(windows).alias("w")).select(
        "doc_id",
        "_row",
        F.col("w.at").alias("at"),
        F.col("w.size").alias("window"),
        # The window's words, for the exact check.
        F.slice("words", F.col("w.at") + 1, F.col("w.size") + SHINGLE - 1).alias("words"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("w.bands")),
                lambda b: F.struct(b.alias("band"), _band(F.col("w.hashes"), b).alias("value")),
            )
        ).alias("b"),
    )
    cut = cut.select("doc_id", "_row", "at", "window", "words", "b.band", "b.value")
    hits = (
        cut.join(F.broadcast(minima.drop("least")), ["window", "band", "value"])
        .groupBy("_row", "at", "license")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "words", "shingles")])
        .withColumn("own", _shingle_texts(F.col("words")))
        .withColumn(
            "places",
            F.filter(
                F.transform("own", lambda s, i: F.when(F.array_contains("shingles", s), i)), lambda i: i.isNotNull()
            ),
        )
        .withColumn(
            "containment",
            F.size(F.array_intersect("own", "shingles")) / F.size("shingles"),
        )
        .where(F.col("containment") >= CONTAINMENT)
    )
    if decide:
        hits = _decided(hits)
    best = hits.groupBy("_row", "license").agg(
        F.max_by(
            F.struct(
                "doc_id",
                "containment",
                (F.col("at") + F.array_min("places")).cast("long").alias("first_word"),
                (F.col("at") + F.array_max("places") + SHINGLE - 1).cast("long").alias("last_word"),
            ),
            F.struct("containment", -F.col("at")),
        ).alias("x")
    )
    return best.select("x.doc_id", "license", "x.containment", "x.first_word", "x.last_word")


def _decided(hits: DataFrame) -> DataFrame:
    """The hits that no other license explains better over the same words."""
    hits = stored(
        hits.select(
            "_row",
            "doc_id",
            "at",
            "license",
            "places",
            "containment",
            F.regexp_replace("license", _FORMS, "").alias("name"),
            F.array_intersect("own", "shingles").alias("found"),
            (F.col("at") + F.array_min("places")).alias("from"),
            (F.col("at") + F.array_max("places") + SHINGLE - 1).alias("to"),
        )
    )
    rivals = hits.select(*[F.col(c).alias(f"r_{c}") for c in ("_row", "name", "found", "from", "to")])
    return hits.join(
        rivals,
        (F.col("_row") == F.col("r__row"))
        & (F.col("name") != F.col("r_name"))
        & (F.col("from") <= F.col("r_to"))
        & (F.col("to") >= F.col("r_from"))
        & (F.size("r_found") > F.size("found"))
        & (F.size(F.array_except("found", "r_found")) == 0),
        "left_anti",
    )


def _windows(size: int, bands: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(max(1, size // 2))),
        lambda at: F.struct(
            at.cast("int").alias("at"),
            F.lit(size).alias("size"),
            F.lit(bands).alias("bands"),
            F.slice("hashes", at + 1, F.lit(size)).alias("hashes"),
        ),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), decide=True)
