"""Licence families of paragraphs, by a trained classifier and template comparison.

A paragraph is a line of a text, or a passage of a block: a run of non-blank lines, joined by
blanks, so that wrapped notices are read as one. In a block, a passage begins wherever a
three-word shingle of a notice stands and is a little longer than the notice; the one that
holds most of the notice is judged. A block counts only for families that none of its lines
is confirmed for. The features of a paragraph are the distinct words and
pairs of neighbouring words, hashed. A multinomial logistic regression with an L1 term tells licence
families and an unknown class apart. It is trained here: notices of each family, alone and
inside ordinary paragraphs of the corpus, against ordinary paragraphs. A temperature fitted
on paragraphs kept from training calibrates the probabilities, the unknown class included.
A predicted family is confirmed when the paragraph holds enough of the three-word shingles
of one of its notices.

Only DataFrame functions and Spark's own learning library are used. Training reads an
expected ``SAMPLE`` paragraphs; prediction reads every paragraph of every text where it lies,
and only confirmed ones are grouped. The model has (families + 1) x ``FEATURES`` weights.

Null and empty texts have no paragraph and give no row; an empty table gives none. Repeated
rows count their paragraphs again. Rows without an id are reported together under null. A
corpus too small to sample from gives no row, as there is nothing to learn from.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions.once import computed_once
from respeval.llm.tables import stored, text_or_empty, uniform

FEATURES = 1 << 14
SAMPLE = 4000
MIN_PROBABILITY = 0.5
MIN_CONTAINED = 0.6
#: Shingles of a passage for each shingle of the notice, so that inserted words fit in.
ROOM = 1.25
UNKNOWN = "unknown"
_BLANK_LINES = r"\n(?:[ \t\r\f\x0b]*+\n)++"
_TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)

#: Short public notices of each family.
NOTICES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is released into the public domain under the Creative Commons Zero license.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.,;:]+(?=\s|$)"), "")


def _runs(words: Column, k: int) -> Column:
    """Runs of ``k`` words; of fewer words, all of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.transform(starts, lambda at: F.array_join(F.slice(words, at, F.lit(k)), " "))


def _features(words: Column) -> Column:
    return F.concat(words, F.when(F.size(words) > 1, _runs(words, 2)).otherwise(F.array().cast("array<string>")))


def _lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    lines = F.explode(F.split(text_or_empty(text), "\n"))
    return docs.select(F.col(key).alias("key"), lines.alias("line")).where(F.trim("line") != "")


def _with_words(lines: DataFrame) -> DataFrame:
    return computed_once(lines, {"words": _words(F.col("line"))}).where(F.size("words") > 0)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``line`` and ``words`` of every line that has a word."""
    return _with_words(_lines(docs, key, text))


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    blocks = F.explode(F.split(text_or_empty(), _BLANK_LINES))
    blocks = docs.select(F.col(key).alias("key"), blocks.alias("whole")).where(F.trim("whole") != "")
    return blocks.withColumn("block", F.struct(F.xxhash64("whole").alias("a"), F.xxhash64(F.lit(7), "whole").alias("b")))


def _block_lines(blocks: DataFrame) -> DataFrame:
    """The lines of blocks, as paragraphs that are no part of a notice (``at`` is -1)."""
    lines = blocks.select("key", "block", F.lit(-1).alias("at"), F.explode(F.split("whole", "\n")).alias("line"))
    return _with_words(lines.where(F.trim("line") != ""))


def _passages(blocks: DataFrame, notices: list, min_contained: float) -> DataFrame:
    """Per block of several lines and notice that it may hold, the passage that holds most of it."""
    own = {row["at"]: sorted({w for s in row["shingles"] for w in s.split(" ")}) for row in notices}
    # So many shingles of a notice have so many distinct words at least.
    need = {
        row["at"]: max(1, math.ceil(min_contained * len(row["shingles"]) - 1e-9) - len(row["shingles"]) + len(own[row["at"]]))
        for row in notices
    }
    listed = lambda words: F.split(F.lit("\n".join(words)), "\n")
    several = blocks.where(F.trim("whole").contains("\n"))
    several = computed_once(several, {"words": _words(F.regexp_replace("whole", "\n", " "))}, ["key", "block"])
    vocabulary = listed(sorted(set().union(*own.values())))
    several = computed_once(several, {"_known_": F.array_intersect("words", vocabulary)})
    several = several.where(F.size("_known_") >= min(need.values()))
    maybe = [
        F.when(F.size(F.array_intersect("_known_", listed(own[row["at"]]))) >= need[row["at"]], F.lit(row["at"]))
        for row in notices
    ]
    several = several.withColumn("at", F.explode(F.array_compact(F.array(*maybe)))).drop("_known_")
    table = F.array(*[listed(row["shingles"]) for row in sorted(notices, key=lambda r: r["at"])])
    several = computed_once(several, {"runs": _runs(F.col("words"), 3), "shingles": F.get(table, F.col("at"))})
    starts = F.filter(
        F.sequence(F.lit(1), F.size("runs")), lambda i: F.array_contains("shingles", F.get("runs", i - 1))
    )
    room = F.ceil(F.size("shingles") * ROOM).cast("int")
    held = lambda i: F.size(F.array_intersect(F.slice("runs", i, room), "shingles"))
    best = F.array_max(F.transform(starts, lambda i: F.struct(held(i).alias("n"), (-i).alias("at"))))
    found = computed_once(several, {"best": best, "n": F.size("shingles"), "room": room}, ["key", "block", "at", "words"])
    found = found.where(F.col("best.n") >= F.lit(min_contained) * F.col("n"))
    passage = F.slice("words", -F.col("best.at"), F.col("room") + 2)
    found = computed_once(found, {"words": passage}, ["key", "block", "at"])
    return found.select("key", "block", "at", F.array_join("words", " ").alias("line"), "words")


def _notices(docs: DataFrame) -> DataFrame:
    rows = [(family, text) for family in sorted(NOTICES) for text in NOTICES[family]]
    literals = [
        F.struct(F.lit(i).alias("at"), F.lit(family).alias("family"), F.lit(text).alias("notice"))
        for i, (family, text) in enumerate(rows)
    ]
    table = docs.sparkSession.range(1).select(F.inline(F.array(*literals)))
    return table.withColumn("shingles", F.array_distinct(_runs(_words(F.col("notice")), 3)))


def _with_contained(rows: DataFrame, notices: list, family: str | None = None) -> DataFrame:
    """``contained``: the largest share of a notice's shingles, for its family or any."""
    rows = computed_once(rows, {"_own_": F.array_distinct(_runs(F.col("words"), 3))})
    shares = []
    for row in notices:
        listed = F.split(F.lit("\n".join(row["shingles"])), "\n")
        share = F.size(F.array_intersect("_own_", listed)) / F.lit(len(row["shingles"]))
        shares.append(share if family is None else F.when(F.col(family) == row["family"], share))
    return computed_once(rows, {"contained": F.greatest(*shares)}).drop("_own_")


def _hashed(rows: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_features_", outputCol="features")
    return hashing.transform(rows.withColumn("_features_", _features(F.col("words")))).drop("_features_")


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[LogisticRegressionModel, float, list, list[str]] | None:
    """The model, its temperature, the notices and the classes in order of their index."""
    lines = _lines(docs)
    total = lines.count()
    table = _notices(docs)
    notices = table.collect()
    families = sorted(NOTICES) + [UNKNOWN]
    drawn = uniform(F.struct("key", "line"), 8)
    few = _with_words(lines.where(drawn < min(1.0, sample / max(total, 1)))).drop("key")
    # Notices in the corpus must not be learned as ordinary text.
    few = _with_contained(few, notices).where(F.col("contained") < 0.5).select("line")
    few = stored(few, "paragraphs")
    if few.isEmpty():
        return None
    index = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    place = F.pmod(F.xxhash64("line"), F.lit(len(notices))).cast("int")
    within = few.withColumn("at", place).join(table, "at")
    examples = (
        few.select("line", F.lit(UNKNOWN).alias("family"))
        .unionAll(within.select(F.concat_ws(" ", "notice", "line").alias("line"), "family"))
        .unionAll(within.select(F.concat_ws(" ", "line", "notice").alias("line"), "family"))
        .unionAll(table.select(F.col("notice").alias("line"), "family"))
    )
    examples = examples.select("line", _words(F.col("line")).alias("words"), index.cast("double").alias("label"))
    # A bounded sample: few partitions keep the many passes of training short.
    examples = stored(_hashed(examples).repartition(8), "license-examples")
    kept = uniform(F.col("line"), 9) < 0.2
    learner = LogisticRegression(
        family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.5, standardization=False
    )
    model = learner.fit(examples.where(~kept))
    scored = model.transform(examples.where(kept)).select("label", vector_to_array("rawPrediction").alias("raw"))

    def loss(temperature: float) -> Column:
        scaled = F.transform("raw", lambda x: x / temperature)
        whole = F.aggregate(F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled))), F.lit(0.0), lambda t, x: t + x)
        own = F.get(scaled, F.col("label").cast("int"))
        return F.avg(F.log(whole) + F.array_max(scaled) - own)

    losses = scored.agg(*[loss(t) for t in _TEMPERATURES]).first()
    best = min(range(len(_TEMPERATURES)), key=lambda i: losses[i] if losses[i] is not None else abs(i - 3))
    return model, _TEMPERATURES[best], notices, families


def licensed(
    docs: DataFrame,
    key: str = "doc_id",
    min_probability: float = MIN_PROBABILITY,
    min_contained: float = MIN_CONTAINED,
    sample: int = SAMPLE,
) -> DataFrame:
    """Confirmed licence paragraphs: ``key``, ``line``, ``family``, ``probability``, ``contained``.

    ``block`` stands for the block they are in; ``at`` is the notice that led to a passage of
    several lines, and -1 for lines.
    """
    trained = train(docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs, sample)
    blocks = _blocks(docs, key)
    lines = _block_lines(blocks)
    if trained is None:
        none = lines.select(F.col("key").alias(key), "block", "at", "line", F.lit("").alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("contained"))
        return none.where("false")
    model, temperature, notices, families = trained
    carried = ["key", "block", "at", "line", "words"]
    lines = lines.select(*carried).unionAll(_passages(blocks, notices, min_contained).select(*carried))
    scored = model.transform(_hashed(lines)).select(*carried, "rawPrediction")
    scored = computed_once(scored, {"raw": vector_to_array("rawPrediction")}, carried)
    odds = F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / temperature))
    figures = {
        "class": F.array_position("raw", F.array_max("raw")).cast("int"),
        "probability": 1.0 / F.aggregate(odds, F.lit(0.0), lambda total, x: total + x),
    }
    predicted = computed_once(scored, figures, carried)
    predicted = predicted.where((F.col("class") < len(families)) & (F.col("probability") >= min_probability))
    named = F.array(*[F.lit(f) for f in families])[F.col("class") - 1]
    checked = _with_contained(predicted.withColumn("family", named), notices, "family")
    return checked.where(F.col("contained") >= min_contained).select(
        F.col("key").alias(key), "block", "at", "line", "family", "probability", "contained"
    )


def document_licenses(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``key``, ``family``, its paragraphs in the document, and the best figures of these."""
    best = [F.max("probability").alias("probability"), F.max("contained").alias("contained")]
    # A passage that several notices of a family led to is one paragraph.
    each = licensed(docs, key, sample=sample).groupBy(key, "family", "block", "at").agg(F.count(F.lit(1)).alias("n"), *best)
    of_lines = F.max(F.when(F.col("at") < 0, F.col("n")))
    of_block = each.groupBy(key, "family", "block").agg(F.coalesce(of_lines, F.max("n")).alias("n"), *best)
    return of_block.groupBy(key, "family").agg(F.sum("n").alias("n_paragraphs"), *best)
