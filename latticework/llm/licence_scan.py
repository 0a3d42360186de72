"""Licence scans in DataFrame functions: a trained paragraph classifier, confirmed against templates."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written

# Well-known public notices, by licence family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "This software is distributed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "Licensed under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "creative_commons": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "Licensed under CC BY 4.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No part may be reproduced without written permission.",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9\u0080-\uffff]+", text.lower()) if w]


def _pairs(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


#: Words that tell something: the long ones of the templates, and these short ones.
CONTENT = {w for ts in TEMPLATES.values() for t in ts for w in _words(t) if len(w) >= 6} | {"mit", "bsd", "gnu", "mpl", "spdx", "cc"}


def _telling(text: str) -> list[str]:
    """The pairs of a text with a content word."""
    return [p for p in _pairs(text) if CONTENT & set(p.split(" "))]


#: The sparse features: word pairs of the templates that have a content word. All others have no weight.
VOCABULARY = sorted({p for ts in TEMPLATES.values() for t in ts for p in _telling(t)})


def _split(text: Column) -> Column:
    return F.split(F.lower(text), r"[^a-z0-9\u0080-\uffff]+")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, doc_id, paragraph_no, paragraph)``: the lines of each text, null texts having one empty line."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)).alias("paragraph_no", "paragraph")
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), lines)


def terms(lines: DataFrame) -> DataFrame:
    """Adds a row for each word pair ``term`` of ``paragraph``."""
    words = lines.select("*", _split(F.col("paragraph")).alias("w")).drop("paragraph")
    both = F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    return words.select(*[c for c in words.columns if c != "w"], F.explode(both).alias("term"))


def ordinary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(terms, half, n)``: how many lines of all texts, without those that have most of a template, have these terms of VOCABULARY; lines are halved by a hash of their text. The lines without terms are the row of no terms and half -1."""
    docs = docs.where(F.col(text_col).isNotNull()).select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    some = docs.where(F.arrays_overlap(_split(F.col("text")), F.lit(sorted(CONTENT))))  # no other has a term
    lines = paragraphs(some, "id", "text").withColumn("w", _split(F.col("paragraph")))
    own = F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    lines = lines.select(F.pmod(F.xxhash64("paragraph"), F.lit(2)).cast("int").alias("half"), F.sort_array(F.array_intersect(own, F.lit(VOCABULARY))).alias("terms")).where(F.size("terms") > 0)
    counts = written(lines.groupBy("terms", "half").agg(F.count(F.lit(1)).alias("n")))
    every = docs.agg(F.sum(F.size(F.split("text", "\n", -1))).alias("all"))
    none = every.crossJoin(counts.agg(F.sum("n").alias("some"))).select(F.array().cast("array<string>").alias("terms"), F.lit(-1).alias("half"), (F.coalesce("all", F.lit(0)) - F.coalesce("some", F.lit(0))).alias("n"))
    whole = F.greatest(*[F.size(F.array_intersect("terms", F.lit(_telling(t)))) / len(_telling(t)) for ts in TEMPLATES.values() for t in ts])
    return counts.where(whole < 0.6).unionByName(none)


def _scored(terms: Column, table: list, bias: list[float]) -> Column:
    """The classes' scores of the sum of the terms' weights."""
    of, lookup = F.lit([t for t, _ in table]), F.lit([w for _, w in table])
    return F.aggregate(terms, F.lit(bias), lambda acc, t: F.zip_with(acc, F.element_at(lookup, F.array_position(of, t).cast("int")), lambda a, b: a + b))


def _least_above(scores: DataFrame, allowed: float) -> float:
    """The least of 0.5 and the values ``p`` above it that at most ``allowed`` rows, counted by ``n``, exceed; found by ever finer histograms of 4,096 bins."""
    low, high, above = 0.5, 1.0, 0
    while True:
        place = F.least(F.floor((F.col("p") - low) * (4096 / (high - low))), F.lit(4095)) if high > low else F.lit(0)
        rows = scores.where((F.col("p") > 0.5) & F.col("p").between(low, high)).groupBy(place.alias("at")).agg(F.sum("n").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).orderBy(F.desc("at")).collect()
        for r in rows:
            if above + r["n"] > allowed:
                break
            above += r["n"]
        else:
            return 0.5
        if r["low"] == r["high"]:
            return r["low"]
        low, high = r["low"], r["high"]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: float = 2000.0, positives: float = 9.0, false_share: float = 0.001) -> tuple[list[tuple[str, list[float]]], list[float], float]:
    """Weights by term and class, the classes' intercepts, and the probability that a prediction needs.

    Positives are the templates' sentences, each with the weight ``positives``. The unknown class has all lines of all texts, without those that have most of a template: those of
    one half by a hash of the line are fitted, as sets of terms with their numbers, which are scaled to at most ``unknown`` together, so that many ordinary lines don't outweigh the
    templates. The threshold leaves at most ``false_share`` of all lines of the other half above it, and is 0.5 at least. Lines without terms count for one half each.
    Null texts have no lines; ids play no part; without documents the unknown class is the empty line alone and the threshold 0.5.
    """
    spark = docs.sparkSession
    lines = written(ordinary(docs, text_col)).withColumn("n", F.when(F.col("half") == -1, F.col("n") / 2).otherwise(F.col("n").cast("double")))
    fitted, held = lines.where("half <= 0"), lines.where("half <> 0")
    total = fitted.agg(F.sum("n")).first()[0] or 0.0
    templates = [(float(FAMILIES.index(f)), _telling(t), positives) for f, ts in TEMPLATES.items() for t in ts]
    own = spark.createDataFrame([(0.0, [], 1.0), *templates], "label double, terms array<string>, weight double").coalesce(1)
    vectors = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="terms", outputCol="features")
    rows = fitted.where("n > 0").select(F.lit(0.0).alias("label"), "terms", (F.col("n") * min(1.0, unknown / max(total, 1.0))).alias("weight")).unionByName(own)
    model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", weightCol="weight").fit(vectors.transform(rows))
    weight = model.coefficientMatrix.toArray()
    table = [(t, [float(x) for x in weight[:, i]]) for i, t in enumerate(VOCABULARY)]
    bias = [float(x) for x in model.interceptVector.toArray()]
    z = held.select("n", _scored(F.col("terms"), table, bias).alias("z")).select("n", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("z"))
    scores = z.select("n", (F.array_max(F.slice("z", 2, len(FAMILIES))) / F.aggregate("z", F.lit(0.0), lambda a, b: a + b)).alias("p"))
    return table, bias, _least_above(scores, false_share * (held.agg(F.sum("n")).first()[0] or 0.0))


def scan(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """``(doc_id, paragraph_no, family, probability, template_share, confirmed)`` of each paragraph that isn't of the unknown class.

    A paragraph is a line. Its word pairs are joined to the model's weights (a fixed vocabulary, so a
    bounded broadcast) and summed; one without any such pair has the intercepts alone, which are the unknown class's. Its family is the
    likeliest class (of equal ones the first of FAMILIES), or unknown, and left out, below the calibrated limit. A prediction is confirmed when one of the family's templates
    has at least ``confirm`` of its word pairs in the paragraph. Null, empty and wordless texts give nothing; null ids are ids like any other; repeated rows give
    repeated results; other columns are ignored; empty in, empty out.
    """
    table, bias, limit = model
    weights = docs.sparkSession.createDataFrame(table, "term string, weight array<double>")
    some = docs.where(F.arrays_overlap(_split(F.col(text_col).cast("string")), F.lit(sorted(CONTENT))))  # no other has a feature
    hits = terms(paragraphs(some, id_col, text_col)).join(F.broadcast(weights.select("term")), "term").distinct()
    found = hits.groupBy("uid", "paragraph_no").agg(F.first("doc_id").alias("doc_id"), F.collect_set("term").alias("found"))
    scores = found.select("doc_id", "paragraph_no", "found", _scored(F.col("found"), table, bias).alias("z"))
    out = scores.select("doc_id", "paragraph_no", "found", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("z"))
    out = out.select("doc_id", "paragraph_no", "found", F.slice("z", 2, len(FAMILIES)).alias("known"), F.aggregate("z", F.lit(0.0), lambda a, b: a + b).alias("total"))
    out = out.withColumn("probability", F.array_max("known") / F.col("total")).where(F.col("probability") >= limit)
    out = out.withColumn("family", F.element_at(F.lit(FAMILIES[1:]), F.array_position("known", F.array_max("known")).cast("int")))
    shares = F.greatest(*[F.when(F.col("family") == f, F.size(F.array_intersect(F.lit(_telling(t)), F.col("found"))) / len(_telling(t))).otherwise(F.lit(0.0)) for f, ts in TEMPLATES.items() for t in ts])
    return out.withColumn("template_share", shares).select("doc_id", "paragraph_no", "family", "probability", "template_share", (F.col("template_share") >= confirm).alias("confirmed"))
