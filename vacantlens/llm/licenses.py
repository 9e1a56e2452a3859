"""Licence paragraphs: a trained classifier names the family, templates confirm it.

A paragraph is a line of a text. Its features are hashed words and word pairs; a multinomial
logistic regression (Spark ML) tells the licence families and "unknown" apart. It is fitted to
parts of the templates below and to ``SAMPLE`` paragraphs of the corpus that share no run of
three words with a template. A second, one-variable regression on held-out rows turns the margin
of the best family over "unknown" into the calibrated probability of being unknown. A predicted
paragraph is confirmed by the share of its three-word runs that its family's templates hold.
Only DataFrame and Spark ML functions are used; scoring is one pass without a shuffle.

Defined cases: null and empty texts and paragraphs of fewer than ``LEAST_WORDS`` words give no
row; equal paragraphs of a document give a row each; a null doc_id is kept; a corpus without
paragraphs gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantlens.llm.columns import once

UNKNOWN = "unknown"
LEAST_WORDS = 3
FEATURES = 1 << 14
#: Paragraphs of the corpus that train the unknown class, at most.
SAMPLE = 4000
CONFIRMED = 0.5

# Opening and granting sentences of public licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]


def words_of(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def runs_of(words: Column, size: int) -> Column:
    """Runs of ``size`` words, as strings; none where there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph_no, paragraph, words) of every line with LEAST_WORDS words or more."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("paragraph_no", "paragraph"))
    return once(lines, "words", words_of(F.col("paragraph"))).where(F.size("words") >= LEAST_WORDS)


def _hashed(rows: DataFrame) -> DataFrame:
    terms = rows.withColumn("_terms", F.concat("words", runs_of(F.col("words"), 2)))
    return HashingTF(inputCol="_terms", outputCol="_features", numFeatures=FEATURES, binary=True).transform(terms).drop("_terms")


def template_table(spark: SparkSession) -> DataFrame:
    """(family, words, runs) of every template."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    table = spark.createDataFrame(rows, "family string, text string").coalesce(1)
    return once(table, "words", words_of(F.col("text"))).select("family", "words", runs_of(F.col("words"), 3).alias("runs"))


@dataclass
class Classifier:
    model: LogisticRegressionModel
    calibration: LogisticRegressionModel
    runs: dict[str, list[str]]


def _margin(rows: DataFrame) -> DataFrame:
    """Best family and its margin over unknown, from the raw scores."""
    rows = once(rows, "_scores", vector_to_array("_raw"))
    raw = F.col("_scores")
    known = F.slice(raw, 2, len(FAMILIES) - 1)
    best = F.array_max(known)
    return rows.withColumn("_best", F.array_position(known, best).cast("int")).withColumn("_margin", best - raw[0]).drop("_scores")


def _sampled(lines: DataFrame, sample: int, wanted: Column | None = None) -> DataFrame:
    """A bounded sample by hash of the distinct wanted lines, however often each of them occurs.
    Only hashes are shuffled; the last one in the sample then bounds the lines that are."""
    wanted, code = F.lit(True) if wanted is None else wanted, F.xxhash64("words")
    first = lines.where(wanted).select(code.alias("code")).distinct().orderBy("code").limit(sample)
    last = first.agg(F.max("code").alias("last")).first()["last"]
    return lines.where(code <= F.lit(last).cast("long")).where(wanted).select("words").distinct().orderBy(code, "words").limit(sample)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit the families, then calibrate the unknown class on rows held out by hash."""
    spark = docs.sparkSession
    templates = template_table(spark)
    # Whole templates and their parts of 5 and 9 words stand for a family.
    parts = [F.array("words")]
    for size in (5, 9):
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)), F.lit(2))
        parts.append(F.transform(starts, lambda i, size=size: F.slice("words", i, F.lit(size))))
    positive = templates.select("family", F.explode(F.concat(*parts)).alias("words")).distinct()
    known = templates.select(F.explode("runs").alias("run")).agg(F.collect_set("run").alias("runs")).first()["runs"]
    unlike = ~F.arrays_overlap(runs_of(F.col("words"), 3), F.array(*[F.lit(r) for r in known]))
    negative = _sampled(paragraphs(docs), sample, unlike).select(F.lit(UNKNOWN).alias("family"), "words")
    number = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    rows = _hashed(positive.unionByName(negative).withColumn("label", number.cast("double")))
    rows = rows.withColumn("_held", F.pmod(F.xxhash64("family", "words"), F.lit(4)) == 0).repartition(2).cache()
    weights = rows.withColumn("weight", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(4.0))
    regression = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction", family="multinomial", regParam=1e-4, maxIter=25, standardization=False)
    # Every family and the unknown class must be there, also in a corpus without paragraphs.
    anchor = spark.createDataFrame([(UNKNOWN, ["lorem", "ipsum", "dolor"])], "family string, words array<string>").withColumn("label", F.lit(0.0))
    anchor = _hashed(anchor).withColumn("weight", F.lit(1.0))
    model = regression.fit(weights.where(~F.col("_held")).drop("_held").unionByName(anchor))
    held = _margin(model.transform(rows.where("_held").drop("_held").unionByName(anchor.drop("weight"))))
    binary = VectorAssembler(inputCols=["_margin"], outputCol="_x").transform(held.select("_margin", (F.col("family") == UNKNOWN).cast("double").alias("_unknown")))
    calibration = LogisticRegression(featuresCol="_x", labelCol="_unknown", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", family="binomial", regParam=1e-3).fit(binary)
    rows.unpersist()
    runs = {r["family"]: sorted(r["runs"]) for r in templates.groupBy("family").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")).collect()}
    return Classifier(model, calibration, runs)


def classify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, paragraph_no, family, p_unknown, similarity, confirmed, paragraph) of every
    paragraph whose calibrated probability of being unknown is below one half."""
    model, calibration = classifier.model, classifier.calibration
    scored = _margin(model.transform(_hashed(paragraphs(docs))))
    slope, bias = float(calibration.coefficients[0]), float(calibration.intercept)
    p_unknown = 1 / (1 + F.exp(-(F.col("_margin") * slope + bias)))
    found = scored.withColumn("p_unknown", p_unknown).where("p_unknown < 0.5")
    families = F.array(*[F.lit(f) for f in FAMILIES])
    templates = F.array(*[F.array(*[F.lit(r) for r in classifier.runs.get(f, [])]).cast("array<string>") for f in FAMILIES])
    found = once(found, "_own", F.array_distinct(runs_of(F.col("words"), 3)))
    own = F.col("_own")
    shared = F.size(F.array_intersect(own, templates[F.col("_best")]))
    similarity = F.when(F.size(own) > 0, shared / F.size(own)).otherwise(F.lit(0.0))
    return (
        found.withColumn("family", families[F.col("_best")])
        .withColumn("similarity", similarity)
        .withColumn("confirmed", F.col("similarity") >= CONFIRMED)
        .select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), "family", "p_unknown", "similarity", "confirmed", "paragraph")
    )


def scan(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and find their licence paragraphs."""
    return classify(docs, train(docs))
