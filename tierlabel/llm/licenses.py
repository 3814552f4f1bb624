"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a document. One that can be confirmed at all shares ``least_shared`` word pairs with the
templates (this follows from ``similar`` and the shortest template), so lines that share fewer are left out before they
are scored; no confirmable line is lost. The rest become sparse
vectors of hashed words and word pairs, and a multinomial logistic regression gives a family or *unknown*. The
probability from which a family is believed is calibrated on held-out unknown paragraphs. A believed family is confirmed
if the paragraph shares ``similar`` of its word pairs with a template of that family, or the template with it.

The classifier is fitted on the templates, on stretches of them, and on all corpus paragraphs that are scored but that no
template confirms, as unknown: nothing is sampled. A fifth of these is held out, and on all of it the probability is calibrated.
Paragraphs that are not scored, for which the classifier is never asked, are not among its training rows. Equal paragraphs are one row with
their number as weight. All of it is DataFrame functions and Spark's own vectorizer and regression; scoring is one pass
over the texts without a shuffle (the templates, some dozens of fixed rows, are broadcast).

Edge cases: null and empty texts, and paragraphs of white space, give no rows; a paragraph that occurs repeatedly is
reported each time; ties of probability go to the family first in the alphabet; columns other than id and text are not
touched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Statements of license families, as they stand in notices.
TEMPLATES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced in any form without written permission of the copyright holder.",
    ],
}

# Paragraphs with the same words that state no license.
OTHERS = [
    "The officer asked for the driving license and the papers of the car.",
    "A fishing license costs ten a year and is sold at the office.",
    "They were given permission to enter the building after work.",
    "The museum asked for permission to show the painting again.",
    "Copyright law has changed many times in the last hundred years.",
    "The lecture on copyright and the press was well attended.",
    "The redistribution of land was the main promise of the party.",
    "The shop lost its license to sell wine after the fire.",
    "All rights of the accused were read to him before the trial.",
    "Licensed doctors may open a practice in the town.",
    "The general public was not admitted to the meeting.",
    "He studied at a public school and later at the institute.",
]

_WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
_TOLERANCE = 1e-6  # share of the objective that a pass gains at the end
TASK_ROWS = 20_000  # distinct training paragraphs of a task
_LEAST_PAIRS = 5  # of a paragraph that may be a part of a template


@dataclass(frozen=True)
class LicenseSettings:
    features: int = 8192
    similar: float = 0.7
    false_share: float = 0.005  # of held-out unknown paragraphs that may pass for a family
    least_probability: float = 0.5
    max_passes: int = 60  # of the training
    id_col: str = "doc_id"
    text_col: str = "text"


def _shapes() -> list[list[str]]:
    """The distinct word pairs of each template."""
    found = [re.findall(_WORD, t.lower()) for own in TEMPLATES.values() for t in own]
    return [sorted({f"{a} {b}" for a, b in zip(x, x[1:])}) for x in found]


def least_shared(settings: LicenseSettings) -> int:
    """The number of word pairs that any confirmable paragraph shares with a template."""
    return min(math.ceil(settings.similar * n - 1e-9) for n in [_LEAST_PAIRS, *map(len, _shapes())])


def _shared_at_most(text: Column) -> Column:
    """At least the number of word pairs that a text shares with the templates, from one regular expression."""
    after: dict[str, set[str]] = {}
    for pair in {p for own in _shapes() for p in own}:
        a, b = pair.split(" ")
        after.setdefault(a, set()).add(re.escape(b))
    letters: dict[str, list[str]] = {}
    for a, own in sorted(after.items()):
        letters.setdefault(a[0], []).append(f"{re.escape(a[1:])}(?=[^a-z0-9]+(?:{'|'.join(sorted(own))})(?![a-z0-9]))")
    pattern = "|".join(f"{x}(?:{'|'.join(own)})" for x, own in letters.items())
    return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z0-9])(?:{pattern})"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that filters after it do not compute again: they are not pushed below a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_terms(rows: DataFrame) -> DataFrame:
    """Add words, distinct pairs of neighbouring words, and both as terms."""
    rows = _once(rows, "words", F.regexp_extract_all(F.lower("paragraph"), F.lit(_WORD), F.lit(0)))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return _once(rows, "pairs", F.array_distinct(pairs)).withColumn("terms", F.concat("words", "pairs"))


def _near(lines: DataFrame, settings: LicenseSettings) -> DataFrame:
    """The lines that share enough word pairs with the templates to be confirmed, with their terms."""
    known = F.array(*[F.lit(p) for p in sorted({p for own in _shapes() for p in own})])
    least = F.lit(least_shared(settings))
    some = _with_terms(lines.filter(_shared_at_most(F.col("paragraph")) >= least))
    return some.filter(F.size(F.array_intersect("pairs", known)) >= least)


def paragraphs(docs: DataFrame, settings: LicenseSettings) -> DataFrame:
    """(id, place, paragraph, words, pairs, terms) of the lines that can be confirmed."""
    lines = docs.select(F.col(settings.id_col).alias("id"), F.posexplode(F.split(settings.text_col, "\n")).alias("place", "paragraph"))
    return _near(lines, settings)


def templates(spark: SparkSession) -> DataFrame:
    """(family, paragraph): fixed rows."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("paragraph")) for f, own in TEMPLATES.items() for t in own]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _alike(shape: Column) -> Column:
    """The similarity of the column ``pairs`` to a template's pairs."""
    shared = F.size(F.array_intersect(shape, F.col("pairs")))
    in_template = F.when(F.size("pairs") >= _LEAST_PAIRS, shared / F.size("pairs")).otherwise(F.lit(0.0))
    return F.greatest(shared / F.greatest(F.size(shape), F.lit(1)), in_template)


def unknown_paragraphs(lines: DataFrame, settings: LicenseSettings) -> DataFrame:
    """(paragraph, scored): the lines that are scored and that no template confirms, and all that are not scored."""
    shapes = F.array(*[F.array(*[F.lit(p) for p in own]) for own in _shapes()])
    near = _near(lines, settings).filter(F.array_max(F.transform(shapes, _alike)) < settings.similar)
    far = lines.filter(_shared_at_most(F.col("paragraph")) < least_shared(settings))
    return near.select("paragraph", F.lit(True).alias("scored")).union(far.select("paragraph", F.lit(False)))


def labelled(docs: DataFrame, settings: LicenseSettings, all_lines: bool = True) -> DataFrame:
    """(family, terms, scored): templates, stretches of them of eight words and more, and unknown paragraphs.

    Without ``all_lines``, of the corpus only those that are scored.
    """
    spark = docs.sparkSession
    whole = templates(spark).withColumn("own", F.split("paragraph", " "))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 8, F.lit(0)))
    stretches = whole.withColumn("start", F.explode(starts)).withColumn("length", F.explode(F.array(*[F.lit(n) for n in (8, 12, 200)])))
    stretches = stretches.withColumn("paragraph", F.array_join(F.slice("own", F.col("start") + 1, F.col("length")), " "))
    known = whole.union(whole).union(whole).select("family", "paragraph").union(stretches.select("family", "paragraph"))
    lines = docs.select(F.explode(F.split(settings.text_col, "\n")).alias("paragraph"))
    found = unknown_paragraphs(lines, settings)
    fixed = spark.range(8).select(F.explode(F.array(*[F.lit(x) for x in OTHERS])).alias("paragraph"))
    unknown = (found if all_lines else found.filter("scored")).union(fixed.select("paragraph", F.lit(False)))
    both = known.select("family", "paragraph", F.lit(False).alias("scored")).union(unknown.select(F.lit(UNKNOWN), "paragraph", "scored"))
    return _with_terms(both).select("family", "terms", "scored").filter(F.size("terms") > 0)


@dataclass
class LicenseModel:
    vectors: HashingTF
    regression: LogisticRegressionModel
    families: list[str]
    threshold: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``family`` (the likeliest but unknown's is among them) and ``probability``."""
        scored = self.regression.transform(self.vectors.transform(rows)).withColumn("p", vector_to_array("probability"))
        names = F.array(*[F.lit(f) for f in self.families])
        best = F.array_max("p")
        return scored.select(*rows.columns, F.element_at(names, F.array_position("p", best).cast("int")).alias("family"), best.alias("probability"))


def fit_licenses(docs: DataFrame, settings: LicenseSettings = LicenseSettings()) -> LicenseModel:
    """Fit on four fifths of the labelled rows, and calibrate on the rest of the unknown ones that are scored."""
    families = sorted([*TEMPLATES, UNKNOWN])
    names = F.array(*[F.lit(f) for f in families])
    vectors = HashingTF(inputCol="terms", outputCol="features", numFeatures=settings.features, binary=True)
    rows = labelled(docs, settings, all_lines=False).groupBy("family", "terms", "scored").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double"))
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("terms"), F.lit(5)) == 0).persist()
    # weights: each class counts alike
    counts = rows.groupBy("label").agg(F.sum("copies").alias("n"))
    train = rows.filter((F.col("family") != UNKNOWN) | ~F.col("held_out")).join(F.broadcast(counts), "label")
    train = train.withColumn("weight", F.lit(1000.0) * F.col("copies") / F.col("n"))
    regression = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=0.002, elasticNetParam=0.05, maxIter=settings.max_passes, tol=_TOLERANCE
    )
    # few tasks per step, as many as the rows need
    n_tasks = max(2, math.ceil(rows.count() / TASK_ROWS))
    fitted = regression.fit(vectors.transform(train).select("features", "label", "weight").repartition(n_tasks, "features"))
    history = fitted.summary.objectiveHistory
    if len(history) > settings.max_passes and history[-2] - history[-1] > _TOLERANCE * abs(history[-1]):
        warnings.warn(f"the license classifier has not converged in {settings.max_passes} passes: {history[-2]} to {history[-1]}", stacklevel=2)
    model = LicenseModel(vectors, fitted, families, settings.least_probability)
    held_out = model.predict(rows.filter(F.col("scored") & F.col("held_out")).select("terms", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    passed = F.when(F.col("family") != UNKNOWN, F.col("probability")).otherwise(0.0)
    limit = held_out.agg(F.percentile_approx(passed, 1 - settings.false_share, 10_000)).first()[0]
    model.threshold = max(settings.least_probability, limit or 0.0)
    rows.unpersist()
    return model


def scan_licenses(
    docs: DataFrame, settings: LicenseSettings = LicenseSettings(), model: LicenseModel | None = None
) -> DataFrame:
    """Per confirmed statement: id, ``paragraph`` (line number from 0), ``family``, ``probability``, ``similarity``."""
    model = model or fit_licenses(docs, settings)
    found = model.predict(paragraphs(docs, settings).select("id", "place", "pairs", "terms"))
    found = found.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    own = _with_terms(templates(docs.sparkSession)).groupBy(F.col("family").alias("known")).agg(F.collect_list("pairs").alias("shapes"))
    # a fixed row per family
    joined = found.join(F.broadcast(own), F.col("family") == F.col("known"))

    similarity = F.array_max(F.transform("shapes", _alike))
    return (
        joined.withColumn("similarity", similarity)
        .filter(F.col("similarity") >= settings.similar)
        .select(F.col("id").alias(settings.id_col), F.col("place").alias("paragraph"), "family", "probability", "similarity")
    )
