"""Licence scan: a trained paragraph classifier confirmed by templates, in SQL functions and Spark ML alone.

Word n-grams of known notices and of ordinary paragraphs train a sparse multinomial logistic regression over
licence families and an unknown class; a temperature fitted on held-out examples calibrates it. Scoring
explodes the n-grams of those paragraphs that hold a word of the model (any other paragraph scores the
intercepts alone, which is unknown), joins the few weights and sums them. A family counts as confirmed if a
template of it shares enough of its n-grams with the paragraph. Paragraphs end at blank lines, so notices may
be wrapped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names, materialize, table

UNKNOWN = "unknown"
BLANK_LINE = r"\n[ \t\r\x0B\f]*\n"
# Short notices by family, as licences and their authors word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The software is provided as is, without warranty of any kind, express or implied",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "Distributed under the MIT license, see LICENSE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "you may not use this file except in compliance with the License",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License 2.0, see the NOTICE file.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
        "GNU GPL v3, see COPYING.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution.",
        "Released under a BSD license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
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
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is strictly prohibited."],
}
ORDINARY = [
    "The license plate of the car was found near the river.",
    "Her driver's license expired last year and was renewed.",
    "The Apache helicopter landed under the bridge.",
    "The general said the public was free to attend.",
    "Students at MIT released a new study under the direction of the dean.",
    "All seats are reserved for members of the club.",
    "Human rights were the subject of the talk.",
    "He gave permission to use the room free of charge.",
    "The author of this work was found in the file.",
    "Version two of the software will be published in the spring.",
    "A copy of the letter was made available to the public.",
    "The foundation gave a grant for the common good.",
]
#: Notices of further licences, which are of no family here: unknown ones in training and, the last half, in calibration alone.
OTHERS = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from its use.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this licence document.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "This library is licensed under the terms of the Artistic License 2.0.",
    "The Original Code is subject to the Common Development and Distribution License.",
]
#: Words too common to carry an n-gram alone.
COMMON = (
    "a an the of to in on at by for from with without and or as is are was were be been it its this that these those any all may can "
    "you your not no may will which has have had under use used using work file version v 1 2 3 4 0 1.0 2.0 2.1 3.0 4.0 new or if"
).split()
LEADS = ["", "copyright 2019 the authors ", "note: ", "this file is part of the project. "]
TAILS = ["", " see the file for details", " contact the maintainers", " thank you"]


def tokens(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}.+-]+|[.]+(?=\s|$)|[.]+(?=[^\p{L}\p{N}])"), lambda w: w != "")


def _named(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _grams(words: Column, longest: int = 3) -> Column:
    """Distinct 1- to 3-grams that hold a word which is not common."""
    n = F.size(words)

    def slices(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(words, i, k))

    every = F.concat(*(slices(k) for k in range(1, longest + 1)))
    telling = F.filter(every, lambda g: F.exists(g, lambda w: ~w.isin(COMMON)))
    return F.array_distinct(F.transform(telling, lambda g: F.array_join(g, " ")))


def _grams_at(words: Column, cues: list[str]) -> Column:
    """The distinct 1- to 3-grams that hold a cue, taken around the cues alone."""
    n = F.size(words)
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(cues), i)))

    def around(i: Column) -> Column:
        gram = lambda k, at: F.when((at >= 0) & (at + k <= n), F.array_join(F.slice(words, F.greatest(at, F.lit(0)) + 1, k), " "))
        return F.array(*(gram(k, i - back) for k in (1, 2, 3) for back in range(k)))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(hits, around))))


@dataclass
class LicenceModel:
    families: list[str]
    intercepts: list[float]
    temperature: float
    weights: DataFrame  # gram, w (array<double> by family)
    templates: DataFrame  # gram, template, family, n_grams
    cues: list[str]


def _examples(spark: SparkSession, docs: DataFrame | None, id_col: str, text_col: str, most_docs: int) -> DataFrame:
    """family, grams, and whether the row is held out from training for the calibration: the last notice of families of four or
    more, half of the other licences, every fourth ordinary text. All forms of a notice are on one side."""
    notices = [(family, t, len(ts) >= 4 and i == len(ts) - 1) for family, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    notices += [(UNKNOWN, t, i % 4 == 3) for i, t in enumerate(ORDINARY)] + [(UNKNOWN, t, 2 * i >= len(OTHERS)) for i, t in enumerate(OTHERS)]
    rows = [(family, f"{lead}{t}{tail}", held) for family, t, held in notices for lead in LEADS for tail in TAILS]
    out = spark.createDataFrame(rows, "family string, text string, held boolean").select("family", tokens(F.col("text")).alias("words"), "held")
    if docs is not None:
        named = ("license", "licensed", "licence", "licenced", "rights", "copyright", "cc", "gpl")
        (few_id,) = free_names(docs.columns, "_few")
        few = docs.select(F.col(id_col).alias(few_id)).orderBy(F.xxhash64(F.col(few_id).cast("string"))).limit(most_docs)
        some = docs.join(F.broadcast(few), docs[id_col] == F.col(few_id), "left_semi")  # `most_docs` rows at most
        some = some.select(F.explode(F.split(F.col(text_col).cast("string"), BLANK_LINE)).alias("text")).select(tokens(F.col("text")).alias("words"))
        some = some.where(~F.exists("words", lambda w: w.isin(*named)) & (F.size("words") > 0))
        out = out.unionByName(some.select(F.lit(UNKNOWN).alias("family"), "words", (F.pmod(F.xxhash64("words"), F.lit(4)) == 0).alias("held")))
    return out.select("family", _grams(F.col("words")).alias("grams"), "held")


def fit(
    spark: SparkSession, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 200, vocabulary: int = 6_000
) -> LicenceModel:
    """Train on the notices above and, as the unknown class, on ordinary texts, other licences and the whole paragraphs without a
    licence word of `most_docs` documents, by a hash of their ids. The temperature is fitted on notices that training never saw."""
    families = [UNKNOWN, *TEMPLATES]
    index = F.element_at(F.create_map(*(x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i))))), F.col("family"))
    data = materialize(_examples(spark, docs, id_col, text_col, most_docs).withColumn("label", index), "examples").coalesce(1)
    known = data.where((F.col("family") != UNKNOWN) & ~F.col("held"))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=2, binary=True).fit(known)
    train = vectors.transform(data).select("label", "features", "held").cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60).fit(train.where(~F.col("held")))
    matrix, classes = fitted.coefficientMatrix.toArray(), fitted.numClasses
    intercepts = [float(x) for x in fitted.interceptVector] + [-50.0] * (len(families) - classes)
    train.unpersist()
    rows = [
        (g, [float(matrix[f, i]) if f < classes else 0.0 for f in range(len(families))])
        for i, g in enumerate(vectors.vocabulary)
        if any(matrix[:, i])
    ]
    weights = spark.createDataFrame(rows, "gram string, w array<double>")
    forms = spark.createDataFrame([(f, f"{f} {i}", t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)], "family string, template string, text string")
    forms = forms.withColumn("grams", _grams(tokens(F.col("text"))))
    forms = forms.select("family", "template", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    notices = spark.createDataFrame([(t,) for ts in TEMPLATES.values() for t in ts], "t string").select(F.explode(tokens(F.col("t"))).alias("w"))
    cues = sorted({w for g, _ in rows for w in g.split() if w not in COMMON} | {r.w for r in notices.distinct().collect() if r.w not in COMMON})
    model = LicenceModel(families, intercepts, 1.0, weights, forms, cues)
    held = data.where("held").select(F.monotonically_increasing_id().alias("p"), "label", "grams")
    logits = materialize(
        held.select("p", "label").join(_sums(held.select("p", "grams"), model), "p", "left").select("label", *_logits(model)), "held"
    )
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    z = F.array(*(F.col(f"z{f}") for f in range(len(families))))


    def loss(t: float) -> Column:
        total = F.aggregate(F.transform(z, lambda x: F.exp(x / t)), F.lit(0.0), lambda a, x: a + x)
        return F.avg(F.log(total) - F.element_at(z, F.col("label").cast("int") + 1) / t)

    row = logits.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(grid))).first()
    model.temperature = min(zip(row, grid, strict=True))[1] if row[0] is not None else 1.0
    return model


def _sums(paragraphs: DataFrame, model: LicenceModel) -> DataFrame:
    """Summed weights w0, w1, ... of the distinct n-grams of each paragraph (p, grams)."""
    n = len(model.families)
    # the weights are bounded by the vocabulary size, so they may be broadcast
    grams = paragraphs.select("p", F.explode("grams").alias("gram")).distinct()
    hit = grams.join(F.broadcast(model.weights), "gram")
    return hit.groupBy("p").agg(*(F.sum(F.element_at("w", f + 1)).alias(f"w{f}") for f in range(n)))


def _logits(model: LicenceModel) -> list[Column]:
    return [(F.coalesce(F.col(f"w{f}"), F.lit(0.0)) + F.lit(b)).alias(f"z{f}") for f, b in enumerate(model.intercepts)]


def paragraphs(docs: DataFrame, id_col: str, text_col: str, cues: list[str]) -> DataFrame:
    """(p: struct of id, text hash and paragraph number; grams that hold a cue) of the paragraphs that hold one."""
    text = F.col(text_col).cast("string")
    grams = F.transform(F.split(text, BLANK_LINE), lambda part: _named(tokens(part), lambda words: _grams_at(words, cues)))
    # filters on what explode makes stay above it, so texts are split once
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.posexplode(grams).alias("paragraph", "grams"))
    return rows.where(F.size("grams") > 0).select(F.struct("id", "digest", "paragraph").alias("p"), "grams")


def scan(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", agree: float = 0.6, agree_others: float = 0.85
) -> DataFrame:
    """One row for each paragraph classed as a licence and its family, and for each further family there: id, digest (of the text),
    paragraph (from 0), family, probability, template, agreement (share of the template's n-grams found) and confirmed.

    The likeliest family is confirmed by a template that agrees to `agree`. Any other that is likelier than unknown is listed if a
    template of it agrees to `agree_others`, so a paragraph may name several licences. Null, empty and licence-free texts give
    no rows; rows that repeat both id and text give theirs once. Ties between families go to the first in order, between templates to
    the first by name. Other columns are ignored.
    """
    # an n-gram without a cue has no weight and stands in no template
    found = materialize(paragraphs(docs, id_col, text_col, model.cues).distinct(), "paragraphs")
    scored = _sums(found, model).select("p", *_logits(model))
    z = F.array(*(F.col(f"z{f}") / model.temperature for f in range(len(model.families))))
    top = F.array_max("z")
    names = F.array(*map(F.lit, model.families))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    likely = F.filter(
        F.transform("z", lambda x, i: F.struct(F.get(names, i).alias("family"), (F.exp(x - top) / total).alias("probability"), (i + 1 == F.array_position("z", top)).alias("top"))),
        lambda x: (x["family"] != UNKNOWN) & (x["top"] | (x["probability"] > F.exp(F.get("z", F.lit(0)) - top) / total)),
    )
    scored = scored.select("p", z.alias("z")).select("p", F.explode(likely).alias("x")).select("p", "x.*")
    scored = materialize(scored, "scored")
    forms = model.templates.withColumnRenamed("family", "of")  # as many rows as the templates have n-grams
    shared = (
        found.join(scored.select("p").distinct(), "p", "left_semi")
        .select("p", F.explode("grams").alias("gram"))
        .join(F.broadcast(forms), "gram")
        .groupBy("p", F.col("of").alias("family"), "template", "n_grams")
        .count()
        .withColumn("agreement", F.col("count") / F.col("n_grams"))
        .groupBy("p", "family")
        .agg(F.min(F.struct((-F.col("agreement")).alias("less"), "template")).alias("best"))
        .select("p", "family", F.col("best.template").alias("template"), (-F.col("best.less")).alias("agreement"))
    )
    out = scored.join(shared, ["p", "family"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    confirmed = F.col("agreement") >= F.when(F.col("top"), agree).otherwise(agree_others)
    return out.withColumn("confirmed", confirmed).where("top OR confirmed").select(
        "p.id", "p.digest", "p.paragraph", "family", "probability", "template", "agreement", "confirmed"
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs)
    found = scan(docs, model).withColumn("family", F.when(F.col("confirmed"), F.col("family")))
    by_doc = found.groupBy("id", "digest").agg(
        F.count_distinct("paragraph").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.round(F.max("probability"), 6).alias("probability"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("_digest"))  # no text is shuffled
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))
    return rows.join(by_doc, same, "left").select(
        "doc_id",
        F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"),
        F.coalesce("families", F.lit("")).alias("families"),
        "probability",
    )
