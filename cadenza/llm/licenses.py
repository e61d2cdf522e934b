"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

DataFrame, SQL and pyspark.ml operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.bind import let
from cadenza.llm.common import stored

UNKNOWN = "unknown"

#: The names and identifiers of public licences.
NAMES = {
    "apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"], "Apache-2.0"),
    "mit": (["MIT License", "MIT", "Expat License", "The MIT License (MIT)"], "MIT"),
    "bsd": (["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause"], "BSD-3-Clause"),
    "gpl": (["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL", "GPL", "GPLv3", "GPL-2.0-only", "GNU GPL version 2"], "GPL-3.0-or-later"),
    "lgpl": (["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "LGPL", "LGPLv3", "LGPL-3.0-only"], "LGPL-2.1-only"),
    "agpl": (["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3"], "AGPL-3.0-or-later"),
    "mpl-2.0": (["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL", "MPL 2.0"], "MPL-2.0"),
    "epl-2.0": (["Eclipse Public License", "Eclipse Public License - v 2.0", "EPL", "EPL 2.0"], "EPL-2.0"),
    "isc": (["ISC License", "ISC licence"], "ISC"),
    "boost": (["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"], "BSL-1.0"),
    "zlib": (["zlib License", "zlib/libpng license"], "Zlib"),
    "unlicense": (["Unlicense", "The Unlicense"], "Unlicense"),
    "cc0": (["CC0", "CC0 1.0 Universal", "Creative Commons Zero"], "CC0-1.0"),
    "cc-by-nc": (["CC BY-NC 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"], "CC-BY-NC-4.0"),
    "cc-by-sa": (["CC BY-SA 4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"], "CC-BY-SA-4.0"),
    "cc-by": (["CC BY 4.0", "CC BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"], "CC-BY-4.0"),
    "proprietary": ([], None),
}
#: Wording by which public licences grant or reserve rights.
WORDING = {
    "apache-2.0": [
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    ],
    "cc-by-nc": ["You may not use the material for commercial purposes."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by": ["You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential.",
    ],
}
#: Ways in which a licence is named.
PHRASES = ["{}", "License: {}", "license = {}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This software is licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is released under the {}.", "Available under the terms of the {}.", "Dual licensed under the {} or another license.", "It is made available under the {}, see the file LICENSE.", "Dual licensed under {}", "Dual-licensed under the {}", "{} licenses"]
#: Sentences that share words with licences, or name one, but grant none.
OTHERS = [
    "A driving licence must be renewed every ten years.",
    "The fishing license costs more this year than last year.",
    "The public library is open to the general public on weekdays.",
    "The foundation published its source documents in the fourth version of the report.",
    "She reserved all the rooms and paid for the rights of way.",
    "All rooms are reserved.",
    "Permission to enter the building was granted by the owner.",
    "The copy of the letter was found in the file with the notice.",
    "The software was released in May and distributed to any person who asked.",
    "The above conditions are met in most source and binary systems.",
    "This work is the third of its kind and is free of charge.",
    "The terms of the agreement are subject to the law of the land.",
    "An Apache helicopter landed at the MIT campus.",
    "She studied physics at MIT and taught there for ten years.",
    "A professor at MIT published a paper on the economy.",
    "The Mozilla browser was written by many people.",
    "The Apache web server answered within a second.",
    "The eclipse of the sun was seen by the public.",
    "GNU tools were used to compile the program.",
    "BSD sockets are used for the network.",
    "The boost in sales was a surprise.",
    "Licensed under the terms of another agreement.",
    "Licensed under a license.",
    "Released under the terms of an unnamed licence, version 7.",
    "Distributed under the terms of the contract.",
    "The license of the doctor was revoked by the board.",
    "This software is used in many hospitals and is free to try.",
    "Creative people share common interests.",
    "The commons of the village were open to all.",
    "No part of the house was damaged by the storm.",
    "You should have received a copy of the invoice along with this letter.",
    "You may not use the lift in case of fire.",
    "The author gave credit to the original work of the school.",
    "Any person may obtain a copy of the report at the desk.",
    "The version 2.0 of the program is available at the usual place.",
    "This program is broadcast in the hope that it will be useful.",
    "The code of this building is 4.0 and the file is in the drawer.",
]
#: Possessive, as Java's regular expressions else recurse once a repetition.
VERSION_WORDS = "[0-9]+(?:\\.[0-9]+)*+"
#: What parts the clauses of a line that may name several licences; a comma before a version parts none.
BETWEEN_CLAUSES = r"\s(?:or|and)\s|[;|&/+]|,(?!\s?v)"


def levelled(text: Column) -> Column:
    """Lower case, with one spelling of licence."""
    return F.replace(F.lower(text), F.lit("licence"), F.lit("license"))


def words_of(text: Column) -> Column:
    """Lower-cased words and version numbers of a paragraph."""
    return F.regexp_extract_all(levelled(text), F.lit(f"{VERSION_WORDS}|[\\p{{L}}]+"), F.lit(0))


def grams(words: Column, most: int = 3) -> Column:
    """The word n-grams of up to most words."""

    def of(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return let(words, lambda w: F.concat(w, *(of(w, n) for n in range(2, most + 1))))


@dataclass
class LicenseModel:
    pipeline: PipelineModel
    families: list[str]
    cues: list[str] | None
    least: float

    def gate(self) -> str | None:
        """A regular expression that lower-cased text must match to reach a family; None if any may."""
        return None if self.cues is None else r"(?<![\p{L}0-9])" + word_pattern(self.cues) + r"(?![\p{L}0-9])"


def word_pattern(words: list[str]) -> str:
    """A regular expression of the words, with common beginnings shared."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        options = [("\\" + c if c in ".-" else c) + of(below) for c, below in sorted(node.items()) if c]
        if not options:
            return ""
        return "(?:" + "|".join(options) + ")" + ("?" if "" in node else "") if len(options) > 1 or "" in node else options[0]

    return of(tree) or "(?!)"


def templates() -> list[tuple[str, str]]:
    """(family, text): the wording, and the names in the usual phrases."""
    out = [(f, t) for f, texts in WORDING.items() for t in texts]
    for family, (names, spdx) in NAMES.items():
        out += [(family, p.format(n)) for n in names for p in PHRASES]
        if spdx:
            out.append((family, f"SPDX-License-Identifier: {spdx}"))
    return out


def partial_forms(text: str) -> list[str]:
    """Parts in which a long text is found: beginnings, ends and windows of 8, 12 and 18 words, and without some words."""
    words = text.split()
    out = [text, f"Notice: {text}"]
    for n in (8, 12, 18):
        if len(words) > n + 2:
            out += [" ".join(words[k : k + n]) for k in [*range(0, len(words) - n, max(4, n // 2)), len(words) - n]]
    if len(words) > 12:
        out += [" ".join(w for k, w in enumerate(words) if k % 7 != r) for r in (2, 5)]
    return out


def _examples(spark, negatives: DataFrame | None) -> DataFrame:
    """(text, family, weight): names and wording whole and in parts, other sentences, sampled paragraphs of the corpus.

    A form that two families share (their common wording) is left to the first of them.
    """
    rows: dict[str, tuple[str, float]] = {}
    for family, t in templates():
        wording = t in WORDING[family]
        for form in partial_forms(t) if wording else [t]:
            rows.setdefault(form, (family, 3.0 if wording else 1.0))
    for t in OTHERS:
        rows[t] = (UNKNOWN, 20.0)
    out = spark.createDataFrame([(t, f, w) for t, (f, w) in rows.items()], "text string, family string, weight double")
    return out.unionAll(negatives.select("text", F.lit(UNKNOWN).alias("family"), F.lit(1.0).alias("weight"))) if negatives is not None else out


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (number from 0) and text of every line."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("paragraph", "text"))


def _pairs(words: Column) -> Column:
    """The distinct word pairs of a paragraph; of one word, itself."""
    return let(words, lambda w: F.when(F.size(w) == 1, w).otherwise(F.array_distinct(F.filter(grams(w, 2), lambda g: F.contains(g, F.lit(" "))))))


def train(docs: DataFrame, negative_rows: int = 3000, false_rate: float = 0.001, text_col: str = "text", most_words: int = 400) -> LicenseModel:
    """Fit the classifier on names and wording of licences and on at most negative_rows paragraphs of the corpus.

    Features are the word n-grams (1 to 3) that occur in two examples of licences at least, weighted by elastic-net logistic
    regression over the families and the class unknown. The corpus paragraphs are distinct lines of whole documents drawn by a hash of the text,
    of at most most_words words, those with the smallest hash; they count as unknown, but for lines half of whose word pairs occur in licences, which
    may be licences. A fifth of them is held out: the least probability for a family is set so that at most false_rate of those reach it,
    and 0.5 at least. An empty table is fine: the sentences in OTHERS then are all that is unknown.
    """
    spark = docs.sparkSession
    n = docs.count()
    drawn = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / (1 << 30)
    some = docs.where(drawn(text_col) < min(1.0, negative_rows / max(n, 1))).select(F.col(text_col).alias("t"))
    forms = _examples(spark, None).where(F.col("family") != UNKNOWN).select("text", grams(words_of(F.col("text"))).alias("grams"))
    counted = forms.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    vocabulary = sorted(r["g"] for r in counted if r["n"] > 1)
    known = F.array(*(F.lit(r["g"]) for r in counted if r["g"].count(" ") == 1))  # of the templates: of fixed size
    lines = some.select(F.explode(F.split("t", "\n")).alias("text")).where("trim(text) <> ''").distinct()
    lines = lines.select("text", words_of(F.col("text")).alias("w")).where(F.size("w").between(1, most_words))
    licence_like = let(_pairs(F.col("w")), lambda p: F.size(F.array_intersect(p, known)) * 2 >= F.size(p))
    lines = lines.where(~licence_like).select("text", F.xxhash64("text", F.lit(1)).alias("draw")).orderBy("draw", "text").limit(negative_rows)
    negatives = stored(lines.select("text", F.pmod("draw", F.lit(5)).alias("fold")), "license-negatives")
    examples = _examples(spark, negatives.where("fold <> 0")).select("family", "weight", grams(words_of(F.col("text"))).alias("grams"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc")
    regression = LogisticRegression(maxIter=80, regParam=0.0004, elasticNetParam=0.2, family="multinomial", probabilityCol="probability", weightCol="weight", standardization=False)
    fitted = Pipeline(stages=[counter, index, regression]).fit(stored(examples.coalesce(1), "license-examples"))
    families = list(fitted.stages[1].labels)
    model = PipelineModel([counter, fitted.stages[2]])
    best = _best(model.transform(negatives.where("fold = 0").select(grams(words_of(F.col("text"))).alias("grams"))), families)
    wrong = sorted((r[0] for r in best.where(F.col("family") != UNKNOWN).select("probability").collect()), reverse=True)
    allowed = int(false_rate * max(1, negatives.where("fold = 0").count()))
    least = min(max(0.5, wrong[allowed] + 1e-6), 0.999) if len(wrong) > allowed else 0.5
    common = {r["w"]: r["n"] for r in negatives.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").isin(sorted({x for g in vocabulary for x in g.split()}))).collect()}
    cues = cue_words(vocabulary, fitted.stages[2].coefficientMatrix.toArray(), fitted.stages[2].interceptVector.toArray(), families.index(UNKNOWN), least, common)
    return LicenseModel(model, families, cues, least)


def cue_words(vocabulary: list[str], w: np.ndarray, intercept: np.ndarray, none: int, least: float, common: dict[str, int]) -> list[str] | None:
    """Words of which a paragraph must hold one to reach a family with a probability of least; None if it may reach one without any.

    A family's log odds against unknown are the intercepts' difference and the sum of the differences of weights of the
    n-grams in the paragraph. Each n-gram that speaks for a family is left to its rarest word. From the most common word on, a word isn't asked for as long as
    all n-grams left to such words, together, can't lift any family to the odds that least needs.
    """
    gain = np.maximum(w - w[none], 0)
    gain[none] = 0
    slack = np.log(least / (1 - least)) + intercept[none] - intercept
    slack[none] = np.inf
    if (slack <= 1e-6).any():
        return None
    held: dict[str, np.ndarray] = {}
    for k in np.flatnonzero(gain.any(0)):
        rarest = min(vocabulary[k].split(), key=lambda x: (common.get(x, 0), x))
        held[rarest] = held.get(rarest, 0) + gain[:, k]
    used = np.zeros(len(w))
    cues = []
    for word in sorted(held, key=lambda x: (-common.get(x, 0), x)):
        if common.get(word, 0) and (used + held[word] < slack - 1e-6).all():
            used = used + held[word]
        else:
            cues.append(word)
    return sorted(cues)


def _best(scored: DataFrame, families: list[str]) -> DataFrame:
    """family and probability of the likeliest class, named: the likeliest family against unknown alone, as odds in [0, 1]."""
    p = scored.withColumn("p", vector_to_array("probability"))
    at = F.array_position("p", F.array_max("p"))
    none = F.col("p")[families.index(UNKNOWN)]
    named = F.array_max(F.array(*(F.col("p")[k] for k, f in enumerate(families) if f != UNKNOWN)))
    p = p.withColumn("family", F.element_at(F.array(*(F.lit(f) for f in families)), at.cast("int"))).withColumn("named", named / (named + none))
    return p.withColumn("probability", F.array_max("p")).drop("p", "features", "rawPrediction", "prediction")


def overlap(own: Column, of: Column) -> Column:
    """The largest share, over a family's templates (arrays of word pairs), of the pairs of the template or of the paragraph (six at least) that both have."""
    return F.array_max(F.transform(of, lambda t: F.size(F.array_intersect(t, own)) / F.greatest(F.least(F.size(t), F.greatest(F.size(own), F.lit(6))), F.lit(1))))


def names() -> list[tuple[str, str]]:
    """(family, name), by which a clause may name a licence."""
    return [(f, n) for f, (own, spdx) in NAMES.items() for n in [*own, *([spdx] if spdx else [])]]


def in_clauses(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """The families that clauses of lines (digest, paragraph, text, family) name: digest, paragraph, family, probability, words.

    Clauses are what or, and, commas and slashes part. Each is classified like a paragraph; a family counts if the clause holds a name of it, so that parts of
    a licence's wording don't count as another's. A family of several clauses counts once, with the likeliest; the line's own family isn't given again.
    """
    parts = lines.withColumn("part", F.split(levelled(F.col("text")), BETWEEN_CLAUSES, -1)).where("size(part) > 1")
    parts = parts.select("digest", "paragraph", F.col("family").alias("of_line"), F.explode("part").alias("text")).where("trim(text) <> ''")
    parts = parts.select("digest", "paragraph", "of_line", words_of(F.col("text")).alias("words"))
    scored = _best(model.pipeline.transform(parts.withColumn("grams", grams(F.col("words")))), model.families)
    hits = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least) & ~F.col("family").eqNullSafe(F.col("of_line")))
    known = lines.sparkSession.createDataFrame(names(), "family string, name string").groupBy("family").agg(F.collect_set(F.concat(F.lit(" "), F.array_join(words_of(F.col("name")), " "), F.lit(" "))).alias("names"))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    hits = hits.join(F.broadcast(known), "family").where(let(text, lambda t: F.exists("names", lambda n: F.contains(t, n))))  # a row a family
    best = hits.groupBy("digest", "paragraph", "family").agg(F.max(F.struct("probability", "words")).alias("best"))
    return best.select("digest", "paragraph", "family", "best.probability", "best.words")


def scan(docs: DataFrame, model: LicenseModel, least_overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and licenses of every row: an array of paragraph, family, probability, overlap and confirmed.

    Paragraphs are lines. Those without any of the model's cue words are not scored, as they can't reach a family (see
    cue_words). A family is reported from the model's least probability on, and is confirmed if a template of it and the
    paragraph share least_overlap of the word pairs of either (see overlap). A line that names several licences has an entry for each: where a
    family's odds against unknown alone reach the least probability, the line's clauses are classified, too (see in_clauses), and
    compared with the templates by their own word pairs.

    Null and empty texts have no licences. Rows with a null id and repeated rows each keep their row.
    An empty table gives no rows; other columns are ignored.
    """
    gate = model.gate()
    text = F.col(text_col)
    passes = (lambda t: levelled(t).rlike(gate)) if gate else (lambda t: t != "")
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda t, i: F.struct(i.alias("paragraph"), t.alias("text"))), lambda s: passes(s["text"]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.when(passes(text), lines).alias("lines"))
    rows = stored(rows, "license-lines")
    asked = rows.where("size(lines) > 0").select("digest", "lines").dropDuplicates(["digest"]).select("digest", F.explode("lines").alias("s")).select("digest", "s.paragraph", "s.text", words_of(F.col("s.text")).alias("words"))
    scored = _best(model.pipeline.transform(asked.withColumn("grams", grams(F.col("words")))), model.families)
    reached = (F.col("family") != UNKNOWN) & (F.col("probability") >= model.least)
    scored = stored(scored.where(F.col("named") >= model.least).select("digest", "paragraph", "text", "words", F.when(reached, F.col("family")).alias("family"), "probability"), "license-scored")
    hits = scored.where("family is not null").select("digest", "paragraph", "family", "probability", "words")
    hits = hits.unionByName(in_clauses(scored, model))
    spark = docs.sparkSession
    forms = spark.createDataFrame(templates(), "family string, text string").select("family", _pairs(words_of(F.col("text"))).alias("p")).groupBy("family").agg(F.collect_list("p").alias("forms"))
    hits = hits.join(F.broadcast(forms), "family").withColumn("overlap", let(_pairs(F.col("words")), lambda own: overlap(own, F.col("forms"))))  # a row a family
    found = hits.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("paragraph", "family", "probability", "overlap", (F.col("overlap") >= least_overlap).alias("confirmed")))).alias("licenses"))
    found = stored(found, "license-found")  # as a table, so that the join can split a text with very many copies
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,overlap:double,confirmed:boolean>>")
    return rows.drop("lines").join(found, "digest", "left").select("doc_id", F.coalesce("licenses", empty).alias("licenses"))
