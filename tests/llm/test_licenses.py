import re

import numpy as np
import pytest
import regex
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cadenza.llm import licenses

LINES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
}
#: Lines of licences in other forms than those trained on.
FOUND = {
    "MIT License": "mit",
    "license: MIT": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "// Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "The code is under the MIT license, enjoy.": "mit",
    "This program is free software: you can redistribute it and/or modify it": "gpl",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU GPL": "gpl",
    "Dual licensed under MIT or Apache-2.0": ("mit", "apache-2.0"),
    "# Licensed under the Apache License, Version 2.0 (the License); you may not use this file": "apache-2.0",
    "Redistribution and use in source and binary forms are permitted": "bsd",
    "Redistributions of source code must retain the above copyright notice": "bsd",
    "This library is free software; you can redistribute it under the GNU Lesser General Public License": "lgpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl-2.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Distributed under the Boost Software License 1.0": "boost",
    "Eclipse Public License 2.0": "epl-2.0",
    "This text is available under the Creative Commons Attribution-ShareAlike License": "cc-by-sa",
    "COPYRIGHT 2021 ACME. ALL RIGHTS RESERVED.": "proprietary",
}
NOT = ["She studied at MIT for two years.", "The fishing licence is not needed here.", "If you see the bus, you may wait for all of us, but not for any other.", "An Apache war chief spoke.", "The rights of the people are reserved to the states.", "the river and the road", "A copy of the book is free."]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: {x["family"] for x in r["licenses"] if x["confirmed"]} for r in licenses.scan(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert got[i] == {f for line, f in LINES.items() if line in t}, i


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "Some text.\nAll rights reserved."), (3, "Some text.\nAll rights reserved."), (None, "Released under the MIT License."), (4, "A licence to drive\nand the rights of way"), (5, "w " * 100000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as family", "3 as lines")
    out = sorted(((r["doc_id"] or 0, [(x["paragraph"], x["family"]) for x in r["licenses"] if x["confirmed"]]) for r in licenses.scan(odd, model).collect()), key=str)
    assert out == [(0, [(0, "mit")]), (1, []), (2, []), (3, [(1, "proprietary")]), (3, [(1, "proprietary")]), (4, []), (5, [])]
    assert licenses.scan(odd.limit(0), model).count() == 0


def test_other_forms(spark, model):
    texts = [*FOUND, *NOT]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r["doc_id"]]: [(x["family"], x["confirmed"]) for x in r["licenses"]] for r in licenses.scan(docs, model).collect()}
    missed = [t for t, f in FOUND.items() if not got[t] or got[t][0][0] not in ((f,) if isinstance(f, str) else f)]
    assert not missed, [(t, got[t]) for t in missed]
    assert not [t for t in NOT if got[t]], {t: got[t] for t in NOT if got[t]}
    assert sum(got[t][0][1] for t in FOUND) >= 0.8 * len(FOUND)


def test_the_gate_loses_nothing(spark, model):
    """Every distinct line is scored without the gate, and by plain arithmetic; the hits are those of scan()."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*FOUND, *NOT, *SEVERAL])], "doc_id long, text string"))
    lines = licenses.paragraphs(docs).select("doc_id", "paragraph", "text", licenses.grams(licenses.words_of(F.col("text"))).alias("grams"))
    scored = model.pipeline.transform(lines).select("doc_id", "paragraph", "text", vector_to_array("probability").alias("p")).collect()
    counter, fitted = model.pipeline.stages
    at = {g: k for k, g in enumerate(counter.vocabulary)}
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    none = model.families.index(licenses.UNKNOWN)

    def words_of(text):
        return regex.findall(r"[0-9]+(?:\.[0-9]+)*|\p{L}+", text.lower().replace("licence", "license"))

    def probabilities(words):
        present = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        z = b + sum((w[:, at[g]] for g in present if g in at), np.zeros(len(b)))
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def hit(p):
        best = model.families[int(p.argmax())]
        return best if best != licenses.UNKNOWN and p.max() >= model.least else None

    want = set()
    for r in scored:
        p = probabilities(words_of(r["text"]))
        assert np.allclose(p, r["p"], atol=1e-9)
        if hit(p):
            want.add((r["doc_id"], r["paragraph"], hit(p), round(float(p.max()), 9)))
        families = np.delete(p, none)
        if families.max() / (families.max() + p[none]) < model.least:
            continue
        clauses = re.split(licenses.BETWEEN_CLAUSES, r["text"].lower().replace("licence", "license"))
        found = {}
        for words in map(words_of, clauses if len(clauses) > 1 else []):
            q = probabilities(words)
            if hit(q) not in (None, hit(p)) and any(f" {' '.join(words_of(n))} " in f" {' '.join(words)} " for f, n in licenses.names() if f == hit(q)):
                found[hit(q)] = max(found.get(hit(q), 0), round(float(q.max()), 9))
        want |= {(r["doc_id"], r["paragraph"], f, x) for f, x in found.items()}
    got = [(r["doc_id"], x["paragraph"], x["family"], round(x["probability"], 9)) for r in licenses.scan(docs, model).collect() for x in r["licenses"]]
    assert len(got) == len(set(got)) and set(got) == want and len(got) > 20


SEVERAL = {
    "Dual licensed under MIT or Apache-2.0": {"mit", "apache-2.0"},
    "SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache-2.0"},
    "SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)": {"gpl", "bsd"},
    "Dual-licensed under the MIT and GPL licenses": {"mit", "gpl"},
    "license = MIT/Apache-2.0": {"mit", "apache-2.0"},
    "Released under the MIT License, the ISC License and the zlib License.": {"mit", "isc", "zlib"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "The MIT Licence": {"mit"},
    "Licensed to the Apache Software Foundation (ASF) under one or more": {"apache-2.0"},
}


def test_a_line_may_name_several(spark, model):
    texts = [*SEVERAL, *(t for t, f in FOUND.items() if isinstance(f, str)), *(t for family in licenses.WORDING.values() for t in family)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r["doc_id"]]: [x["family"] for x in r["licenses"]] for r in licenses.scan(docs, model).collect()}
    wrong = {t: got[t] for t, f in SEVERAL.items() if sorted(got[t]) != sorted(f)}
    assert not wrong, wrong
    assert all(len(got[t]) <= 1 for t in texts if t not in SEVERAL), {t: got[t] for t in texts if len(got[t]) > 1 and t not in SEVERAL}


def test_words_not_asked_for_cannot_reach_a_family():
    vocabulary = ["all", "all rare", "mit", "the"]
    w = np.array([[0.4, 1.0, 3.0, 0.3], [0.0, 0.0, 0.0, 0.0]])
    common = {"all": 50, "the": 90}
    assert licenses.cue_words(vocabulary, w, np.array([0.0, 0.5]), 1, 0.5, common) == ["all", "mit", "rare"]
    assert licenses.cue_words(vocabulary, w, np.array([0.0, 0.8]), 1, 0.5, common) == ["mit", "rare"]
    assert licenses.cue_words(vocabulary, w, np.array([0.6, 0.5]), 1, 0.5, common) is None
    rx = re.compile(licenses.word_pattern(["mit", "mits", "apache", "2.0"]) + "$")
    assert all(rx.match(x) for x in ("mit", "mits", "apache", "2.0")) and not rx.match("mi") and not rx.match("2x0")


def test_long_repeats_do_not_end_the_application(spark, model):
    n = 100_000
    texts = ["MIT License " + r * (n // len(r)) for r in ("1.", "ab.", "@", "1", "-", "1 ", ". ")] + ["1." * n + "\nMIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in licenses.scan(docs, model).collect()}
    assert len(got) == len(texts) and got[7] == ["mit"]
