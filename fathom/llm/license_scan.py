"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are lines of text, and runs of neighbouring lines, as licence headers are often
hard-wrapped.  They are described by their word 1- to 3-grams.  A softmax regression
with one sparse weight per gram and family is trained, here, on the templates below, varied
by dropping, doubling and swapping words, against paragraphs of ordinary prose and of legal
words that grant nothing.  The unknown class is calibrated on texts held out of the fit with
all their variants: a family counts only if its probability reaches a level that at most 2 %
of unknown paragraphs reach there and are confirmed.  A prediction stands only if enough of the grams of one of
the family's templates are there.

Scoring is DataFrame work: grams are joined to the weight table, which is as large as the
templates make it, and summed by paragraph.  Texts and runs without any of ``required`` are
passed over before grams are made; that loses nothing, since a template has fewer grams
outside its required ones than a confirmation takes.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.graph import cut

#: Notices by family (fixed values: short forms in public use).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is MIT licensed.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GPLv2 or later.",
        "This software is licensed under the GPLv3.",
        "Licensed under GPLv2.",
    ),
    "agpl": (
        "This server is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 the author. All rights reserved.", "This document is confidential and may not be reproduced without written permission."),
}
#: Paragraphs that are no notice (fixed values): legal words that grant nothing, and prose.
OTHERS = (
    "The driver must show a valid license to the officer.", "She renewed her fishing license in version two of the form.",
    "He asked for permission to leave the room.", "The public was invited to the general meeting of the foundation.",
    "Our rights as citizens are reserved for the next chapter.", "The MIT campus released a map for visitors.",
    "An Apache helicopter landed under the bridge.", "The source of the river and its binary fork.", "Terms of the agreement were discussed under the tree.",
    "Copyright law is taught in the second year.", "Creative people share common spaces for work.", "The license plate was found in a public place.",
    "free of charge to any person in the domain", "the terms as published by the newspaper", "The software is free and the copy is here.",
    "This work is about the history of trade.", "This document describes the weather of the north.", "All of the above.", "Reserved seats are in the front row.",
    "in the and of with for to a is that it on as by at from", "to the extent possible the author has written this by hand", "for all and by any version",
    # notices talked about, not given
    "Lawyers discuss what the Apache License, version 2.0, means for companies.", "Ask for permission first, the Apache License version 2.0 is what people argue about.",
    "The article compares the MIT License with the BSD License and others.", "Is the GNU General Public License viral, readers ask in their letters.",
    "A court looked at the GNU Lesser General Public License for the first time.", "Wikipedia explains Creative Commons Attribution in a long article.",
    "What the Mozilla Public License asks of a vendor is told below.", "The Eclipse Public License was written by a committee in 2004.",
    "Students read the Boost Software License and the ISC License in class.", "The history of the GNU Affero General Public License begins with hosted services.",
    "all rights reserved for the poor", "all rights reserved for members of the club", "They had all rights reserved for the eldest son.", "Whether all rights are reserved is a question for a judge.", "The public domain is what remains when copyright has run out.",
    "Her speech on free software was released into a wide public debate.", "An SPDX identifier names a license in one line of a file.", "Some say the GPLv2 is older than the web itself.",
)
GRAM = 3
CONFIRM = 0.6
_WORD = re.compile(r"[a-z0-9]+")


def grams(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return {" ".join(words[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)}


_COMMON = frozenset("in the and of with for to a is that it on as by at from this be may or not you can all".split())


@cache
def required() -> tuple[str, ...]:
    """Grams of several words such that whatever has CONFIRM of a template's grams has one of them."""
    out: set[str] = set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        own = grams(text)
        several = sorted((g for g in own if " " in g), key=lambda g: (sum(w in _COMMON for w in g.split()) / len(g.split()), len(g.split()), g))
        enough = len(own) - math.ceil(CONFIRM * len(own) - 1e-9) + 1
        if len(several) < enough:
            raise ValueError(f"too short a template: {text}")
        out.update(several[:enough])
    # A gram that holds another required one adds nothing.
    return tuple(sorted(g for g in out if not any(f" {h} " in f" {g} " for h in out if h != g)))


def _has_required(text: Column) -> Column:
    rests: dict[str, list[str]] = {}
    for gram in required():
        first, rest = gram.split(" ", 1)
        rests.setdefault(first, []).append(rest.replace(" ", "[^a-z0-9]+"))
    return text.rlike("(?<![a-z0-9])(?:" + "|".join(f"{w}[^a-z0-9]+(?:{'|'.join(r)})" for w, r in rests.items()) + ")(?![a-z0-9])")


def _vary(text: str, rng: random.Random) -> str:
    words = text.split()
    for _ in range(rng.randint(0, 2)):
        at = rng.randrange(len(words))
        what = rng.random()
        if what < 0.4 and len(words) > 3:
            del words[at]
        elif what < 0.7:
            words.insert(at, rng.choice(("the", "this", "Copyright", "2021", "file", "and")))
        elif at + 1 < len(words):
            words[at], words[at + 1] = words[at + 1], words[at]
    return " ".join(words)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 2000, rate: float = 8.0, shrink: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent: weights by gram and class, bias by class.

    Weights stay sums of rows, so the steps are taken on the rows' shares in them: there are
    fewer rows than grams.
    """
    alike, share, bias = x @ x.T, np.zeros(y.shape), np.zeros(y.shape[1])
    for _ in range(rounds):
        back = (_softmax(alike @ share + bias) - y) / len(x)
        share -= rate * (back + shrink * share)
        bias -= rate * back.sum(0)
    return x.T @ share, bias


def _softmax(score: np.ndarray) -> np.ndarray:
    raised = np.exp(score - score.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


class Model(NamedTuple):
    """Weights by gram and class (families, then unknown), bias by class, and the calibration.

    ``level``: least probability of a known family; ``false_rate``: share of unknown paragraphs
    that reach it and are confirmed; ``recall``: share of varied notices that reach it; all are
    held out of the fit.
    """

    weights: dict[str, list[float]]
    bias: list[float]
    level: float
    false_rate: float
    recall: float


@cache
def train(seed: int = 3, copies: int = 12, folds: int = 6, allowed: float = 0.02) -> Model:
    """Fit on varied templates and other paragraphs, and calibrate the unknown class.

    Other paragraphs are dealt to folds with all their variants, notices by variant.  Each fold
    is scored by a model fitted without it; the level is the probability of a known family
    that at most ``allowed`` of the unknown paragraphs so held out reach with enough of one of its
    templates, and one half at least.  The model returned is fitted on all texts.
    """
    rng = random.Random(seed)
    texts = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, "unknown") for t in OTHERS]
    names = [*TEMPLATES, "unknown"]
    rows = [(grams(_vary(t, rng)), names.index(f), (i if f == "unknown" else k) % folds) for i, (t, f) in enumerate(texts) for k in range(copies)]
    known = sorted(set().union(*(gs for gs, _, _ in rows)))
    place = {g: k for k, g in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for row, (gs, _, _) in zip(x, rows, strict=True):
        row[[place[g] for g in gs]] = 1 / math.sqrt(len(gs))
    at, fold = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    y = np.eye(len(names))[at]
    held = np.zeros_like(y)
    for k in range(folds):
        weights, bias = _fit(x[fold != k], y[fold != k])
        # Grams that only the left-out texts have are unknown to the model, as in scoring.
        seen = x[fold == k] * (x[fold != k] > 0).any(0)
        norm = np.linalg.norm(seen, axis=1, keepdims=True)
        held[fold == k] = _softmax(np.divide(seen, norm, out=seen, where=norm > 0) @ weights + bias)
    other = at == len(names) - 1
    shapes = {f: [grams(t) for t in ts] for f, ts in TEMPLATES.items()}
    best = held[:, :-1].argmax(1)
    confirmed = np.array([max(len(gs & t) / len(t) for t in shapes[names[b]]) >= CONFIRM for (gs, _, _), b in zip(rows, best.tolist(), strict=True)])
    top = np.where(confirmed, held[:, :-1].max(1), 0.0)
    level = max(0.5, float(np.quantile(top[other], 1 - allowed)))
    right = (best == at) & (held[:, :-1].max(1) >= level)
    weights, bias = _fit(x, y)
    return Model(dict(zip(known, weights.tolist(), strict=True)), bias.tolist(), level, float((top[other] > level).mean()), float(right[~other].mean()))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _gram_column(text: Column) -> Column:
    """Distinct 1- to GRAM-grams; each order is zipped from the one before, in linear time."""
    words = _words(text)
    orders = [words]
    for n in range(2, GRAM + 1):
        # zip_with pads the shorter side with nulls, which make null grams.
        longer = F.zip_with(orders[-1], F.slice(words, n, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
        orders.append(F.filter(longer, lambda g: g.isNotNull()))
    return F.array_distinct(F.concat(*orders))


def _weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(train().weights.items()), "gram string, weight array<double>")


def _runs(docs: DataFrame) -> DataFrame:
    """Lines and runs of neighbouring lines that may be notices: doc_id, text_key, block, paragraph, last, line.

    ``paragraph`` and ``last`` are the numbers of the first and last line, ``line`` the words.
    A run goes on for as many lines as begin within the words of one and a half of the
    longest template after its first line; a line without words ends it.
    """
    reach = math.ceil(1.5 * max(len(_WORD.findall(t.lower())) for ts in TEMPLATES.values() for t in ts))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_has_required(F.lower("text")))
    each = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).distinct()
    each = each.withColumn("words", _words(F.col("line"))).withColumn("n", F.size("words"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("paragraph")
    each = each.withColumns({"end": F.sum("n").over(order), "block": F.sum((F.col("n") == 0).cast("int")).over(order)}).where("n > 0")
    own = F.struct("paragraph", F.array_join("words", " ").alias("line"))
    block = Window.partitionBy("doc_id", "text_key", "block").orderBy("end")
    each = each.select("doc_id", "text_key", "block", "end", own.alias("own")).withColumn("next", F.lead("own").over(block))
    # Lines that end within reach, and the one that begins there.
    ahead = F.collect_list(F.struct("own", "next")).over(block.rangeBetween(0, reach - 2))
    run = each.select("doc_id", "text_key", "block", ahead.alias("ahead"))
    lines = F.array_compact(F.concat(F.col("ahead.own"), F.array(F.element_at("ahead", -1)["next"])))
    run = run.select("doc_id", "text_key", "block", lines.alias("lines")).where(_has_required(F.array_join(F.col("lines.line"), " ")))
    some = run.select("doc_id", "text_key", "block", F.col("lines")[0]["paragraph"].alias("paragraph"), "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("k"))
    made = some.select("doc_id", "text_key", "block", "paragraph", F.col("lines")[F.col("k") - 1]["paragraph"].alias("last"), F.array_join(F.slice(F.col("lines.line"), F.lit(1), F.col("k")), " ").alias("line"))
    return made.where(_has_required(F.col("line")))


def _apart(found: DataFrame) -> DataFrame:
    """Of runs that share lines, the best: single lines, then by overlap, then the shortest."""
    many = F.col("last") > F.col("paragraph")
    rank = F.struct(many.alias("many"), (-F.col("overlap")).alias("lack"), (F.col("last") - F.col("paragraph")).alias("more"), "paragraph", "last", "family", "probability", "overlap")
    blocks = found.groupBy("doc_id", "text_key", "block").agg(F.sort_array(F.collect_list(rank)).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["paragraph"] <= x["last"]) & (x["paragraph"] <= k["last"]))
    single = F.filter("all", lambda x: ~x["many"])
    kept = F.aggregate(F.filter("all", lambda x: x["many"]), single, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return blocks.select("doc_id", F.inline(kept)).select("doc_id", "paragraph", "family", "probability", "overlap")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per licence notice: doc_id, paragraph (number of its first line from 0), family, probability, overlap.

    ``overlap`` is the share of grams of the family's closest template that the paragraph
    has.  Null and empty texts have no paragraphs.  A repeated row gives its notices once.
    """
    spark = docs.sparkSession
    names = [*TEMPLATES, "unknown"]
    model = train()
    near = cut(_runs(docs))
    # One paragraph's grams are scored once however many documents share it.
    unique = near.select("line").distinct()
    gram = unique.select("line", F.explode(_gram_column(F.col("line"))).alias("gram"))
    table = _weight_table(spark)
    known = gram.join(F.broadcast(table), "gram")  # bounded by TEMPLATES and OTHERS
    sums = [F.sum(F.col("weight")[i]).alias(f"s{i}") for i in range(len(names))]
    scored = known.groupBy("line").agg(F.count("*").alias("n"), *sums)
    logits = F.array(*(F.lit(model.bias[i]) + F.col(f"s{i}") / F.sqrt("n") for i in range(len(names))))
    scored = scored.select("line", logits.alias("logit")).withColumn("top", F.array_max("logit"))
    scored = scored.withColumn("at", F.array_position("logit", F.col("top")).cast("int"))
    total = F.aggregate("logit", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.select("line", F.element_at(F.array(*map(F.lit, names)), F.col("at")).alias("family"), (1 / total).alias("probability"))
    scored = scored.where((F.col("family") != "unknown") & (F.col("probability") >= model.level))
    shapes = [(f, i, g, len(grams(t))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in sorted(grams(t))]
    shape = spark.createDataFrame(shapes, "family string, template int, gram string, size int")
    shared = gram.join(F.broadcast(shape), "gram").groupBy("line", "family", "template", "size").count()  # bounded by TEMPLATES
    best = shared.groupBy("line", "family").agg(F.max(F.col("count") / F.col("size")).alias("overlap")).where(F.col("overlap") >= CONFIRM)
    return _apart(near.join(scored.join(best, ["line", "family"]), "line"))
