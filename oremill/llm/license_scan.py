"""Licence scan by a trained paragraph classifier, in DataFrame functions alone.

A line is a candidate if it holds an anchor or a telling n-gram, and lines joined, two that follow
each other or all lines up to an empty one, as notices are wrapped, are if they hold the latter.  Telling
n-grams are so chosen that a text without one cannot be confirmed; texts without any of the few
words that make up anchors and telling n-grams (`gate_words`) are passed over in one look.  Joined
lines count only for families that no line of the document, or two joined, confirm; lines without an
anchor only if confirmed.  The words and word pairs of a candidate are the
sparse features of a logistic regression over licence families and `unknown`; the weights
are a small table (a row for each n-gram of the training sentences) that is joined with the
candidates' n-grams, and probabilities are calibrated by a temperature found on sentences kept
out of the fit.  A predicted family is confirmed when the paragraph holds enough of the word
pairs of one of that family's templates (names, and passages of the licences' own texts); without that it counts as unknown.

The classifier is fitted on the driver to sentences made from the templates below, which are
constants; it reads no table.

The documents are read once; their candidates, few and short as a rule, are written to the shared folder,
and each distinct paragraph is judged once, under a sha256 of its text.

Null and empty texts have no paragraphs.  Rows with a null doc_id are left out; repeated
rows give repeated, equal results; columns other than doc_id and text are not read, and either of these twice
is Spark's own ambiguity error.  A very long text is cut into lines like any other; of families with
equal probability the first in alphabetical order after `unknown` wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stage, spread

UNKNOWN = "unknown"
#: Words that make a line a candidate, as they stand in lower-cased text.
ANCHORS = ("licen", "copyright", "copyleft", "public domain", "warrant", "redistribut")
# Fixed value: words that stand in almost every English text.
COMMON = frozenset("a all an and any are as at be but by for from has have if in is it its may no not of on or other out such that the their this to under was which will with you your".split())
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6
#: Probability below which a prediction is unknown.
LEAST = 0.5

# Names by which licences are called.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0"],
    "MIT": ["MIT License", "The MIT License", "MIT licence"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2 license", "GPL v2 license", "GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3 license", "GPL v3 license", "GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL license", "LGPL v2.1", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL license", "AGPL v3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0 license", "MPL 2.0"],
    "ISC": ["ISC License", "The ISC License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero public domain dedication", "CC0 license"],
    "Unlicense": ["The Unlicense", "Unlicense public domain"],
}
# Passages of the licences' own texts, which need not hold the name.
BODIES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Apache-2.0": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY": ["You are free to share, copy and redistribute the material in any medium or format, and to remix, transform, and build upon the material for any purpose, even commercially."],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "CC-BY-NC": ["You may not use the material for commercial purposes."],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
FRAMES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This software is distributed under the terms of the {}.", "{}", "This work is {}.",
    "You may redistribute it under the {}.", "Copyright the authors. {}.", "License: {}", "SPDX license {}", "See the {} for details.", "This program is free software under the {} as published by the foundation.",
    "Permission is granted under the {}, without warranty of any kind.", "Code in this repository is covered by the {}.", "The content is available under {} unless otherwise noted.",
]
OTHER = [
    "All rights reserved.", "Copyright the authors, all rights reserved.", "A driving license is required for this job.", "The license plate of the car was not found.", "He holds a pilot license, version unknown.",
    "This license agreement is between you and the company.", "The warranty covers parts and labour for two years.", "Please renew your fishing license before spring.", "No warranty is given for the contents of this page.",
    "The public domain of the law is wide.", "Redistribution of wealth was debated.", "Her licence to practise was withdrawn.", "Copyright law protects the works of authors.", "Ask the owner for a commercial license.", "The general public needs a license to visit.",
    "A creative mind needs no license.", "The apache tribe and the common land had no license.", "The mozilla developers met the public.", "Version 2.0 of the license plate reader is out.", "The terms of the license are for the general public.", "License", "Licensed", "Copyright",
]


def tokens(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9.]*[a-z0-9]", text.lower())


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


class Classifier:
    """Weights of a softmax regression on binary n-grams, each scaled by one over the root of the known n-grams."""

    def __init__(self, families: list[str], vocab: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.vocab, self.weights, self.bias, self.temperature = families, vocab, weights, bias, temperature

    def matrix(self, sentences: list[str]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.vocab)}
        x = np.zeros((len(sentences), len(self.vocab)))
        for r, s in enumerate(sentences):
            for g in grams(tokens(s)):
                if g in at:
                    x[r, at[g]] = 1
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def logits(self, sentences: list[str]) -> np.ndarray:
        return self.matrix(sentences) @ self.weights + self.bias


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def trained() -> Classifier:
    families = [UNKNOWN, *NAMES]
    rows = [(frame.format(n), k) for k, names in enumerate(NAMES.values(), 1) for n in names for frame in FRAMES]
    for k, bodies in ((families.index(f), b) for f, b in BODIES.items()):
        rows += [(text, k) for b in bodies for text in (b, f"Copyright the authors. {b}", f"{b} {b}", f"{b} The software is provided as is, without warranty of any kind, express or implied.", f"All rights reserved. {b}")]
    rows += [(s, 0) for s in OTHER for _ in range(len(FRAMES))] + [(f.format("terms of the owner"), 0) for f in FRAMES] + [(f.format("license"), 0) for f in FRAMES]
    held = [i % 5 == 3 for i in range(len(rows))]
    fit, out = [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h]
    vocab = sorted(set().union(*(grams(tokens(s)) for s, _ in fit)))
    c = Classifier(families, vocab, np.zeros((len(vocab), len(families))), np.zeros(len(families)), 1.0)
    x, y = c.matrix([s for s, _ in fit]), np.eye(len(families))[[k for _, k in fit]]
    share = 1 / (len(families) * np.maximum(y.sum(0), 1))
    weight = (y @ share)[:, None]  # families weigh the same
    for _ in range(400):
        gap = weight * (_softmax(x @ c.weights + c.bias) - y)
        c.weights = c.weights - 30 * (x.T @ gap + 1e-5 * c.weights)
        c.bias = c.bias - 30 * gap.sum(0) * 0.1
    z, k = c.logits([s for s, _ in out]), np.array([k for _, k in out])
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(k)), k], 1e-12)).mean()
    c.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    return c


def templates() -> list[tuple[str, int, list[str]]]:
    """(family, number, word pairs) of each name and passage."""
    out = []
    for family, names in NAMES.items():
        for name in names + BODIES[family]:
            w = tokens(name)
            out.append((family, len(out), sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w))))
    return out


def telling() -> list[str]:
    """The longest n-grams of each template, so many that those left are too few to confirm it."""
    out = set()
    for _, _, t in templates():
        left = sorted(t, key=lambda g: (len(g), g))
        while len(left) >= CONFIRM * len(t):
            out.add(left.pop())
    return sorted(out)


@lru_cache(maxsize=1)
def gate_words() -> tuple[str, ...]:
    """Strings one of which every anchored or confirmable text holds: the anchors, and words that leave of each
    template too few pairs to confirm it."""
    out = list(ANCHORS)
    left = [{g for g in t if not any(w in g for w in out)} for _, _, t in templates()]
    spare = [CONFIRM * len(t) for _, _, t in templates()]
    while True:
        open_ones = [k for k, (g, most) in enumerate(zip(left, spare)) if len(g) >= most]
        if not open_ones:
            return tuple(out)
        words = {w for k in open_ones for g in left[k] for w in g.split()}
        words = words - COMMON or words
        # long words are rarer, and one that fits many templates spares others
        gain = {w: len(w) * sum(min(sum(w in g.split() for g in left[k]), len(left[k]) - spare[k] + 1) for k in open_ones) for w in words}
        best = max(sorted(words), key=lambda w: (len(w) > 4 or any(c.isdigit() for c in w), gain[w]))
        out.append(best)
        left = [{g for g in t if not any(best in w for w in g.split())} for t in left]


def predict_one(sentence: str) -> tuple[str, float, bool]:
    """The plan's decision on one paragraph, in plain Python."""
    c = trained()
    p = _softmax(c.logits([sentence]) / c.temperature)[0]
    k = int(p.argmax())
    g = grams(tokens(sentence))
    family = c.families[k] if p[k] >= LEAST else UNKNOWN
    ok = family != UNKNOWN and any(f == family and sum(x in g for x in t) >= CONFIRM * len(t) for f, _, t in templates())
    return family, float(p[k]), ok


def word_grams(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9.]*[a-z0-9])"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds one of some strings; the list of one makes Spark lower it once, not for each."""
    plain = [w for w in words if len(w) > 3 or any(x.isdigit() for x in w)]
    short = [w for w in words if w not in plain]  # as parts of longer words they are common

    def any_of(low: Column) -> Column:
        out = F.contains(low, F.lit(plain[0]))
        for w in plain[1:]:
            out = out | F.contains(low, F.lit(w))
        return out | low.rlike(rf"(?<![a-z0-9.])(?:{'|'.join(short)})(?![a-z0-9])") if short else out

    return F.exists(F.array(F.lower(c)), any_of)


def anchored(c: Column) -> Column:
    return holds(c, ANCHORS)


def gated(c: Column) -> Column:
    return holds(c, gate_words())


def candidate_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, joined, anchor): candidate lines (joined 0), two lines (1) and blocks (2)."""
    tells = F.array(*map(F.lit, telling()))
    told = lambda c: F.arrays_overlap(word_grams(c), tells)
    d = spread(docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))).where(gated(F.col("text")))
    blocks = d.select("doc_id", F.explode(F.split("text", r"\n[ \t\r]*(?=\n)")).alias("block")).where(gated(F.col("block")))
    lines = F.split("block", "\n")
    unit = lambda x, k: F.struct(x.alias("paragraph"), F.lit(k).alias("joined"))
    after = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    twos = F.zip_with(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), after, lambda a, b: unit(F.concat(a, F.lit(" "), b), 1))
    units = F.concat(F.transform("lines", lambda x: unit(x, 0)), twos, F.when(F.size("lines") > 2, F.array(unit(F.array_join("lines", " "), 2))).otherwise(F.slice(twos, 1, 0)))
    rows = blocks.withColumn("lines", lines).select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.paragraph", "u.joined").where(gated(F.col("paragraph")))
    rows = rows.withColumn("anchor", (F.col("joined") == 0) & anchored(F.col("paragraph")))
    return rows.where(F.col("anchor") | told(F.col("paragraph")))


def paragraph_families(paragraphs: DataFrame) -> DataFrame:
    """(key, family, score, confirmed) of distinct paragraphs (key, paragraph)."""
    spark, c = paragraphs.sparkSession, trained()
    n = len(c.families)
    weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in zip(c.vocab, c.weights)], "gram string, w array<double>")
    rules = spark.createDataFrame([(f, k, len(t), x) for f, k, t in templates() for x in t], "family string, template int, size int, gram string")
    lines = paragraphs.select("key", F.explode(word_grams(F.col("paragraph"))).alias("gram"))
    known = lines.join(F.broadcast(weights), "gram")  # a constant table
    sums = known.groupBy("key").agg(F.count("*").alias("m"), *(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)))
    z = F.array(*((F.col(f"s{k}") / F.sqrt("m") + F.lit(float(c.bias[k]))) / F.lit(c.temperature) for k in range(n)))
    none = [float(b / c.temperature) for b in c.bias]
    scored = paragraphs.select("key").join(sums, "key", "left").withColumn("z", F.when(F.col("m").isNull(), F.array(*map(F.lit, none))).otherwise(z))
    scored = scored.withColumn("top", F.array_max("z")).withColumn("score", 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    names = F.array(*map(F.lit, c.families))
    family = F.when(F.col("score") >= LEAST, F.element_at(names, F.array_position("z", F.col("top")).cast("int"))).otherwise(F.lit(UNKNOWN))
    scored = scored.select("key", family.alias("family"), "score")
    # pairs of each template that a paragraph holds
    held = lines.join(F.broadcast(rules), "gram").groupBy("key", "family", "template", "size").count()  # a constant table
    sure = held.where(F.col("count") >= CONFIRM * F.col("size")).select("key", "family").distinct().withColumn("confirmed", F.lit(True))
    return scored.join(sure, ["key", "family"], "left").select("key", "family", "score", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, n_confirmed, families, best_score) of each document: its candidate paragraphs,
    those with a confirmed family, these families, and the highest score among them (0 without any)."""
    own = candidate_paragraphs(docs).withColumn("key", F.sha2("paragraph", 256)).withColumn("vague", ~F.col("paragraph").rlike("[0-9]"))
    own = Stage(docs.sparkSession).write(own)
    families = paragraph_families(own.groupBy("key").agg(F.first("paragraph").alias("paragraph")))
    found = own.groupBy("doc_id", "key", "vague", "joined", "anchor").agg(F.count("*").alias("times")).join(families, "key")
    line, sure, vague = F.col("joined") == 0, F.col("confirmed"), F.col("vague")
    per = found.where(F.col("anchor") | sure).groupBy("doc_id").agg(
        F.sum(F.when(line & (F.col("anchor") | sure), F.col("times")).otherwise(0)).alias("lines"),
        F.collect_list(F.when(sure, F.struct("family", "score", "joined", "times", vague.alias("vague")))).alias("all"),
    )
    names = lambda c: F.transform(c, lambda x: x["family"])
    stem = lambda c: F.substring_index(c, "-", 1)
    # a part without a figure does not tell the version of a notice that the joined lines give with one
    per = per.withColumn("exact", names(F.filter("all", lambda x: (x["joined"] > 0) & ~x["vague"]))).withColumn("stems", F.transform("exact", stem))
    per = per.withColumn("all", F.filter("all", lambda x: ~(x["vague"] & F.array_contains("stems", stem(x["family"])) & ~F.array_contains("exact", x["family"]))))
    per = per.withColumn("own", F.filter("all", lambda x: x["joined"] == 0)).withColumn("had", names("own"))
    per = per.withColumn("all", F.filter("all", lambda x: (x["joined"] == 0) | ~F.array_contains("had", x["family"]))).withColumn("extra", F.size(F.array_distinct(names(F.filter("all", lambda x: x["joined"] > 0)))))
    per = per.select(
        "doc_id", (F.col("lines") + F.col("extra")).alias("n_candidates"), (F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["times"]) + F.col("extra")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(names("all"))), ",").alias("families"), F.array_max(F.transform("all", lambda x: x["score"])).alias("best_score"),
    )
    ids = docs.where("doc_id is not null").select("doc_id")
    zero = F.lit(0).cast("long")
    return ids.join(per, "doc_id", "left").select("doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
