import math

from oremill.llm import license_scan as L

from .test_repeats import ROW

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY 4.0.": "CC-BY",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This program is free software; see the GNU Affero General Public License, version 3, for its terms.": "AGPL-3.0",
    "The library comes under the GNU Lesser General Public License.": "LGPL",
}
UNRELATED = ["The driver's license was lost.", "Copyright 2020, all rights reserved.", "No warranty for the carpet.", "Their licence fee is ten coins.", "License"]


def test_families_and_unknown():
    for line, family in LINES.items():
        assert L.predict_one(line)[::2] == (family, True), (line, L.predict_one(line))
    for line in UNRELATED:
        assert not L.predict_one(line)[2], (line, L.predict_one(line))


def judged(line):
    """The decision on one line from the model's tables alone, word by word."""
    c, words, word = L.trained(), [], ""
    for x in line.lower() + " ":
        if x in "abcdefghijklmnopqrstuvwxyz0123456789.":
            word += x
        elif word.rstrip("."):
            words.append(word.rstrip("."))
            word = ""
        else:
            word = ""
    grams = set(words).union(f"{a} {b}" for a, b in zip(words, words[1:]))
    rows = [c.weights[i] for i, g in enumerate(c.vocab) if g in grams]
    z = [(sum(r[k] for r in rows) / math.sqrt(max(len(rows), 1)) + c.bias[k]) / c.temperature for k in range(len(c.families))]
    p = [math.exp(v - max(z)) for v in z]
    score, family = max(p) / sum(p), c.families[p.index(max(p))]
    sure = [f for f, _, t in L.templates() if f == family and len(grams.intersection(t)) >= L.CONFIRM * len(t)]
    return family, score, family != L.UNKNOWN and score >= L.LEAST and bool(sure)


PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_planted_lines_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted({PLANTED[x] for x in (r.text or "").split("\n") if x in PLANTED})) for r in docs.collect()}
    got = {r.doc_id: r.families for r in L.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 5


def test_gate_lets_every_confirmable_text_pass(spark):
    texts = [b for _, bodies in L.BODIES.items() for b in bodies] + [n for names in L.NAMES.values() for n in names]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    assert d.where(~L.gated(L.F.col("text"))).collect() == []
    for _, _, t in L.templates():
        left = [g for g in t if not any(w in x for x in g.split() for w in L.gate_words()) and not any(w in g for w in L.ANCHORS)]
        assert len(left) < L.CONFIRM * len(t)


def test_plan_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, "some words\n" + x + "\nmore words") for i, x in enumerate([*LINES, *UNRELATED])], "doc_id long, text string")
    both = docs.unionByName(extra)
    want = {}
    for r in both.collect():
        lines = [x for x in (r.text or "").split("\n") if any(a in x.lower() for a in L.ANCHORS)]
        got = [judged(x) for x in lines]
        sure = [g for g in got if g[2]]
        want[r.doc_id] = (len(lines), len(sure), ",".join(sorted({g[0] for g in sure})), round(max((g[1] for g in sure), default=0.0), 9))
    found = {r.doc_id: (r.n_candidates, r.n_confirmed, r.families, round(r.best_score, 9)) for r in L.scan(both).collect()}
    assert found == want and sum(w[1] for w in want.values()) > 5


def test_edges(spark):
    assert L.scan(spark.createDataFrame([], ROW)).collect() == []
    t = "Released under the MIT License.\nReleased under the MIT License."
    rows = [(None, t, "x", "y", 1), (1, None, None, None, None), (2, "", "x", "y", 1), (3, t, "x", "y", 1), (3, t, "x", "y", 1), (4, "license", "x", "y", 1)]
    got = sorted(tuple(r)[:4] for r in L.scan(spark.createDataFrame(rows, ROW).withColumn("paragraph", L.F.lit(1)).withColumn("family", L.F.lit(2))).collect())
    assert got[:2] == [(1, 0, 0, ""), (2, 0, 0, "")] and got[-1] == (4, 1, 0, "") and got[2] == got[3] and got[2][3] == "MIT"


SHORT = {"CC BY 4.0": "CC-BY", "This work is CC BY-SA 4.0": "CC-BY-SA", "CC BY-NC 4.0": "CC-BY-NC", "CC0 1.0 Universal": "CC0", "Released under GPL v3": "GPL-3.0", "Apache 2.0": "Apache-2.0", "MPL 2.0": "MPL-2.0"}


def test_short_notices_bodies_and_wrapped_lines(spark):
    cases = list(SHORT.items()) + [(b, f) for f, bodies in L.BODIES.items() for b in bodies]
    cases += [("Released under the GNU General\nPublic License, version 3.", "GPL-3.0"), ("first part\n\nReleased under the Apache\nLicense, Version 2.0.\n\nlast part", "Apache-2.0")]
    for b, f in [(b, f) for f, bodies in L.BODIES.items() for b in bodies]:
        w = b.split()
        cases.append(("\n".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8)), f))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")).collect()}
    for i, (t, f) in enumerate(cases):
        assert got[i].families == f and got[i].n_candidates >= got[i].n_confirmed >= 1, (t, f, got[i])


def test_texts_without_a_telling_gram_cannot_be_confirmed():
    tells = set(L.telling())
    for _, _, t in L.templates():
        assert len(set(t) - tells) < L.CONFIRM * len(t)
