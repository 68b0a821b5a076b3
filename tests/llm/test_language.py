import math

import numpy as np

from oremill.llm import language as L

from .test_repeats import ROW


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where(L.fold(3) != 1))
    got = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(L.fold(3) == 1).collect()
    right = np.mean([r.lang == r.lang_pred for r in got if r.lang_pred != "und"])
    print("accuracy", right, len(got), [(r.lang, r.lang_pred, round(r.score, 3)) for r in got if r.lang != r.lang_pred][:20])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    none = spark.createDataFrame([], ROW)
    assert L.predict(none, L.fit(none)).collect() == []
    rows = [(None, "abc", "en", None, None), (1, None, "en", None, None), (2, "123 … !", "en", "s", 1), (3, "the words", None, "s", 1), (4, "ж", "ru", "s", 1), (4, "ж", "ru", "s", 1)]
    d = spark.createDataFrame(rows, ROW)
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.predict(d, L.fit(none)).collect()} == {(k, "und", 0.0) for k in (1, 2, 3, 4)}
    one = L.fit(d.where("lang = 'ru'"))
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.predict(d, one).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "ru", 1.0), (4, "ru", 1.0)}
    two = L.predict(d, L.fit(d)).collect()
    assert len(two) == 5 and {r.lang_pred for r in two if r.doc_id == 4} == {"ru"}


def test_families_split_apart():
    assert L.families_of(np.array([[1, 0, 0], [0.9, 0.1, 0], [0, 0, 1], [0, 0.1, 1.0]])).tolist() == [0, 0, 1, 1]


def slow_prediction(model, text):
    """(lang_pred, score) of one text, from the weights alone."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    low = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    low = [b if b >= 128 or 97 <= b <= 122 else 32 for b in low]
    count = {}
    for a, b, c in zip(low, low[1:], low[2:]):
        if (a, b, c) != (32, 32, 32):
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 20
            count[h] = count.get(h, 0) + 1
    space = 32 * (0x9E3779B1 + 0x85EBCA77 + 0xC2B2AE3D) % 2**32 >> 20
    count.pop(space, None)  # the place of three spaces counts for no other
    size = math.sqrt(sum(count.values())) or 1.0
    margin = [float(model.w[-1, k]) + sum(math.sqrt(n) / size * float(model.w[h, k]) for h, n in count.items()) for k in range(model.w.shape[1])]
    sure = [1 / (1 + math.exp(-3 * m)) for m in margin]
    family, score = 0, 1.0
    if model.n_families > 1:
        family = max(range(model.n_families), key=lambda f: margin[f])
        score, margin, sure = sure[family], margin[model.n_families :], sure[model.n_families :]
    mine = [k for k in range(len(model.langs)) if model.family[k] == family]
    votes, sums = {k: 0 for k in mine}, {k: 0.0 for k in mine}
    for (a, b), m, p in zip(model.pairs, margin, sure):
        if a in votes:
            votes[a if m > 0 else b] += 1
            sums[a] += p
            sums[b] += 1 - p
    best = max(mine, key=lambda k: votes[k] + sums[k] / (len(model.langs) + 1))
    return model.langs[best], score * (sums[best] / (len(mine) - 1) if len(mine) > 1 else 1.0)


def test_prediction_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.where(L.fold(3) != 1))
    assert model.n_families > 1 and model.pairs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.predict(docs, model).collect():
        lang, score = slow_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, (r, lang, score)


def test_machines_reach_their_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 12)).astype(np.float32)
    y = np.where(rng.random((80, 3)) < 0.4, 1, -1).astype(np.float32)
    w = L.linear_svm(x, y, steps=4000, reg=0.05).astype(float)
    for k in range(3):
        one = np.where(y[:, k] == 1, 1 / (y[:, k] == 1).sum(), 1 / (y[:, k] == -1).sum())
        loss = lambda v: 0.5 * 0.05 * v @ v + 0.5 * (one * np.maximum(1 - y[:, k] * (x @ v[:-1] + v[-1]), 0) ** 2).sum()
        for _ in range(40):
            assert loss(w[:, k]) <= loss(w[:, k] + rng.normal(size=13) * 0.05) + 1e-6


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the words of that text " * 3, "en") for i in range(400)] + [(9000 + i, "слово дом река", f"r{i}") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(d, 8).langs == ["en", "r0", "r1", "r2"] and L.fit(d, 2).langs == ["en", "r0"]


def test_clashing_columns_and_a_very_long_text(spark):
    long = "le mot de la phrase " * 400_000
    rows = [(1, "the word of that text", "en", 1), (2, long, "fr", 2), (3, "la phrase", None, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, level int").withColumn("x", L.F.lit("y")).withColumn("score", L.F.lit(7))
    got = {r.doc_id: r.lang_pred for r in L.labelled(d, L.fit(d)).collect()}
    assert got == {1: "en", 2: "fr", 3: "fr"}
    data = np.frombuffer(long.encode(), np.uint8)
    assert np.allclose(L.features(data, np.array([0, len(data)])), L.features(data[: 20 * 1000], np.array([0, 20_000])), atol=1e-3)
