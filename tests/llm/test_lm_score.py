import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from oremill.llm import lm_score as M
from oremill.llm.language import fold

from .test_repeats import ROW

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def tokens(t):
    return [*WORD.findall((t or "").translate(LOW)), None]


def base(docs, train):
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in docs}


def case(seed):
    r = random.Random(seed)
    langs = [[a + b for a in s for b in s] for s in (["ba", "so", "ti"], ["éx", "ou", "ny"], ["Qu", "wo", "kk"])]
    docs = [(0, None), (1, ""), (2, " \t")]
    for i in range(3, 300):
        lang = r.choice(langs)
        docs.append((i, " ".join(r.choice(lang) + r.choice(["", "", r.choice(lang)]) + r.choice(["", ","]) for _ in range(r.randint(1, 120)))))
    return docs


def test_base_matches_brute_force_and_model_beats_it(spark, monkeypatch):
    docs = case(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for frequent in (1 << 17, 20):
        monkeypatch.setattr(M, "FREQUENT", frequent)
        train = d.where(fold(5) != 1)
        ids = {r.doc_id for r in train.collect()}
        want = base(docs, [x for x in docs if x[0] in ids])
        got = {r.doc_id: r for r in M.score(d, train).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3] and abs(r.base_score - want[i][3]) < 1e-6
        held = [r for i, r in got.items() if i not in ids]
        assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held) + 1 and all(r.score < 0 for r in held)


def test_classes_in_a_context_sum_to_one():
    w = np.random.default_rng(1).normal(size=(M.FEATURES, M.CLASSES))
    p = np.exp(M.class_probabilities(w, np.arange(50), np.arange(50) % M.SKIP))
    assert np.allclose(p.sum(1), 1)


def test_contexts():
    data, off = np.frombuffer(b"A b cab x", np.uint8), np.array([0, 3, 3, 7, 9])
    t = M.Tokens(data, off)
    assert t.at.tolist() == [0, 3, 4, 6, 8] and (t.word[[2, 3, 5, 7]] == M.END).all()
    assert t.one.tolist() == [M.START, t.word[0], t.word[1], M.START, M.START, t.word[4], M.START, t.word[6]]
    assert t.two.tolist() == [M.START, M.START, t.word[0], M.START, M.START, M.START, M.START, M.START]
    assert pa.__version__


def test_edges(spark):
    none = spark.createDataFrame([], ROW)
    assert M.score(none, none).collect() == []
    d = spark.createDataFrame([(None, "a", "x", "y", 1), (1, None, None, None, None), (2, "a b", "x", "y", 1), (2, "a b", "x", "y", 1)], ROW)
    got = sorted(tuple(r)[:4] for r in M.score(d, none).collect())
    assert got == [(1, 1, 0, 0), (2, 3, 0, 0), (2, 3, 0, 0)]
    got = sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in M.score(d, d).collect())
    want = base([(1, None), (2, "a b")], [(1, None), (2, "a b"), (2, "a b")])
    assert got == [(i, want[i][1], want[i][2], round(want[i][3], 9)) for i in (1, 2, 2)]


def test_words_before_carry_weight(spark):
    """Words that the word before decides, with endings that tell nothing and fewer of them than classes."""
    r = random.Random(3)
    first, second = [f"{c}{d}x" for c in "abcdefgh" for d in "pqrst"], {}
    docs = []
    for i in range(400):
        out = []
        for _ in range(30):
            a = r.choice(first)
            out += [a, second.setdefault(a, r.choice(["one", "two", "tri", "fou"]))]
        docs.append((i, " ".join(out)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = M.score(d, d.where(fold(5) != 1)).where(fold(5) == 1).collect()
    per_pair = sum(r.score - r.base_score for r in rows) / sum((r.n_tokens - 1) / 2 for r in rows)
    # a first word is one of 40 in place of 80, and the second, one of four in half of all places, is certain
    assert 0.85 < per_pair / math.log10(2 * 8) < 1.02, per_pair


def test_distributions_of_contexts_sum_to_one():
    rng = np.random.default_rng(2)
    k = np.unique(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(25) | rng.integers(0, M.SKIP * M.CLASSES, 3000).astype(np.uint64))
    c = rng.integers(1, 9, len(k))
    w = rng.normal(size=(M.FEATURES, M.CLASSES))
    seen = 0
    for words, u, context, lp, total in M.word_models(k, c, w):
        assert np.allclose(np.exp(lp).sum(1), 1) and len(u) == len(words) and len(total) == len(context)
        seen += total.sum()
    assert seen == c.sum()
    known, unknown = k[:5], (np.arange(5).astype(np.uint64) + np.uint64(99)) << np.uint64(25)
    every = np.concatenate([(x - x % np.uint64(4096) + x % np.uint64(4096) // np.uint64(48) * np.uint64(48))[None] + np.arange(48, dtype=np.uint64) for x in [*known, *unknown]])
    order = np.argsort(every)
    value = np.empty(len(every))
    value[order] = M.context_values(k, c, w, every[order])
    assert np.allclose(np.exp(value).reshape(-1, 48).sum(1), 1)


def test_clashing_columns_and_a_very_long_text(spark):
    text = "ab cde " * 600_000
    d = spark.createDataFrame([(1, text, 5, "w"), (2, "ab", 6, "b")], "doc_id long, text string, bucket int, words string")
    got = {r.doc_id: r.n_tokens for r in M.score(d, d).collect()}
    assert got == {1: 1_200_001, 2: 2}
