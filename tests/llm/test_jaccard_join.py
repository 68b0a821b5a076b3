import random
import re

import numpy as np

from oremill.llm import jaccard_join as J
from oremill.llm.jaccard_join import jaccard_components

from .test_components import roots
from .test_repeats import ROW

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    ids, links = sorted(sets), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    up = roots(links)
    return {(i, len(sets[i]), up.get(i, i)) for i in ids}


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    rows = [(0, ""), (1, None), (2, "One"), (3, "one"), (4, "a B"), (5, "A b"), (6, "c d e"), (7, "x " * 500), (8, "x " * 40)]
    while len(rows) < n:
        base = [word() for _ in range(r.choice([4, 12, 40, 110, 125, 140, 160, 400]))]
        for _ in range(r.choice([1, 2, 3, 25])):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 25)):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.2:
                base = t
            rows.append((len(rows), " ".join(t).title() if r.random() < 0.2 else " ".join(t)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 500)
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for size, num, den, block in ((3, 90, 100, 256), (5, 80, 100, 6), (2, 70, 100, 8)):
        got = {tuple(r) for r in jaccard_components(f, size, num, den, block).collect()}
        assert got == brute(rows, size, num, den)


def test_edges(spark):
    assert jaccard_components(spark.createDataFrame([], ROW)).collect() == []
    t = "a b c d e f g h"
    rows = [(None, t, "en", None, None), (5, t, None, "s", 3), (5, t, None, "s", 3), (3, None, None, None, None), (4, t.upper(), "x", "y", 1)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, ROW)).collect())
    assert got == [(3, 0, 3), (4, 4, 4), (5, 4, 4), (5, 4, 4)]


def test_many_exact_and_near_copies_in_many_tasks(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(1000 - i, " ".join(base)) for i in range(300)]
    for i in range(200):
        t = list(base)
        t[r.randrange(60)] = f"x{i % 40}"
        rows.append((2000 + i, " ".join(t)))
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for num, block in ((80, 16), (97, 256)):
        assert {tuple(x) for x in jaccard_components(f, 3, num, 100, block).collect()} == brute(rows, 3, num, 100)


def test_clashing_columns_and_a_very_long_text(spark):
    words = [f"{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5000:])), (3, " ".join(words[:9]))]
    f = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, key string")
    assert {tuple(x) for x in jaccard_components(f, 3, 90, 100).collect()} == {(1, 299_998, 1), (2, 294_998, 1), (3, 7, 3)}


def test_tokens_of_very_many_texts(spark):
    rows = corpus(6, 300)
    common = " ".join(f"common{k}" for k in range(30))
    rows += [(10_000 + i, f"{common} own{i} text{i} here{i // 2}") for i in range(200)] + [(20_000 + i, f"{common} " + " ".join(f"t{i // 3}x{j}" for j in range(120))) for i in range(60)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size, num, hot in ((3, 90, 3), (2, 75, 20)):
        assert {tuple(x) for x in jaccard_components(f, size, num, 100, 64, hot).collect()} == brute(rows, size, num, 100)


def test_pairs_of_a_block_match_brute_force():
    rng, found = np.random.default_rng(7), 0
    for num, den in [(80, 100), (90, 100), (1, 3), (1, 1)] * 40:
        pool = [rng.choice(60, rng.integers(1, 40), replace=False) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(1, 40)):
            base = pool[rng.integers(4)]
            s = set(base[: rng.integers(1, len(base) + 1)].tolist()) | set(rng.integers(60, 90, rng.integers(0, 3)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        i, j = J.links_of(sets, num, den)
        want = set()
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    want.add((a, b))
        assert set(zip(i.tolist(), j.tolist())) == want
        found += len(want)
    assert found > 1000
