import hashlib
import random
import re

from oremill.llm.decontaminate import clean, contamination

from .test_repeats import ROW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for p in range(max(len(w) - k, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = set()
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for s in sizes:
            for p in range(len(w) - s + 1):
                if (x := wins.get(tuple(w[p : p + s]))) is not None:
                    hit |= set(range(p, p + s))
                    found |= x
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["An", "bé", "c3", "the", "of", "Zz"]) + r.choice(["", "x", "Y", "é", "0"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 5, 9, 10, 11, 25])))) for i in range(3, 40)]
    items += [(50, None), (51, ""), (52, "!!"), (53, items[0][1]), (54, items[5][1] + ". " + items[6][1]), (100, "unique oneword thing")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "unique ONEWORD, thing")]
    for i in range(4, 150):
        parts = []
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.4:
                w = (r.choice(items)[1] or "").split()
                a = r.randint(0, len(w))
                parts.append("-".join(w[a // 2 :]))
            else:
                parts.append(", ".join(word() for _ in range(r.randint(1, 30))))
        docs.append((i, "\n".join(parts)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = case(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {tuple(r) for r in contamination(d, b).collect()} == want
    assert {tuple(r) for r in contamination(d, b, limit=2000).collect()} == want


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a b", "x", "y", 1), (1, None, None, None, None), (2, "a b", "x", "y", 1), (2, "a b", "x", "y", 1)], ROW)
    assert sorted(tuple(r)[:4] for r in contamination(docs, none).collect()) == [(1, 0, 0, 0), (2, 2, 0, 0), (2, 2, 0, 0)]
    items = spark.createDataFrame([(None, "a b"), (7, "A B"), (7, "A B")], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in contamination(docs, items).collect()) == [(1, 0, 0, 0), (2, 2, 2, 1), (2, 2, 2, 1)]
    assert contamination(spark.createDataFrame([], ROW), items).collect() == []


def test_long_items_are_cut_and_lose_no_window(spark):
    docs, items = case(2)
    items = [*items, (60, " ".join(t or "" for _, t in items)), (61, " ".join(t or "" for _, t in docs[4:40]))]
    docs = [*docs, (4, "another text of document 4"), (4, docs[4][1])]
    d = spark.createDataFrame([(*x, "u") for x in docs], "doc_id long, text string, uid string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, part int")
    want = sorted(brute(docs, items))
    assert any(w[2] > 100 for w in want)
    for limit in (4000, 1 << 20):
        assert sorted(set(tuple(r) for r in contamination(d, b, limit=limit).collect())) == want
        assert sorted((r.doc_id, r.text or "") for r in clean(d, b, limit=limit).collect()) == sorted((i, t or "") for i, t in docs if not next(iter(brute([(i, t)], items)))[5])


def test_an_item_longer_than_a_slice_and_a_very_long_text(spark):
    words = [f"w{i}" for i in range(1_600_000)]
    docs = [(1, " ".join(words[1_500_000:1_500_030])), (2, "no such words " * 9), (3, " ".join(words[:200_000]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([("long", " ".join(words)), ("other", "u v w")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination(d, b).collect()}
    assert got == {1: (30, 30, 1), 2: (27, 0, 0), 3: (200_000, 200_000, 1)}
