import hashlib
import re
from collections import defaultdict

import numpy as np

from oremill.llm.fingerprint_index import FingerprintIndex, remove_repeated_words

from .test_repeats import ROW, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    at, words = defaultdict(set), {}
    for i, t in rows:
        words[i] = WORD.findall(t or "")
        for p in range(len(words[i]) - k + 1):
            at[tuple(words[i][p : p + k])].add((i, p))
    gone = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + k] = True
    return {i: (i, len(w), int(gone[i].sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone[i]) if not g).encode()).hexdigest()) for i, w in words.items()}


def test_report_matches_brute_force(spark):
    rows = texts(3, 80) + [(900, "w " * 200), (901, "u v w " * 40), (902, "w\t" * 36)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({"window": 35}, {"window": 12, "batches": 3, "group": 3}):
        got = {r[0]: tuple(r) for r in remove_repeated_words(f, text=False, **options).collect()}
        assert got == brute(rows, options["window"])


def hot_rows(n=240):
    """Texts that share a phrase of a window's length or less, between words of their own."""
    phrase = " ".join(f"p{k}" for k in range(14))
    own = lambda i, k: " ".join(f"d{i}x{j}" for j in range(k))
    return [(i, f"{own(i, 9)} {phrase if i % 3 else phrase + ' tail ' + phrase} {own(i, 5 + i % 4)}") for i in range(n)] + [(n, own(3, 9) + " " + phrase)]


def test_a_phrase_in_very_many_texts(spark):
    rows = hot_rows()
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, group in ((4, 3), (4, 512), (10**6, 512)):
        got = {r[0]: tuple(r) for r in remove_repeated_words(f, text=False, window=12, batches=3, group=group, hot=hot).collect()}
        assert got == brute(rows, 12)


def removed(spans, rows):
    gone = {i: set() for i, _ in rows}
    for r in spans.collect():
        gone[r.doc_id].update(range(r.start, r.stop))
    return {i: len(g) for i, g in gone.items()}


def test_a_lasting_index_takes_batch_after_batch(spark):
    rows = texts(4, 60) + [(10**4 + i, t) for i, t in hot_rows(60)]
    f = spark.createDataFrame(rows, "doc_id long, text string")
    index = FingerprintIndex(spark, window=12, group=8, n_buckets=16, name="oremill_test_index", hot=4)
    try:
        found, levels = None, []
        for k in range(5):
            new = index.add(f.where(f"doc_id % 5 = {k}"))
            found = new if found is None else found.unionByName(new)
            levels.append([level for level, _ in index.runs])
            index = FingerprintIndex.open(spark, "oremill_test_index")
            seen = [r for r in rows if r[0] % 5 <= k]
            assert removed(index.resolve(found, f), seen) == {i: x[2] for i, x in brute(seen, 12).items()}
        assert levels == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]
        again = index.add(f.where("doc_id % 5 = 1"))  # rows that came in before are no repeats of themselves
        assert removed(index.resolve(found.unionByName(again), f), rows) == {i: x[2] for i, x in brute(rows, 12).items()}
    finally:
        index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("oremill_test_index")]


def test_edges(spark):
    assert remove_repeated_words(spark.createDataFrame([], ROW)).collect() == []
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t, "en", None, None), (1, t, None, "s", 3), (1, t, None, "s", 3), (3, None, None, None, None), (4, "a b", "x", "y", 1)]
    got = sorted(tuple(r)[:4] for r in remove_repeated_words(spark.createDataFrame(rows, ROW)).collect())
    assert got == [(1, 40, 0, t), (1, 40, 0, t), (3, 0, 0, ""), (4, 2, 0, "a b")]
