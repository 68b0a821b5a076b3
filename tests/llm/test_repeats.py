import hashlib
import random

import numpy as np

from oremill.llm.bwt import repeat_classes
from oremill.llm.repeats import remove_repeats, repeat_report, stripped

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k):
    seen, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - k + 1):
            w = t[p : p + k]
            if w in seen and seen[w] != (i, p):
                gone[p : p + k] = True
            seen.setdefault(w, (i, p))
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        left = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (i, len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    syl = ["ba", "é", "so", "ti", "ne", "ß", "qu", "or"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    para = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(0, ""), (1, None), (2, "x"), (3, "a" * 1000), (4, "ab" * 300 + "a" * 200), (5, "a" * 99), (6, "a" * 100), (7, para[0] * 30)]
    for i in range(8, n):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(para)
            a = r.randint(0, len(p) // 2)
            parts.append(p[a : r.randint(a, len(p))] if r.random() < 0.6 else " ".join(word() for _ in range(20)))
        rows.append((i * 7, " ".join(parts)))
    return rows


def test_bwt_classes_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, sig, k = (int(rng.integers(a, b)) for a, b in ((2, 120), (2, 6), (1, 12)))
        s = np.append(rng.integers(0, sig, n), 0).astype(np.uint16)
        sa, new = repeat_classes(s, k)
        cls = np.empty(len(s), int)
        cls[sa] = np.cumsum(new)
        groups = {}
        for i in range(len(s) - k + 1):
            if s[i : i + k].all():
                groups.setdefault(s[i : i + k].tobytes(), set()).add(cls[i])
        assert all(len(v) == 1 for v in groups.values())
        assert len({min(v) for v in groups.values()}) == len(groups)


def test_report_matches_brute_force(spark):
    for window in (100, 40):
        rows = texts(window)
        got = {r[0]: tuple(r) for r in repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window).collect()}
        assert got == brute(rows, window)


def test_large_groups_split(spark):
    rows = texts(5, 120)
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r) for r in repeat_report(f, 100, group=3).collect()}
    assert got == brute(rows, 100)


def test_edges(spark):
    empty = spark.createDataFrame([], ROW)
    assert repeat_report(empty).collect() == []
    t = "lorem ipsum dolor " * 3 + "unique tail of this text, which is long enough for one window of a hundred bytes and some"
    rows = [(None, t, "en", None, None), (1, t, None, "s", 3), (1, t, None, "s", 3), (2, t, "en", "s", 3), (3, None, None, None, None)]
    got = sorted(tuple(r)[:3] for r in repeat_report(spark.createDataFrame(rows, ROW)).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[2][2] and got[3] == (3, 0, 0)
    assert [(r.doc_id, r.text, r.lang, r.n_removed) for r in stripped(spark.createDataFrame(rows[3:], ROW)).collect() if r.doc_id == 2] == [(2, t, "en", 0)]
    more = remove_repeats(spark.createDataFrame(rows, ROW).withColumnRenamed("lang", "start")).where("doc_id = 2").collect()[0]
    assert more.kept == b"" and [tuple(x) for x in more.removed] == [(0, len(t))]


def test_repeated_rows_keep_what_occurs_once(spark):
    shared = "shared boilerplate that stands in many documents, and that is quite a bit longer than one window of a hundred bytes is. "
    rows = [(i, f"{shared} ending {i} " + f"words of document {i} alone {i * i} " * (1 + i % 3)) for i in range(10, 21)] + texts(9)[3:5]
    want = brute(rows, 100)
    assert any(0 < w[2] < w[1] for w in want.values())
    for group in (512, 3):
        twice = spark.createDataFrame([*rows, *rows[:6], rows[0], *rows[-2:]], "doc_id long, text string").repartition(5)
        got = repeat_report(twice, 100, group).collect()
        assert len(got) == len(rows) + 9 and all(tuple(r) == want[r.doc_id] for r in got)


def test_a_phrase_in_very_many_texts(spark):
    phrase = "a phrase that stands in a third of all texts of this table, of sixty bytes."
    own = lambda i, k: " ".join(f"{i}w{j * i}" for j in range(k))
    rows = [(i, f"{own(i, 12)} {phrase if i % 3 else phrase * 2} {own(i + 1, 9 + i % 4)}") for i in range(200)] + [(200, own(5, 12) + " " + phrase)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, group in ((4, 3), (4, 512), (10**6, 512)):
        assert {r[0]: tuple(r) for r in repeat_report(f, 60, group, hot).collect()} == brute(rows, 60)


def test_clashing_columns_and_very_long_texts(spark):
    body = "".join(f"{i} " for i in range(260_000))  # more than one slice, without a repeat of 100 bytes
    rows = [(1, body), (2, body[5000:700_000]), (3, "x" + body[-300:])]
    f = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, start string, grp int")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeat_report(f).collect()}
    assert got == {1: (len(body), 0), 2: (695_000, 695_000), 3: (301, 300)}
