import hashlib

import pytest

from oremill.functions.hashing import PRIME
from oremill.operators import similarity as S
from oremill.sources.readers import builtin_corpus

TEXT = "This is a sample document for testing shingling."
# The 100-component signature of TEXT for k=5, n=100, seed 42.
SIGNATURE = [
    2186258, 87698587, 89240749, 7471309, 54234297, 263421532, 163268404, 24506622, 5156157, 60050740, 9891126,
    54354879, 499226685, 103721781, 89045834, 6564099, 370887024, 41868788, 6066040, 8348912, 36600821,
    51950986, 245031457, 99971994, 56673962, 75203094, 58835906, 7274510, 22845985, 105225574, 15029773,
    5099486, 92982790, 83496205, 323829749, 7831546, 15896576, 63424546, 45644416, 17934593, 98774811, 6787450,
    49933077, 24653782, 206383502, 227310338, 21667214, 57970811, 12153131, 35736551, 70681130, 2612487,
    14337933, 43937875, 22751523, 99198889, 139610187, 38486451, 22545323, 72522636, 131924804, 16608685,
    69233332, 429984979, 109166342, 38149306, 125002047, 10351108, 60943624, 17005183, 89499533, 66796175,
    1721189, 117451606, 7440159, 325762842, 105365458, 6502708, 65750241, 38435497, 244326732, 2298821,
    180742090, 16447857, 279034471, 76522784, 57956169, 4413649, 38477726, 15996326, 81949364, 62934023,
    218183803, 116678254, 67108899, 129341692, 24503841, 60152750, 60423089, 96949510,
]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_shingles(spark):
    raw = S.shingle_arrays(docs(spark, TEXT, "", None, "abcd"), 5, hashing=False).orderBy("doc_id").collect()
    want = sorted({TEXT[i : i + 5] for i in range(len(TEXT) - 4)})
    assert raw[0].shingles == want and len(want) == 44 and [len(r.shingles) for r in raw[1:]] == [0, 0, 0]
    hashed = S.shingle_arrays(docs(spark, TEXT), 5).first().shingles
    assert hashed == sorted({int(hashlib.md5(g.encode()).hexdigest(), 16) % 2**32 for g in want}) and 3833772178 in hashed


def test_signature_is_the_known_one(spark):
    rows = S.signatures(docs(spark, TEXT, TEXT, "abc"), 5, 100).orderBy("doc_id").collect()
    assert rows[0].signature == rows[1].signature == SIGNATURE and rows[2].signature == [PRIME] * 100
    assert S.signatures(docs(spark, "abc"), 5, keep_empty=False).count() == 0


def test_corpus_similarities(spark):
    p = S.SimilarityPipeline(builtin_corpus(spark))
    assert [r.n_shingles for r in p.counts.orderBy("doc_id").collect()] == [72, 76, 71, 74, 63, 59, 59]
    exact = {(r.doc_a, r.doc_b): round(r.jaccard, 3) for r in p.exact.collect() if r.jaccard}
    assert exact == {("doc1", "doc2"): 0.065, ("doc3", "doc5"): 0.015, ("doc3", "doc6"): 0.016, ("doc3", "doc7"): 0.016, ("doc5", "doc6"): 0.718, ("doc5", "doc7"): 0.718, ("doc6", "doc7"): 1.0}
    est = {(r.doc_a, r.doc_b): round(r.estimate, 2) for r in p.estimates.collect() if r.estimate}
    assert est == {("doc1", "doc2"): 0.1, ("doc5", "doc6"): 0.7, ("doc5", "doc7"): 0.7, ("doc6", "doc7"): 1.0}
    assert {tuple(r) for r in p.candidates.collect()} == {("doc5", "doc6"), ("doc5", "doc7"), ("doc6", "doc7")}
    assert [tuple(r) for r in p.pairs.collect()] == [("doc6", "doc7", 1.0)]
    assert p.report().count() == 1 + 7 + 21 + 1


def test_bands():
    assert {(n, t): S.choose_bands(n, t) for n in (64, 100, 128, 256) for t in (0.5, 0.6, 0.7, 0.8, 0.9)} == {
        (n, t): b
        for n, row in {64: (16, 16, 8, 8, 4), 100: (20, 20, 10, 10, 5), 128: (32, 16, 16, 8, 8), 256: (64, 32, 32, 16, 8)}.items()
        for t, b in zip((0.5, 0.6, 0.7, 0.8, 0.9), row)
    }
    for bad in (0, -1, 7):
        with pytest.raises(ValueError):
            S.LSH(100, 0.8, bad)


def test_unequal_signatures_fail(spark):
    d = spark.createDataFrame([(1, [1, 2]), (2, [1])], "doc_id long, signature array<bigint>")
    with pytest.raises(Exception, match="differ"):
        S.estimate_pairs(d).collect()
    assert S.LSH(100, 0.8).pairs(spark.createDataFrame([], "doc_id long, signature array<bigint>")).collect() == []


def test_jaccard_of_empty_sets(spark):
    d = spark.createDataFrame([(1, []), (2, []), (3, [1])], "doc_id long, shingles array<bigint>")
    assert {tuple(r) for r in S.jaccard_pairs(d).collect()} == {(1, 2, 0.0), (1, 3, 0.0), (2, 3, 0.0)}
    assert d.select(S.jaccard(d.shingles, d.shingles).alias("j")).orderBy("j").collect()[-1].j == 1.0
