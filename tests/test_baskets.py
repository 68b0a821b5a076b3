import random
from itertools import combinations

import pytest
from pyspark.ml.fpm import FPGrowth

from oremill.operators import baskets as B
from oremill.sources import sinks as K
from oremill.sources.readers import builtin_transactions


def test_known_itemsets_and_rules(spark):
    m = B.BasketMiner(builtin_transactions(spark), min_support=2).fit()
    got = {"".join(r.itemset): r.support for r in m.itemsets.collect()}
    assert got == {"A": 2, "B": 3, "C": 3, "E": 3, "AC": 2, "BC": 2, "BE": 3, "CE": 2, "BCE": 2}
    rules = {("".join(r.lhs), "".join(r.rhs)): (r.support, round(r.confidence, 4)) for r in m.rules(0.5).collect()}
    assert len(rules) == 14 and {k for k, v in rules.items() if v[1] == 1} == {("A", "C"), ("B", "E"), ("E", "B"), ("BC", "E"), ("CE", "B")}
    assert rules["B", "E"] == (3, 1.0) and rules["BE", "C"] == (2, 0.6667)
    share = {("".join(r.lhs), "".join(r.rhs)): r.support for r in m.rules(0.5, fractional=True).collect()}
    assert share == {k: v[0] / 4 for k, v in rules.items()}
    assert K.rule_lines(m.rules(0.5)).orderBy("rank").first().line == "{B} -> {E} support: 3, confidence: 1.0000"
    assert K.itemset_lines(m.itemsets).where("k = 3").first().line == "{B, C, E}: 2"


def test_threshold():
    assert B.support_threshold(100000, 1.0) == 1000 and B.support_threshold(50, 1.0) == 1 and B.support_threshold(9, None, 7) == 7
    for bad in (0, -1, 101):
        with pytest.raises(ValueError):
            B.support_threshold(10, bad)


def test_candidates_are_pruned(spark):
    pairs = lambda *p: spark.createDataFrame([(list(x),) for x in p], "itemset array<string>")
    assert [r.itemset for r in B.candidates(pairs("AB", "AC", "BC"), 3).collect()] == [["A", "B", "C"]]
    assert B.candidates(pairs("AB", "AC"), 3).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting_and_fpgrowth(spark, seed):
    r = random.Random(seed)
    trx = [sorted({r.choice("abcdefgh") for _ in range(r.randint(1, 6))}) for _ in range(120)]
    want = {}
    for k in range(1, 7):
        for c in combinations("abcdefgh", k):
            n = sum(set(c) <= set(t) for t in trx)
            if n >= 12:
                want[c] = n
    d = spark.createDataFrame([(i, x) for i, t in enumerate(trx) for x in t + t[:1]], "tid long, item string")
    assert {tuple(x.itemset): x.support for x in B.frequent_itemsets(d, 12).collect()} == want
    f = FPGrowth(minSupport=12 / 120, minConfidence=0.1).fit(spark.createDataFrame([(t,) for t in trx], "items array<string>"))
    assert {tuple(sorted(x.items)): x.freq for x in f.freqItemsets.collect()} == want


def test_empty(spark):
    d = spark.createDataFrame([], "tid long, item string")
    m = B.BasketMiner(d, min_support=1).fit()
    assert m.itemsets.collect() == [] and m.rules(0.5).collect() == [] and m.rules(0.5, fractional=True).collect() == []


def test_summary_of_levels(spark):
    from oremill.operators.baskets import BasketMiner
    from oremill.sources.readers import builtin_transactions

    rows = BasketMiner(builtin_transactions(spark), min_support=2).summary().orderBy("k").collect()
    assert [(r.k, r.candidates, r.itemsets) for r in rows] == [(1, 5, 4), (2, 6, 4), (3, 1, 1), (4, 0, 0)] and all(r.seconds >= 0 for r in rows)
