import pytest

import __spark_entry__ as entry
from oremill.plans import queries as Q

from .compare import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    if name in Q.ORACLES:
        assert differs(spark, con, SF, name, Q.QUERIES[name], Q.ORACLES[name]) is None
    else:
        df = Q.QUERIES[name](spark, SF)
        assert df.columns and df.count() >= 0


def test_lsh_pairs_match_brute_force(spark):
    from oremill.operators import similarity as S

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sig = {r.doc_id: tuple(r.signature) for r in S.signatures(docs, keep_empty=False).collect()}
    lead = {}
    for d in sorted(sig):
        lead.setdefault(sig[d], d)
    want = set()
    for a in lead.values():
        for b in lead.values():
            if a < b and any(sig[a][k : k + 10] == sig[b][k : k + 10] for k in range(0, 100, 10)):
                same = sum(x == y for x, y in zip(sig[a], sig[b])) / 100
                if same >= 0.8:
                    want.add((a, b, same))
    assert {tuple(r) for r in Q.lsh_pairs(spark, SF).collect()} == want
    assert {tuple(r) for r in Q.lsh_classes(spark, SF).collect()} == {(d, lead[s]) for d, s in sig.items()}


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_a", "doc_b", "estimate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
