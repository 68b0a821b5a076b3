import numpy as np

from oremill.llm import embedding_dedup as E

from .test_components import roots


def brute(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {i: 0 for i, _ in rows}
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    up = roots(links)
    return {(i, count[i], up.get(i, i), up.get(i, i) == i) for i, _ in rows}


def case(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 2, 30])):
            v = (base + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2])) * rng.choice([1, 3])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)]))
    return rows + [(9000, None), (9001, [0.0] * dim), (9002, [1.0, None] + [0.0] * (dim - 2)), (9003, [float("nan")] * dim), (9004, [float("inf")] + [0.0] * (dim - 1)), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "MEMBERS", 16)
    monkeypatch.setattr(E, "VISITORS", 32)
    rows = case(3)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for cosine in (0.95, 0.99):
        want = brute(rows, cosine)
        assert {tuple(r) for r in E.near_duplicates(d, cosine, None, 25).collect()} == want
        for probes in (1, 2, 6):
            got = {r.vec_id: r for r in E.near_duplicates(d, cosine, probes, 25).collect()}
            found, links = sum(r.n_links for r in got.values()), sum(w[1] for w in want)
            assert all(got[w[0]].n_links <= w[1] for w in want) and found % 2 == 0 and found >= (0.6, 0.9, 0.99)[(1, 2, 6).index(probes)] * links
            for r in got.values():  # linked vectors are in one component, others alone
                assert (r.n_links > 0) == (sum(o.component_id == r.component_id for o in got.values()) > 1) and r.kept == (r.vec_id == r.component_id)


def test_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert {tuple(r) for r in E.near_duplicates(d).collect()} == brute([(r.vec_id, r.embedding) for r in d.collect()], 0.95)


def test_edges(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    rows = [(None, [1.0]), (2, [1.0]), (2, [1.0]), (1, [3.0]), (5, [-1.0])]
    got = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (5, 0, 5, True)]


def test_clashing_columns_and_tied_cells(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "a", 1, 2) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, weight int, lead int")
    got = {tuple(r) for r in E.near_duplicates(d, probes=1, per_cell=1).collect()}
    assert got == {(i, 19, i % 2, i < 2) for i in range(40)}
