import random
from itertools import combinations

import numpy as np
import pytest

from oremill.operators import edge_blocks as E
from oremill.operators import graph as G
from oremill.operators import spectral as L
from oremill.operators import triest as T


def ring(n, reach):
    return [(i, (i + d) % n) for i in range(n) for d in range(1, reach + 1)]


def count(edges):
    e = {tuple(sorted(x)) for x in edges if x[0] != x[1]}
    near = {}
    for u, v in e:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return sum(len(near[u] & near[v]) for u, v in e) // 3


def frame(spark, edges):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(edges)], "seq long, u long, v long")


def test_triangles(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(400)]
    assert G.triangle_count(frame(spark, edges)).first().triangles == count(edges)
    assert G.triangle_count(frame(spark, [])).first().triangles == 0


def test_triangles_between_blocks(spark, monkeypatch):
    """Hubs, ids of any size, both directions, loops and nulls; no path of two edges becomes a row."""
    r = random.Random(4)
    far = [r.randrange(-(2**62), 2**62) for _ in range(90)]
    edges = [(r.choice(far), r.choice(far)) for _ in range(1500)] + [(min(far), x) for x in far] + [(x, sorted(far)[1]) for x in far]
    truth = count(edges)
    frames = frame(spark, edges).unionByName(spark.createDataFrame([(0, None, far[0]), (1, far[0], None)], "seq long, u long, v long"))
    monkeypatch.setattr(G, "triangles", None)
    assert G.triangle_count(frames).first().triangles == truth
    blocks = E.EdgeBlocks(frames)
    n = len({tuple(sorted(x)) for x in edges if x[0] != x[1]})
    assert blocks.size == n == blocks.rows().distinct().count() and set(sorted(far)[:2]) <= set(blocks.hubs(60))
    assert blocks.triangle_count(above=20, block=100).first().triangles == truth
    u, v = (np.array(x) for x in zip(*sorted({tuple(sorted(x)) for x in edges if x[0] != x[1]})))
    monkeypatch.setattr(E, "WORDS", 7)
    half = [E.Block.build(u[p], v[p]) for p in (u % 2 == 0, u % 2 == 1)]
    assert sum(E.First.read(x).triangles_with(E.Block.read(y)) for x in half for y in half) == truth
    with pytest.raises(ValueError):
        E.Block.read(half[0][:-8])


def test_triangles_of_named_nodes(spark):
    assert G.triangle_count(spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c"), ("c", "d")], "u string, v string")).first().triangles == 1


def test_exact_regime_and_quirks(spark):
    edges = ring(60, 4)
    for variant in ("base", "impr"):
        x = T.Triest(10**6, variant).extend(edges)
        assert x.estimate() == count(edges) and x.t == x.sample_size == len(edges)
    x = T.Triest(10).extend([(1, 2), (2, 1), (3, 3)])
    assert (x.t, x.sample_size) == (2, 1)
    assert T.Triest(3, strict_capacity=False).extend(edges).sample_size == 4 and T.Triest(3).extend(edges).sample_size == 3
    assert T.xi(10, 5) == 12.0 and T.eta(10, 5) == 3.6 and T.xi(2, 5) == T.eta(2, 5) == 1.0
    got = {(r.m, r.t, r.sample_size, r.estimate) for r in T.run_triest(frame(spark, edges), [1000, 2000], "impr").collect()}
    assert got == {(m, len(edges), len(edges), float(count(edges))) for m in (1000, 2000)}
    with pytest.raises(ValueError):
        T.Triest(0)


def test_estimates_are_near_the_truth(spark):
    edges = ring(400, 5)
    random.Random(1).shuffle(edges)
    truth = count(edges)
    for variant in ("base", "impr"):
        mean = np.mean([T.Triest(700, variant, seed).extend(edges).estimate() for seed in range(30)])
        assert abs(mean - truth) < 0.15 * truth
    e = G.simple(frame(spark, edges))
    mean = np.mean([T.sampled_estimate(e, 1000, s).first().estimate for s in range(6)])
    assert abs(mean - truth) < 0.35 * truth
    assert T.sampled_estimate(e, 10**6).first().estimate == truth


def test_streams_that_fill_no_sample_are_counted_over_all_tasks(spark, monkeypatch):
    r = random.Random(8)
    plain = ring(60, 4)
    again = [(r.randrange(30), r.randrange(30)) for _ in range(500)]
    for edges, in_order in ((plain, []), (again, ["impr"])):
        r.shuffle(edges)
        for variant in ("base", "impr"):
            want = []
            for m in (40, 500, 10**9):
                x = T.Triest(m, variant, 3).extend(edges)
                want.append((m, variant, x.t, x.sample_size, x.estimate()))
            assert sorted(tuple(x) for x in T.run_triest(frame(spark, edges), [40, 500, 10**9], variant, 3).collect()) == want
            with monkeypatch.context() as no:
                if variant not in in_order:
                    no.setattr(T, "_in_order", None)
                got = T.run_triest(frame(spark, edges), [10**9], variant, 3).collect()
            assert [tuple(x) for x in got] == want[-1:]
    with pytest.raises(ValueError):
        T.run_triest(frame(spark, plain), [0])


def test_samples_of_edge_blocks(spark, monkeypatch):
    """Several samples from edges that are made distinct and ordered once, without joins of rows."""
    edges = frame(spark, ring(200, 5) * 2)
    want = []
    for m in (300, 700, 5000):
        few = sorted((tuple(r) for r in T.bottom_sample(G.simple(edges), m).collect()))
        want.append((m, 1000, min(m, 1000), max(1.0, 1000.0 * 999 * 998 / (float(m) * (m - 1) * (m - 2))) * count(few)))
    for name in ("simple", "triangles"):
        monkeypatch.setattr(G, name, None)
    monkeypatch.setattr(T, "simple", None)
    blocks = E.EdgeBlocks(edges)
    assert [tuple(r) for r in T.sampled_estimates(blocks.rows(), blocks.size, [700, 5000, 300]).orderBy("m").collect()] == want
    assert tuple(T.sampled_estimate(edges, 700).first()) == want[1]


def test_reservoir():
    x = T.Reservoir(5, 1)
    for i in range(100):
        x.add(i)
    assert x.seen == 100 and len(set(x.items)) == 5
    hits = np.zeros(20)
    for seed in range(2000):
        y = T.Reservoir(5, seed)
        for i in range(20):
            y.add(i)
        hits[y.items] += 1
    assert abs(hits / 2000 - 0.25).max() < 0.05


def cliques(k, n):
    e = [(c * n + i, c * n + j) for c in range(k) for i, j in combinations(range(n), 2)]
    return e + [(c * n, (c + 1) % k * n) for c in range(k)]


def test_laplacian_and_clusters(spark):
    edges = frame(spark, cliques(4, 8)).select("u", "v")
    adj = L.adjacency(edges)
    m = np.zeros((32, 32))
    for r in adj.collect():
        m[r.i, r.j] = r.w
    d = m.sum(1)
    want = np.eye(32) - m / np.sqrt(d[:, None] * d[None, :])
    got = np.zeros((32, 32))
    for r in L.laplacian(adj).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, want)
    fit = L.SpectralClustering().fit(edges)
    assert fit.estimated_k == 4 and np.allclose([r.eigenvalue for r in fit.eigenvalues.orderBy("idx").collect()], np.linalg.eigvalsh(want)[:11])
    groups = {}
    for r in fit.labels.collect():
        groups.setdefault(r.label, set()).add(r.node // 8)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert fit.reordered().count() == adj.count()
    with pytest.raises(ValueError):
        L.SpectralClustering().fit(edges.where("u = v"))


def test_repeated_edges_weigh_more(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (5, 5), (2, 9)], "u long, v long")
    assert {tuple(r) for r in L.adjacency(e).collect()} == {(0, 1, 3.0), (1, 0, 3.0), (1, 2, 1.0), (2, 1, 1.0)}
    assert {r.w for r in L.adjacency(e, binary=True).collect()} == {1.0}
    assert {tuple(r) for r in L.node_index(e).collect()} == {(1, 0), (2, 1), (9, 2)}


def test_distributed_eigenvalues(spark, monkeypatch):
    lap = L.laplacian(L.adjacency(frame(spark, ring(40, 3) + [(0, 7), (3, 19), (11, 30), (5, 33)]).select("u", "v")))  # all eigenvalues differ
    dense, _ = L.smallest_eigenpairs(lap, 4)
    monkeypatch.setattr(L, "DENSE", 1)
    sparse, vectors = L.smallest_eigenpairs(lap, 4)
    assert np.allclose(sorted(sparse), dense, atol=1e-4) and vectors.shape == (40, 4)


def test_every_copy_of_an_eigenvalue_is_found_at_any_size(spark, monkeypatch):
    """Four equal rings and a path: 0 five times, and the rings' values four times each."""
    edges = [(100 * r + i, 100 * r + (i + 1) % 12) for r in range(4) for i in range(12)] + [(900 + i, 901 + i) for i in range(9)]
    lap = L.laplacian(L.adjacency(spark.createDataFrame(edges, "u long, v long")))
    values, _ = L.smallest_eigenpairs(lap, 11)
    assert (abs(values[:5]) < 1e-9).all() and values[5] > 0.01
    monkeypatch.setattr(L, "DENSE", 1)
    again, vectors = L.smallest_eigenpairs(lap, 11)
    assert np.allclose(values, again, atol=1e-6) and np.allclose(vectors.T @ vectors, np.eye(11), atol=1e-6)
    assert L.eigengap_k(L.spectrum(lap, 11)).first().k == int(np.argmax(np.diff(values))) + 1


def test_triest_of_an_empty_stream(spark):
    got = T.run_triest(spark.createDataFrame([], "seq long, u long, v long"), [5, 9]).collect()
    assert sorted(tuple(r) for r in got) == [(5, "base", 0, 0, 0.0), (9, "base", 0, 0, 0.0)]
