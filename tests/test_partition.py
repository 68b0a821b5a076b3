import pytest

from oremill.operators import partition as P

from .test_graphs import ring


def graph(spark, n=60, coloring="ROUND_ROBIN"):
    e = [(u + 1, v + 1) for u, v in ring(n, 3)]
    arcs = spark.createDataFrame([x for u, v in e for x in ((u, v), (v, u))], "u long, v long")
    return P.colored(spark.range(1, n + 1), coloring, 4, n), arcs, e


def test_colors(spark):
    v, _, _ = graph(spark)
    assert {r.id: r.color for r in v.collect()} == {i: i % 4 for i in range(1, 61)}
    v, _, _ = graph(spark, coloring="BATCH")
    assert {r.id: r.color for r in v.collect()} == {i: (i - 1) // 15 for i in range(1, 61)}
    v, _, _ = graph(spark, coloring="RANDOM")
    assert {r.color for r in v.collect()} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="no batch"):
        P.colored(spark.range(1, 5), "BATCH", 2, 3).collect()


def test_cut_and_degrees(spark):
    v, arcs, e = graph(spark)
    assert P.edge_cut(v, arcs).first()[0] == sum(a % 4 != b % 4 for a, b in e)
    assert P.migrations(v).first()[0] == 0
    assert sum(r.degree for r in P.color_degree(v, arcs).collect()) == 2 * len(e) == sum(r.degree for r in P.node_degree(arcs).collect())
    assert {r.n for r in P.color_distribution(v).collect()} == {15}


def test_samples(spark):
    v, arcs, _ = graph(spark)
    near = P.neighbor_sample(arcs, 3).collect()
    assert len(near) == 180 and len(set(near)) == 180
    far = P.uniform_sample(v.select("id"), 6, 60).collect()
    assert len(far) == len(set(far)) and all(r.p != r.q and 1 <= r.q <= 60 for r in far) and len(far) > 300


def test_rounds_cut_fewer_edges_and_keep_the_colors(spark):
    v, arcs, e = graph(spark)
    j = P.Jabeja(v, arcs, P.PartitionConfig(rounds=4)).run()
    rows = j.report.orderBy("round").collect()
    assert [r.round for r in rows] == [0, 1, 2, 3] and rows[-1].swaps > 0 and rows[-1].edge_cut < P.edge_cut(v, arcs).first()[0]
    assert {(r.color, r.n) for r in P.color_distribution(j.vertices).collect()} == {(c, 15) for c in range(4)}
    still = P.Jabeja(v, arcs, P.PartitionConfig(rounds=2, policy="NONE")).run().report.collect()
    assert {(r.edge_cut, r.swaps, r.migrations) for r in still} == {(P.edge_cut(v, arcs).first()[0], 0, 0)}


def test_config_and_cooling():
    t = dict(P.cooling_schedule(2.0, 0.003, 400))
    assert t[0] == 2.0 and t[333] > 1 and t[334] == t[399] == 1.0
    assert P.PartitionConfig().file_name("g") == "g_NS_HYBRID_GICP_ROUND_ROBIN_T_2.0_D_0.003_RNSS_3_URSS_6_A_2.0_R_1000.txt"
    for bad in ({"policy": "x"}, {"coloring": "x"}, {"rounds": 0}):
        with pytest.raises(ValueError):
            P.PartitionConfig(**bad)


def test_samples_are_filled_and_ids_may_have_gaps(spark):
    ids = spark.range(1, 9).toDF("id")
    for size, want in ((3, 3), (6, 6), (20, 7)):
        got = P.uniform_sample(ids, size, 8, "s").groupBy("p").agg(P.F.count_distinct("q").alias("n"), P.F.count("*").alias("m"), P.F.min("q").alias("low"), P.F.max("q").alias("high")).collect()
        assert len(got) == 8 and all(r.n == r.m == want and 1 <= r.low and r.high <= 8 for r in got)
    v = spark.createDataFrame([(10 * i, i % 2, i % 2) for i in range(1, 9)], "id long, color long, init_color long")
    arcs = spark.createDataFrame([(10, 20), (20, 10)], "u long, v long")
    j = P.Jabeja(v, arcs, P.PartitionConfig(rounds=1, partitions=2, policy="RANDOM"))
    far = j.far_pairs(v.select("id")).collect()
    assert len(far) == 8 * 6 and {r.q for r in far} <= {10 * i for i in range(1, 9)} and all(r.p != r.q for r in far)


def test_hybrid_looks_far_only_where_no_neighbour_fits(spark):
    # 1-2 would gain by a swap with each other's side; 5..8 have no neighbour to swap with
    v = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "id long, color long, init_color long")
    pairs = [(1, 4), (2, 3), (1, 2), (5, 7), (6, 8)]
    arcs = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "u long, v long")
    near = P.best_partner(v, arcs, P.neighbor_sample(arcs, 3, "0|n|0"), 2.0, 2.0).collect()
    got = P.Jabeja(v, arcs, P.PartitionConfig(partitions=2)).proposals().collect()
    assert near and {tuple(r) for r in near} <= {tuple(r) for r in got}
    assert len({r.p for r in got}) == len(got)  # one proposal a vertex: no far one beside a near one
