from oremill.streaming import edges as E

from .test_graphs import count, ring


def test_triest_over_a_file_stream(spark, tmp_path):
    edges = ring(60, 4)
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.txt").write_text("# part\n" + "".join(f"{u} {v}\n" for u, v in edges[k::4]))
    for variant in ("base", "impr"):
        out = E.triest_stream(E.read_edges(spark, str(tmp_path / "in")), [50, 1000], variant)
        q = out.writeStream.format("memory").queryName(f"triest_{variant}").outputMode("update").option("checkpointLocation", str(tmp_path / variant)).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        rows = spark.table(f"triest_{variant}").collect()
        last = {r.m: r for r in sorted(rows, key=lambda r: r.t)}
        assert len(rows) == 8 and last[1000].t == len(edges) and last[50].sample_size == 50 and last[1000].estimate == count(edges)


def test_reservoir_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"item{k}-{i}\n" for i in range(50)))
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "item")
    q = E.reservoir_stream(rows, 10, 1).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    last = [r for r in spark.table("kept").collect() if r.seen == 100]
    assert len({r.item for r in last}) == 10 == len(last)
