import gzip
import io
import tarfile
import zipfile

import pytest

from oremill.sources import readers as R
from oremill.sources import sinks as K


def test_documents(spark, tmp_path):
    for name in ("x/1", "x/2", "y/3"):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_text(f"text {name}\nline")
    got = {tuple(r) for r in R.text_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {("x\\1", "text x/1\nline"), ("x\\2", "text x/2\nline"), ("y\\3", "text y/3\nline")}
    assert R.text_documents(spark, str(tmp_path / "d"), 2).count() == 2
    assert R.file_text(spark, str(tmp_path / "d/x/1")).first().text == "text x/1\nline"
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name in ("news/a/1", "news/a/2", "news/b/3"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for k in range(3):
            z.writestr(f"f{k}", "x")
        z.writestr("news.tar.gz", buf.getvalue())
    got = R.archive_documents(spark, str(tmp_path / "c.zip"), str(tmp_path / "out"), 2)
    assert {r.doc_id for r in got.collect()} == {"a\\1", "a\\2"}


def test_transactions(spark, tmp_path):
    (tmp_path / "t").write_text("a  b a\n\n# c\n10 2\n \n")
    assert [r["items"] for r in R.transactions(spark, str(tmp_path / "t")).orderBy("tid").collect()] == [["a", "b", "a"], ["#", "c"], ["10", "2"]]
    got = R.transactions(spark, str(tmp_path / "t"), comments=True, distinct=True)
    assert [r["items"] for r in got.orderBy("tid").collect()] == [["a", "b"], ["10", "2"]]
    assert sorted(r.item for r in R.exploded(got).collect()) == ["10", "2", "a", "b"]


def test_edges(spark, tmp_path):
    with gzip.open(tmp_path / "e.gz", "wt") as f:
        f.write("# head\n1 2\n\n3\n4\t4\n5 6 7\n")
    assert [(r.u, r.v) for r in R.edge_stream(spark, str(tmp_path / "e.gz")).orderBy("seq").collect()] == [(1, 2), (5, 6)]
    (tmp_path / "e.csv").write_text("1,2\n\n3\n4,4,1\n5,6,1\n")
    assert {tuple(r) for r in R.edge_csv(spark, str(tmp_path / "e.csv")).collect()} == {(1, 2), (5, 6)}
    (tmp_path / "bad").write_text("a b\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        R.edge_stream(spark, str(tmp_path / "bad")).collect()


def test_metis(spark, tmp_path):
    (tmp_path / "g.graph").write_text("% c\n4 3\n 2 3\n1\n# gone\n1  3\n")
    v, arcs = R.metis_graph(spark, str(tmp_path / "g.graph"))
    assert sorted(r.id for r in v.collect()) == [1, 2, 4]
    assert sorted(tuple(r) for r in arcs.collect()) == [(1, 2), (1, 3), (2, 1), (4, 1), (4, 3)]
    (tmp_path / "p").write_text("0\n3\n1\n")
    assert sorted(tuple(r) for r in R.partition_labels(spark, str(tmp_path / "p")).collect()) == [(1, 0), (2, 3), (3, 1)]


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([(0, 9, 1, 2), (1, 8, 2, 3)], "round long, edge_cut long, swaps long, migrations long")
    K.write_partition_report(report, str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert part.read_text().splitlines() == ["Round\t\tEdge-Cut\t\tSwaps\t\tMigrations", "0\t\t9\t\t1\t\t2", "1\t\t8\t\t2\t\t3"]
    K.write_tsv(report, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    assert set(K.timed({"a": lambda: None})) == {"a"}
