import pytest

from oremill.__main__ import arguments, main, result


def test_programs(spark, tmp_path, capsys):
    main(["similarity"])
    assert "doc6 ~ doc7" in capsys.readouterr().out.splitlines()
    main(["itemsets", "--min-support", "2", "--confidence", "1.0"])
    out = capsys.readouterr().out
    assert "{B, C, E}: 2" in out and "{B} -> {E} support: 3, confidence: 1.0000" in out
    (tmp_path / "e").write_text("1 2\n2 3\n1 3\n3 4\n")
    main(["triangles", str(tmp_path / "e"), "-m", "10", "20", "--truth", "2"])
    assert capsys.readouterr().out.splitlines()[1].split("\t") == ["10", "base", "4", "4", "1.0", "0.5"]
    (tmp_path / "c").write_text("".join(f"{a},{b}\n" for s in (0, 10) for a in range(s, s + 4) for b in range(a + 1, s + 4)))
    labels = result(spark, arguments().parse_args(["spectral", str(tmp_path / "c"), "-k", "2"])).collect()
    assert len({r.label for r in labels}) == 2 and len({(r.node // 10, r.label) for r in labels}) == 2
    (tmp_path / "g").write_text("4 4\n2 4\n1 3\n2 4\n1 3\n")
    report = result(spark, arguments().parse_args(["partition", str(tmp_path / "g"), "--rounds", "2", "--partitions", "2", "--output", str(tmp_path / "out")])).collect()
    assert [r.round for r in report] == [0, 1] and list((tmp_path / "out").glob("g_NS_HYBRID*/part-*"))
    with pytest.raises(SystemExit):
        main(["nothing"])
