from datetime import date

import duckdb

from oremill.llm import url_filter as U

DAY = "key string, list string, kind string, action string, day date"


def test_matches_sql(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {tuple(r) for r in U.filter_urls(U.demo_captures(pages), U.demo_entries(pages)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = set(con.execute(U.ORACLE).fetchall())
    assert got == want and any(r[4] for r in got)


def test_intervals_and_edges(spark):
    d = lambda m, n: date(2023, m, n)
    entries = [
        ("host:a.b.c", "x", "block", "add", d(2, 1)), ("host:a.b.c", "x", "block", "add", d(2, 1)), ("host:a.b.c", "x", "block", "remove", d(3, 1)),
        ("domain:c", "y", "block", "add", d(5, 1)), ("prefix:a.b.c/p", "ok", "allow", "add", d(6, 1)), ("host:q", "z", "block", "add", d(1, 1)), ("host:q", "z", "block", "remove", d(1, 1)), (None, "x", "block", "add", d(1, 1)),
    ]
    captures = [
        (1, "http://A.b.c:80/p", d(1, 31)), (2, "http://a.b.c./p", d(2, 1)), (3, "http://u@a.b.c?x", d(2, 28)), (4, "http://a.b.c/", d(3, 1)), (5, "http://a.b.c/p/q", d(6, 1)), (6, "http://a.b.c/r", d(6, 1)),
        (7, None, d(6, 1)), (8, "nonsense", d(6, 1)), (9, "http://q/", d(6, 1)), (10, "http://a.b.c/p", None), (11, "", None), (6, "http://a.b.c/r", d(6, 1)),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumn("list", U.F.lit("clash"))
    got = sorted((r.page_id, r.n_active, r.lists, r.blocked) for r in U.filter_urls(c, spark.createDataFrame(entries, DAY)).collect())
    assert got == [(1, 0, "", False), (2, 1, "x", True), (3, 1, "x", True), (4, 0, "", False), (5, 2, "ok,y", False), (6, 1, "y", True), (6, 1, "y", True), (7, 0, "", False), (8, 0, "", False), (9, 0, "", False), (10, 0, "", False), (11, 0, "", False)]
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_on date"), spark.createDataFrame([], DAY)).collect() == []
