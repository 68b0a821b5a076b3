import pyarrow as pa

from oremill.llm import shared as S


def test_bucket_counts_follow_the_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = S.input_bytes(docs)
    assert S.input_bytes(docs.join(docs.select("doc_id"), "doc_id")) == 2 * size
    assert S.buckets(docs, each=size // 500) in (500, 501) and S.buckets(docs) == 64
    made = spark.createDataFrame([(1, "a")], "doc_id long, text string").repartition(2)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.input_bytes(made) is None and S.buckets(made) == max(64, 16 * partitions)
    assert S.meet(made.select(S.F.col("doc_id").alias("bucket")), S.buckets(made)).rdd.getNumPartitions() <= max(4, partitions)


def test_one_bucket_at_a_time():
    batches = [pa.table({"bucket": [1, 1, 2], "x": [b"a", None, b""], "y": [b"p", b"q", b"r"]}), pa.table({"bucket": [2, 5], "x": [b"c", b"d"], "y": [None, None]}), pa.table({"bucket": pa.array([], pa.int64()), "x": pa.array([], pa.binary()), "y": pa.array([], pa.binary())})]
    got = [(b, x, y) for b, (x, y) in S.met([t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema) for t in batches], "x", "y")]
    assert got == [(1, [b"a"], [b"p", b"q"]), (2, [b"c"], [b"r"]), (5, [b"d"], [])]
    assert list(S.met([], "x")) == []
