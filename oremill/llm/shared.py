"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.saved import shared_folder
from oremill.functions.ship import ship


class Stage:
    """Written tables of one run: each cuts the lineage, and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/oremill-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this stage that no later step reads."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that Spark hands to Python at once, and their bytes; texts are long, and a batch is held twice on its way.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers of this session are handed at once.  A setting that is smaller already stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(name)
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(name, str(most))


def binary_text(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the UTF-8 bytes of text (null: empty), and `keep`; rows without doc_id are left out.

    Two columns of one name (a clash from an earlier join) raise Spark's own ambiguity error
    only when they are doc_id or text; other columns are not read.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return spread(docs.where(F.col("doc_id").isNotNull())).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *keep)


def input_bytes(docs: DataFrame) -> int | None:
    """Bytes of the tables that a plan reads, as Spark knows them; None where it does not (rows that Python made)."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < 1 << 60 else None


def buckets(docs: DataFrame, each: int = 2 << 20, least: int = 64) -> int:
    """How many hash buckets to deal a table's rows into: one for `each` bytes that it reads; where their number is not
    known, what the session's shuffle partitions take."""
    size = input_bytes(docs)
    if size is None:
        return max(least, TASK_BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(size // each, (1 << 31) - 1))


def spread(docs: DataFrame, each: int = 2 << 20) -> DataFrame:
    """docs, dealt out anew where a table is so small that its files leave cores without a task."""
    cores, size = docs.sparkSession.sparkContext.defaultParallelism, input_bytes(docs)
    return docs.repartition(cores) if size is not None and 1 << 18 < size < cores * each else docs


#: Buckets that a task walks through where there are more than the session's shuffle partitions can take.
TASK_BUCKETS = 16


def meet(df: DataFrame, n_buckets: int = 0, key: str = "bucket") -> DataFrame:
    """Rows dealt by `key` and sorted by it (Spark spills the sort), for `met` to walk bucket by bucket.  Tasks are as many
    as the session's shuffle partitions, or more where these would hold too many of the buckets each."""
    tasks = n_buckets // TASK_BUCKETS
    more = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition(tasks, key) if more else df.repartition(key)).sortWithinPartitions(key)


def met(batches, *names: str):
    """Of a task's rows sorted by their first column: (bucket, a list for each name), one bucket in memory at a time.  Empty
    and null values are left out of the lists."""
    now, out = None, None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cols = [batch.column(n) for n in names]
        edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            if keys[a] != now:
                if out is not None:
                    yield now, out
                now, out = int(keys[a]), [[] for _ in names]
            for got, c in zip(out, cols):
                got += [x for x in c.slice(a, b - a).to_pylist() if x]
    if out is not None:
        yield now, out
