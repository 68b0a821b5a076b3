"""What Spark hands to Python workers at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch; blobs are large, and a batch is held twice on its way.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that Python workers of this session are handed at once.  A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name)
    if not (have.isdigit() and 0 < int(have) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))
