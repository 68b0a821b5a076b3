"""Tables that cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        found = tempfile.mkdtemp(prefix="oremill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/oremill-saved/{uuid.uuid4().hex}"


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written once and read back: a lost executor costs a read, not the loop so far.  by: a folder for each of its values."""
    path = shared_path(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
