"""Positions in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved


def positions(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with the 0-based position of each row in `order` (which must be total, for a fixed result).

    Rows are range-partitioned and numbered inside; a table with a row for each partition gives
    the offsets.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    local = saved(local)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, "_part").withColumn(name, (F.col("_off") + F.col("_at")).cast("long")).drop("_part", "_at", "_off")
