"""Reports of the mining operators, as DataFrames and files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.ranks import positions


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(k, rank, line): within each size by falling support, then the itemset."""
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("support"), "itemset"))
    return itemsets.select("k", rank.alias("rank"), F.format_string("{%s}: %d", F.array_join("itemset", ", "), "support").alias("line"))


def rule_lines(rules: DataFrame, fractional: bool = False) -> DataFrame:
    """(rank, line) in the order of confidence, support, sides."""
    rules = positions(rules, F.desc("confidence"), F.desc("support"), F.col("lhs"), F.col("rhs"))
    l, r = F.array_join(F.array_sort("lhs"), ", "), F.array_join(F.array_sort("rhs"), ", ")
    line = F.format_string("{%s} -> {%s} support: %.3f, conf: %.3f", l, r, "support", "confidence") if fractional else F.format_string("{%s} -> {%s} support: %d, confidence: %.4f", l, r, "support", "confidence")
    return rules.select((F.col("pos") + 1).alias("rank"), line.alias("line"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_partition_report(report: DataFrame, path: str) -> None:
    """One file of rounds: round, edge cut, swaps, migrations between two tabs."""
    line = F.concat_ws("\t\t", *(F.col(c).cast("string") for c in ("round", "edge_cut", "swaps", "migrations")))
    head = report.sparkSession.createDataFrame([(-1, "Round\t\tEdge-Cut\t\tSwaps\t\tMigrations")], "round long, value string")
    report.select("round", line.alias("value")).unionByName(head).coalesce(1).sortWithinPartitions("round").select("value").write.mode("overwrite").text(path)


def timed(steps: dict[str, Callable[[], object]]) -> dict[str, float]:
    """Seconds of each step, run in order."""
    out = {}
    for name, f in steps.items():
        start = time.perf_counter()
        f()
        out[name] = time.perf_counter() - start
    return out
