"""Edges, degrees and triangles as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edge_blocks import EdgeBlocks
from oremill.functions.saved import saved


def canonical(edges: DataFrame) -> DataFrame:
    """(seq, u, v) with u < v; loops go, repeated edges stay."""
    keep = [c for c in ("seq",) if c in edges.columns]
    return edges.where("u <> v").select(*keep, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def simple(edges: DataFrame) -> DataFrame:
    return canonical(edges).select("u", "v").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of a simple edge table."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once for each triangle of a simple edge table.

    Edges point from the smaller (degree, id) to the larger, which bounds every node's out-degree by
    the root of twice the edge count, so that hubs make no quadratic wedges.
    """
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    rank = lambda deg, x: F.struct(deg.alias("deg"), x.alias("x"))
    arcs = e.select(
        F.when(first, F.col("u")).otherwise(F.col("v")).alias("s"),
        F.when(first, rank(F.col("dv"), F.col("v"))).otherwise(rank(F.col("du"), F.col("u"))).alias("t"),
    )
    x = arcs.select(F.col("s"), F.col("t").alias("t1"))
    y = arcs.select(F.col("s"), F.col("t").alias("t2"))
    wedges = x.join(y, "s").where("t1 < t2").select("s", F.col("t1.x").alias("b"), F.col("t2.x").alias("c"))
    closing = arcs.select(F.col("s").alias("b"), F.col("t.x").alias("c"))
    return wedges.join(closing, ["b", "c"]).select(F.col("s").alias("a"), "b", "c")


def whole(edges: DataFrame) -> bool:
    """Whether the nodes are whole numbers, which edge blocks hold."""
    return all(dict(edges.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in ("u", "v"))


def triangle_count(edges: DataFrame) -> DataFrame:
    """(triangles) of a table of edges in any form, counted between blocks; where nodes are no whole numbers, by joins."""
    if whole(edges):
        return EdgeBlocks(edges).triangle_count()
    return triangles(saved(simple(edges))).agg(F.count("*").alias("triangles"))
