"""Connected components of edge tables, by alternating large and small stars.

Each round replaces edges so that nodes hang on smaller neighbours; it ends when every node
hangs on the smallest node of its component.  Rounds work on edges alone (an aggregation
with map-side minima and a join that AQE can split), and are written to the shared folder.
Operators send spanning forests (`forest`) rather than all edges they find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stage

EDGE_SCHEMA = "g int, a long, b long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return nodes, nodes[root]


def forest(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (g, node, root) that join what the given edges join."""
    out = [[], [], []]
    for k in np.unique(g):
        mine = g == k
        nodes, root = local_roots(a[mine], b[mine])
        keep = nodes != root
        for col, v in zip(out, (np.full(int(keep.sum()), k, np.int32), nodes[keep], root[keep])):
            col.append(v)
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int32, np.int64, np.int64)))


def edge_batch(g, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(g, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["g", "a", "b"])


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(g, a, b): b is the smallest node of a's component in graph g, for every a but that node itself.

    edges: (g int, a long, b long); loops and repeated edges are allowed.
    """
    e = stage.write(edges.select("g", "a", "b").where("a <> b"))
    while True:
        both = e.select("g", "a", "b").unionByName(e.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("g", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, ["g", "a"]).where("b > a").select("g", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select("g", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("g", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["g", "a"]).select("g", F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        new = stage.write(small.select("g", "x.a", "x.b").where("a <> b").distinct())
        stage.drop(e)
        e = new
        if e.join(e.select("g", F.col("b").alias("a")).distinct(), ["g", "a"], "left_semi").isEmpty() and e.groupBy("g", "a").count().where("count > 1").isEmpty():
            return e
