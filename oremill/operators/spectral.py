"""Spectral clustering of a graph: adjacency, normalised Laplacian, eigenvectors, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.ranks import positions
from oremill.functions.saved import saved
from oremill.functions.ship import ship

#: Nodes up to which the Laplacian is solved densely on the driver.
DENSE = 4096


def node_index(edges: DataFrame) -> DataFrame:
    """(node, idx) of the end points of edges that are no loops, in order, from 0."""
    nodes = edges.where("u <> v").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return positions(nodes, "node", name="idx")


def adjacency(edges: DataFrame, binary: bool = False) -> DataFrame:
    """(i, j, w) in both directions; each listed edge adds 1 to both, so repeats weigh more, unless binary."""
    pairs = saved(edges.where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n")))
    idx = node_index(pairs)
    e = pairs.join(idx.select(F.col("node").alias("u"), F.col("idx").alias("i")), "u").join(idx.select(F.col("node").alias("v"), F.col("idx").alias("j")), "v").select("i", "j", "n")
    both = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    return both.groupBy("i", "j").agg((F.lit(1.0) if binary else F.sum("n").cast("double")).alias("w"))


def degree_vector(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("i").alias("idx")).agg(F.sum("w").alias("degree")).withColumn("degree", F.when(F.col("degree") == 0, 1.0).otherwise(F.col("degree")))


def laplacian(adj: DataFrame) -> DataFrame:
    """(i, j, value) of I - D^-1/2 A D^-1/2, zeros left out."""
    d = degree_vector(adj)
    a = adj.join(d.select(F.col("idx").alias("i"), F.col("degree").alias("di")), "i").join(d.select(F.col("idx").alias("j"), F.col("degree").alias("dj")), "j")
    parts = a.select("i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("value")).unionByName(d.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("value")))
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def multiplier(lap: DataFrame, n: int):
    """x -> L x for blocks of vectors: the rows of L stay dealt by i, x is broadcast."""
    spark = lap.sparkSession
    ship(spark)
    rows = saved(lap.select("i", "j", "value").repartition("i"))

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches):
            for batch in batches:
                i, j, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                own, at = np.unique(i, return_inverse=True)
                part = np.zeros((len(own), shared.value.shape[1]))
                np.add.at(part, at, v[:, None] * shared.value[j])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([p.tobytes() for p in part], pa.binary())], ["i", "part"])

        out = np.zeros_like(x)
        for r in rows.mapInArrow(run, "i long, part binary").toLocalIterator():
            out[r.i] += np.frombuffer(r.part)
        shared.destroy()
        return out

    return product


def lowest_pairs(product, n: int, k: int, depth: int = 6, rounds: int = 40, tolerance: float = 1e-7, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs of a symmetric operator, by restarted block Krylov spaces: a block of more than k
    vectors finds every copy of a multiple eigenvalue.  Holds n * (k + 4) * depth numbers."""
    width = min(n, k + 4)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(rounds):
        basis, images = [x], [product(x)]
        while len(basis) < depth and width * (len(basis) + 1) <= n:
            y = images[-1].copy()
            for _ in range(2):
                for b in basis:
                    y -= b @ (b.T @ y)
            q, r = np.linalg.qr(y)
            q = q[:, np.abs(np.diag(r)) > 1e-10]  # directions that the space holds already
            if not q.shape[1]:
                break
            basis.append(q)
            images.append(product(q))
        space, image = np.concatenate(basis, 1), np.concatenate(images, 1)
        values, ritz = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        x = space @ ritz[:, :width]
        gap = np.linalg.norm(image @ ritz[:, :k] - x[:, :k] * values[:k], axis=0)
        if gap.max() < tolerance or space.shape[1] == n:
            return values[:k], x[:, :k]
        x = np.linalg.qr(x)[0]
    raise RuntimeError(f"eigenpairs are not settled after {rounds} rounds: the residual is {gap.max():.1e}")


def smallest_eigenpairs(lap: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenvalues, ascending and each as often as it is one, and their vectors as columns.

    Up to DENSE nodes by a dense solver on the driver; beyond that by `lowest_pairs`, with products where the
    rows of L are.  The vectors (n times k + 4, six times) are the driver's.
    """
    n = int(lap.agg(F.max("i")).first()[0] or 0) + 1
    k = min(k, n)
    if n > DENSE:
        return lowest_pairs(multiplier(lap, n), n, k)
    m = np.zeros((n, n))
    rows = lap.select("i", "j", "value").toPandas()  # n <= DENSE, checked above
    m[rows["i"], rows["j"]] = rows["value"]
    values, vectors = np.linalg.eigh(m)
    return values[:k], vectors[:, :k]


def spectrum(lap: DataFrame, k: int) -> DataFrame:
    values, _ = smallest_eigenpairs(lap, k)
    return lap.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, eigenvalue double")


def eigengap_k(spec: DataFrame, max_k: int = 10) -> DataFrame:
    """(k): where the widest gap among the first max_k + 1 eigenvalues lies; the first of equals."""
    by = Window.orderBy("idx")
    gaps = spec.where(F.col("idx") <= max_k).withColumn("gap", F.lead("eigenvalue").over(by) - F.col("eigenvalue")).where("gap is not null")
    return gaps.agg(F.max_by(F.col("idx") + 1, F.struct("gap", -F.col("idx"))).alias("k"))


def reordered(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, col, w): the adjacency with nodes lined up by label, then index."""
    pos = positions(labels.select("idx", "label"), "label", "idx").select("idx", "pos")
    return adj.join(pos.select(F.col("idx").alias("i"), F.col("pos").alias("row")), "i").join(pos.select(F.col("idx").alias("j"), F.col("pos").alias("col")), "j").select("row", "col", "w")


class SpectralClustering:
    """labels of nodes (idx, node, label); k from the eigengap unless given."""

    def __init__(self, k: int | None = None, max_k: int = 10, restarts: int = 10, seed: int = 1, binary: bool = False):
        self.k, self.max_k, self.restarts, self.seed, self.binary = k, max_k, restarts, seed, binary

    def fit(self, edges: DataFrame) -> SpectralClustering:
        if edges.where("u <> v").isEmpty():
            raise ValueError("the graph has no edges")
        spark = edges.sparkSession
        self.index, self.adjacency = node_index(edges), adjacency(edges, self.binary)
        lap = laplacian(self.adjacency)
        values, vectors = smallest_eigenpairs(lap, max(self.max_k + 1, self.k or 0))
        self.eigenvalues = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, eigenvalue double")
        self.estimated_k = int(eigengap_k(self.eigenvalues, self.max_k).first().k)
        k = self.k or self.estimated_k
        rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(vectors[:, :k].tolist())], ["idx", "raw"])
        unit = Normalizer(p=2.0, inputCol="raw", outputCol="features").transform(rows).cache()
        if k == 1:
            self.labels = self.index.withColumn("label", F.lit(0))
            return self
        best = min((KMeans(k=k, seed=self.seed + s).fit(unit) for s in range(self.restarts)), key=lambda m: m.summary.trainingCost)
        self.labels = best.transform(unit).select("idx", F.col("prediction").alias("label")).join(self.index, "idx").select("idx", "node", "label")
        return self

    def reordered(self) -> DataFrame:
        return reordered(self.adjacency, self.labels)
