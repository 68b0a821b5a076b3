"""Fixed-memory triangle estimates over an edge stream: reservoirs and TRIEST.

The sampled-graph estimate also has a set-based form: a hash-ordered bottom-M sample has the
distribution of a reservoir, merges across partitions and gives the same answer in every
run.  `Triest` is the sequential form for streams, one state for each (M, variant, seed).
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edge_blocks import EdgeBlocks
from .graph import simple, triangle_count, whole
from oremill.functions.hashing import hash_order
from oremill.functions.saved import saved
from oremill.functions.ship import ship


class Reservoir:
    """A uniform sample of `m` items of a stream, by replacement of a random slot."""

    def __init__(self, m: int, seed: int = 0):
        if m < 1:
            raise ValueError("a reservoir holds an item at least")
        self.m, self.items, self.seen, self.draw = m, [], 0, random.Random(seed)

    def add(self, item) -> None:
        self.seen += 1
        if len(self.items) < self.m:
            self.items.append(item)
        elif (k := self.draw.randrange(self.seen)) < self.m:
            self.items[k] = item


def xi(t: int, m: int) -> float:
    """Inverse probability that three given edges of t are all in a sample of m."""
    return 1.0 if t < 3 or m < 3 else max(1.0, t * (t - 1) * (t - 2) / (m * (m - 1) * (m - 2)))


def eta(t: int, m: int) -> float:
    return 1.0 if t <= 2 or m < 2 else max(1.0, (t - 1) * (t - 2) / (m * (m - 1)))


class Triest:
    """TRIEST over edge insertions.

    variant "base" counts triangles of the sample and scales at the end; "impr" adds a weighted count
    at every arrival and never takes back.  strict_capacity=False holds one edge more than m before it
    replaces any.  A repeated edge that is in the sample changes t, and in "impr" the count.
    """

    def __init__(self, m: int, variant: str = "base", seed: int = 0, strict_capacity: bool = True):
        if m < 1 or variant not in ("base", "impr"):
            raise ValueError("m is 1 at least, variant base or impr")
        self.m, self.variant, self.room = m, variant, m + (not strict_capacity)
        self.draw = random.Random(seed)
        self.t, self.count = 0, 0.0
        self.edges: list[tuple] = []
        self.place: dict[tuple, int] = {}
        self.near: dict = {}

    @property
    def sample_size(self) -> int:
        return len(self.edges)

    def _common(self, u, v) -> int:
        return len(self.near.get(u, frozenset()) & self.near.get(v, frozenset()))

    def _insert(self, e) -> None:
        u, v = e
        self.place[e] = len(self.edges)
        self.edges.append(e)
        self.near.setdefault(u, set()).add(v)
        self.near.setdefault(v, set()).add(u)

    def _remove(self, k: int):
        e, last = self.edges[k], self.edges.pop()
        if last != e:
            self.edges[k], self.place[last] = last, k
        del self.place[e]
        for a, b in (e, e[::-1]):
            self.near[a].discard(b)
            if not self.near[a]:
                del self.near[a]
        return e

    def add(self, u, v) -> None:
        if u == v:
            return
        e = (u, v) if u < v else (v, u)
        self.t += 1
        if self.variant == "impr":
            self.count += eta(self.t, self.m) * self._common(*e)
        if e in self.place:
            return
        if len(self.edges) >= self.room:
            if self.draw.random() >= self.m / self.t:
                return
            gone = self._remove(self.draw.randrange(len(self.edges)))
            if self.variant == "base":
                self.count -= self._common(*gone)
        self._insert(e)
        if self.variant == "base":
            self.count += self._common(*e)

    def extend(self, edges: Iterable[tuple]) -> Triest:
        for u, v in edges:
            self.add(u, v)
        return self

    def estimate(self) -> float:
        if self.variant == "impr" or self.t <= self.m:
            return float(self.count)
        return xi(self.t, self.m) * self.count


REPORT = "m long, variant string, t long, sample_size long, estimate double"


def run_triest(edges: DataFrame, ms: list[int], variant: str = "base", seed: int = 0, strict_capacity: bool = True) -> DataFrame:
    """One row of REPORT for each m: the stream (seq, u, v) goes through each estimator in the order of seq.

    The estimator is sequential by definition; the runs for several m go side by side, each in a task that holds
    its sample and one batch of edges.  While a sample has room, though, nothing is drawn: it holds all distinct edges
    so far, and without repeated edges both variants' counts are its triangles, in any order of arrival.  Those m that the
    stream cannot fill are counted so, over all tasks (`EdgeBlocks`); "impr" with repeated edges is not.
    """
    ship(edges.sparkSession)
    ms = sorted(set(ms))
    if any(m < 1 for m in ms) or variant not in ("base", "impr"):
        raise ValueError("m is 1 at least, variant base or impr")
    stream = edges.where("seq is not null")
    t = stream.where("u <> v").count() if whole(edges) else None
    filling = [m for m in ms if t is not None and t <= m]
    if filling:
        blocks = EdgeBlocks(stream)
        if variant == "base" or blocks.size == t:
            n = blocks.triangle_count().first().triangles
            rows = edges.sparkSession.createDataFrame([(m, variant, t, blocks.size, float(n)) for m in filling], REPORT)
            ms = ms[: -len(filling)]
            return rows.unionByName(_in_order(edges, ms, variant, seed, strict_capacity)) if ms else rows
    return _in_order(edges, ms, variant, seed, strict_capacity)


def _in_order(edges: DataFrame, ms: list[int], variant: str, seed: int, strict_capacity: bool) -> DataFrame:
    """The same, edge by edge."""
    sent = edges.where("seq is not null").select("seq", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.explode(F.array(*(F.lit(m).cast("long") for m in ms))).alias("m"))

    def run(batches):
        now, x = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"m": now, "variant": variant, "t": x.t, "sample_size": x.sample_size, "estimate": x.estimate()}])
        for batch in batches:
            m, u, v = (batch.column(k).to_pylist() for k in ("m", "u", "v"))
            for key, a, b in zip(m, u, v):
                if key != now:
                    if x is not None:
                        yield row()
                    now, x = key, Triest(int(key), variant, seed, strict_capacity)
                x.add(a, b)
        if x is not None:
            yield row()

    none = edges.sparkSession.createDataFrame([(m, variant, 0, 0, 0.0) for m in ms], REPORT)  # for a stream without edges
    every = sent.repartition("m").sortWithinPartitions("m", "seq").mapInArrow(run, REPORT).unionByName(none)
    return every.groupBy("m").agg(F.max_by(F.struct("variant", "t", "sample_size", "estimate"), "t").alias("x")).select("m", "x.*")


def bottom_sample(edges: DataFrame, m: int, salt: object = 0) -> DataFrame:
    """m rows of a simple edge table, uniform over salts: those with the smallest hashes."""
    return edges.withColumn("h", hash_order("u", "v", salt=salt)).orderBy("h", "u", "v").limit(m).drop("h")


def sampled_estimates(edges: DataFrame, t: int, ms: list[int], salt: object = 0) -> DataFrame:
    """(m, t, sample_size, estimate) of the set-based form for each m, of a simple table of t edges.  The edges are
    ordered once: a smaller sample is the first part of a larger one."""
    rows, sample, x = [], edges, float(t)
    for m in sorted(set(ms), reverse=True):
        sample = saved(bottom_sample(sample, m, salt))
        scale = 1.0 if t < 3 or m < 3 or t <= m else max(1.0, x * (x - 1) * (x - 2) / (float(m) * (m - 1) * (m - 2)))
        rows.append((m, t, min(m, t), scale * triangle_count(sample).first().triangles))
    return edges.sparkSession.createDataFrame(rows[::-1], "m long, t long, sample_size long, estimate double")


def sampled_estimate(edges: DataFrame, m: int, salt: object = 0) -> DataFrame:
    """(m, t, sample_size, estimate) of the set-based form."""
    if whole(edges):
        blocks = EdgeBlocks(edges)
        return sampled_estimates(blocks.rows(), blocks.size, [m], salt)
    e = saved(simple(edges))
    return sampled_estimates(e, e.count(), [m], salt)


def relative_error(report: DataFrame, truth: DataFrame) -> DataFrame:
    """report with rel_error against truth (triangles)."""
    return report.join(truth).withColumn("rel_error", F.abs(F.col("estimate") - F.col("triangles")) / F.col("triangles")).drop("triangles")
