"""k-way graph partitioning by colour swaps (JA-BE-JA), in bulk-synchronous rounds.

vertices: (id, color, init_color); arcs: (u, v), both directions of every edge.  All choices that
were random are ranks of md5 hashes, so a round is a fixed set of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.functions.hashing import hash_order, md5_32
from oremill.functions.ranks import positions
from oremill.functions.saved import saved

POLICIES = ("RANDOM", "HYBRID", "LOCAL", "NONE")
COLORINGS = ("ROUND_ROBIN", "BATCH", "RANDOM")


@dataclass(frozen=True)
class PartitionConfig:
    rounds: int = 1000
    partitions: int = 4
    uniform_sample: int = 6
    temperature: float = 2.0
    delta: float = 0.003
    seed: int = 0
    alpha: float = 2.0
    neighbor_sample: int = 3
    coloring: str = "ROUND_ROBIN"
    policy: str = "HYBRID"

    def __post_init__(self):
        if self.coloring not in COLORINGS or self.policy not in POLICIES:
            raise ValueError(f"coloring is one of {COLORINGS}, policy one of {POLICIES}")
        if min(self.rounds, self.partitions, self.uniform_sample, self.neighbor_sample) < 1:
            raise ValueError("rounds, partitions and sample sizes are 1 at least")

    def file_name(self, graph: str) -> str:
        """Name of a result file: the graph's and every parameter."""
        parts = [("NS", self.policy), ("GICP", self.coloring), ("T", self.temperature), ("D", self.delta), ("RNSS", self.neighbor_sample), ("URSS", self.uniform_sample), ("A", self.alpha), ("R", self.rounds)]
        return "_".join([graph, *(f"{k}_{v}" for k, v in parts)]) + ".txt"


def colored(ids: DataFrame, coloring: str, k: int, n: int, seed: int = 0) -> DataFrame:
    """(id, color, init_color) of ids 1..n (id)."""
    c: Column
    if coloring == "ROUND_ROBIN":
        c = F.pmod("id", F.lit(k))
    elif coloring == "BATCH":  # the first i with id <= (i + 1) * (n / k)
        size = F.lit(n / k)
        fits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("id") <= (i + 1) * size)
        c = F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(F.raise_error(F.lit("no batch holds this id")).cast("int"))
    elif coloring == "RANDOM":
        c = F.pmod(md5_32(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), F.lit(k))
    else:
        raise ValueError(f"coloring is one of {COLORINGS}")
    return ids.select("id", c.cast("long").alias("color")).withColumn("init_color", F.col("color"))


def color_distribution(v: DataFrame) -> DataFrame:
    return v.groupBy("color").agg(F.count("*").alias("n"))


def color_degree(v: DataFrame, arcs: DataFrame) -> DataFrame:
    """(u, color, degree): neighbours of u by colour."""
    return arcs.join(v.select(F.col("id").alias("v"), "color"), "v").groupBy("u", "color").agg(F.count("*").alias("degree"))


def node_degree(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.count("*").alias("degree"))


def edge_cut(v: DataFrame, arcs: DataFrame) -> DataFrame:
    a = v.select(F.col("id").alias("u"), F.col("color").alias("cu"))
    b = v.select(F.col("id").alias("v"), F.col("color").alias("cv"))
    return arcs.join(a, "u").join(b, "v").agg(F.floor(F.count_if(F.col("cu") != F.col("cv")) / 2).cast("long").alias("edge_cut"))


def migrations(v: DataFrame) -> DataFrame:
    return v.agg(F.count_if(F.col("color") != F.col("init_color")).alias("migrations"))


def neighbor_sample(arcs: DataFrame, size: int, salt: object = 0) -> DataFrame:
    """(p, q): all neighbours of p, or `size` of them by hash rank."""
    by = Window.partitionBy("u").orderBy(hash_order("u", "v", salt=salt), "v")
    return arcs.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= size).select(F.col("u").alias("p"), F.col("v").alias("q"))


def uniform_sample(ids: DataFrame, size: int, n: int, salt: object = 0) -> DataFrame:
    """(p, q): `size` distinct ids other than p (all others, where they are fewer), drawn by hash from 1..n: 3 * size draws,
    and where these repeat too often the ids that follow the first draw."""
    draw = lambda j: F.pmod(md5_32(F.concat_ws("|", F.lit(str(salt)), F.col("id").cast("string"), j.cast("string"))), F.lit(n))
    draws = F.transform(F.sequence(F.lit(1), F.lit(3 * size)), lambda j: 1 + draw(j))
    walk = F.transform(F.sequence(F.lit(1), F.lit(2 * size + 1)), lambda j: 1 + F.pmod(draw(F.lit(1)) + j, F.lit(n)))
    picked = F.slice(F.array_distinct(F.filter(F.concat(draws, walk), lambda q: q != F.col("id"))), 1, size)
    return ids.select(F.col("id").alias("p"), F.explode(picked).alias("q"))


def best_partner(v: DataFrame, arcs: DataFrame, pairs: DataFrame, temperature: float, alpha: float = 2.0) -> DataFrame:
    """(p, q, benefit): for each p the candidate q (ties: the smallest) with the highest
    d_p(c_q)^alpha + d_q(c_p)^alpha, where that times T exceeds d_p(c_p)^alpha + d_q(c_q)^alpha."""
    deg = color_degree(v, arcs)
    x = pairs.join(v.select(F.col("id").alias("p"), F.col("color").alias("cp")), "p").join(v.select(F.col("id").alias("q"), F.col("color").alias("cq")), "q").where("cp <> cq")
    for name, node, color in (("dpp", "p", "cp"), ("dqq", "q", "cq"), ("dpq", "p", "cq"), ("dqp", "q", "cp")):
        x = x.join(deg.select(F.col("u").alias(node), F.col("color").alias(color), F.col("degree").alias(name)), [node, color], "left")
    d = {c: F.pow(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.lit(alpha)) for c in ("dpp", "dqq", "dpq", "dqp")}
    x = x.select("p", "q", (d["dpp"] + d["dqq"]).alias("old"), (d["dpq"] + d["dqp"]).alias("benefit")).where(F.col("benefit") * temperature > F.col("old"))
    return x.groupBy("p").agg(F.max_by(F.struct("q", "benefit"), F.struct("benefit", -F.col("q"))).alias("b")).select("p", F.col("b.q").alias("q"), F.col("b.benefit").alias("benefit"))


def matched(proposals: DataFrame) -> DataFrame:
    """(a, b): proposals that are the best one at both of their ends; ties go to the smaller pair."""
    e = proposals.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "benefit").groupBy("a", "b").agg(F.max("benefit").alias("benefit"))
    ends = e.select("a", "b", "benefit", F.explode(F.array("a", "b")).alias("x"))
    top = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("benefit", -F.col("a"), -F.col("b"))).alias("t"))
    won = top.groupBy("t").count().where("count = 2")
    return won.select(F.col("t.a").alias("a"), F.col("t.b").alias("b"))


def swapped(v: DataFrame, pairs: DataFrame) -> DataFrame:
    """v after the two ends of every pair have changed colours."""
    other = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    new = other.join(v.select(F.col("id").alias("other"), F.col("color").alias("new")), "other").select("id", "new")
    return v.join(new, "id", "left").select("id", F.coalesce("new", "color").alias("color"), "init_color")


def cooled(temperature: float, delta: float) -> float:
    """The next round's temperature, in single precision: down by delta, 1 at least."""
    t = np.float32(temperature)
    if t > 1:
        t = np.float32(t - np.float32(delta))
    return float(max(t, np.float32(1)))


def cooling_schedule(temperature: float, delta: float, rounds: int) -> list[tuple[int, float]]:
    out, t = [], temperature
    for r in range(rounds):
        out.append((r, t))
        t = cooled(t, delta)
    return out


class Jabeja:
    """The round loop; `report` has (round, edge_cut, swaps, migrations) after each round."""

    def __init__(self, vertices: DataFrame, arcs: DataFrame, config: PartitionConfig | None = None):
        self.config, self.arcs = config or PartitionConfig(), arcs
        self.vertices = vertices
        low, high, self.n = vertices.agg(F.min("id"), F.max("id"), F.count("*")).first()
        # ids with gaps are drawn by their place in order
        self.places = None if not self.n or (low, high) == (1, self.n) else saved(positions(vertices.select("id"), "id").select("id", (F.col("pos") + 1).alias("place")))
        self.temperature, self.swaps, self.round, self.rows = self.config.temperature, 0, 0, []

    def far_pairs(self, ids: DataFrame) -> DataFrame:
        """A uniform sample for each of ids."""
        salt = f"{self.config.seed}|u|{self.round}"
        if self.places is None:
            return uniform_sample(ids, self.config.uniform_sample, self.n, salt)
        drawn = uniform_sample(ids.join(self.places, "id").select(F.col("place").alias("id")), self.config.uniform_sample, self.n, salt)
        own, other = (self.places.select(F.col("id").alias(x), F.col("place").alias(y)) for x, y in (("own", "p"), ("other", "q")))
        return drawn.join(own, "p").join(other, "q").select(F.col("own").alias("p"), F.col("other").alias("q"))

    def proposals(self) -> DataFrame:
        """(p, q, benefit): each vertex's best partner by the policy.  HYBRID looks among neighbours first, and for those that
        find none there, in a uniform sample."""
        c, ids = self.config, self.vertices.select("id")
        best = lambda pairs: best_partner(self.vertices, self.arcs, pairs.distinct(), self.temperature, c.alpha)
        if c.policy == "RANDOM":
            return best(self.far_pairs(ids))
        near = best(neighbor_sample(self.arcs, c.neighbor_sample, f"{c.seed}|n|{self.round}"))
        if c.policy == "LOCAL":
            return near
        near = saved(near)
        return near.unionByName(best(self.far_pairs(ids.join(near.select(F.col("p").alias("id")), "id", "left_anti"))))

    def step(self) -> None:
        c = self.config
        if c.policy != "NONE":
            chosen = saved(matched(self.proposals()))
            self.swaps += chosen.count()
            self.vertices = saved(swapped(self.vertices, chosen))
        self.temperature = cooled(self.temperature, c.delta)
        self.rows.append((self.round, edge_cut(self.vertices, self.arcs).first()[0], self.swaps, migrations(self.vertices).first()[0]))
        self.round += 1

    def run(self) -> Jabeja:
        for _ in range(self.config.rounds):
            self.step()
        return self

    @property
    def report(self) -> DataFrame:
        return self.arcs.sparkSession.createDataFrame(self.rows, "round long, edge_cut long, swaps long, migrations long")
