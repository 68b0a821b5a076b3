"""Embedding near-deduplication: spherical k-means cells and blocked cosine products.

Equal vectors are first folded into one that carries their number.  Cells come from spherical
k-means on a sample (at most SAMPLE vectors); every vector is a member of its nearest cell and
a visitor of those of its PROBES nearest cells that could hold a partner: two unit vectors with cosine t
are r = sqrt(2 - 2 t) apart, so a partner in cell c needs <x, own - c> <= r |own - c|.  A pair is found when either
vector visits the other's cell, and counts for both.  Work so grows with the rows, at a recall that
the README gives; tables of up to PROBES cells (some 12,000 vectors) are compared in full, and so is any table with
probes=None, where the bound alone decides (on vectors without cluster structure it excludes few cells, and the
work nears all pairs in blocks).

A cell's members and visitors are dealt into blocks of bounded size by their counts, and a task holds one block
at a time; a block hands on counts and a spanning forest of its links, never pairs.  Cosines near the
threshold are taken in double precision.

Vectors that are null, zero, or hold null or non-finite parts link with nothing.  Vectors of
different lengths never link.  Rows with a null vec_id are left out; repeated rows count once
and give repeated, equal results; rows that share a vec_id with unequal vectors get the larger of their
counts.  Of equally near cells a vector's own is the first.  Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.functions.ship import ship

from .components import components, forest
from .shared import Stage, meet, small_batches

#: Vectors that the cells are fitted on at most, and vectors for each cell.
SAMPLE, PER_CELL, MOST_CELLS = 20_000, 2000, 4096
#: Members and visitors of one block.
MEMBERS, VISITORS = 4096, 8192
ROWS = 512
#: Nearest cells that a vector is compared in.
PROBES = 6


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(u: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centres of unit rows u."""
    rng = np.random.default_rng(seed)
    c = u[rng.permutation(len(u))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([(u[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(u), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, u)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def centres_for(c: np.ndarray, dim: int) -> np.ndarray:
    """Centres for vectors of another length; any will do."""
    out = np.zeros((len(c), dim))
    out[:, : min(dim, c.shape[1])] = c[:, :dim]
    return out


def vectors(batch):
    """(dim, row numbers, matrix) for each length of vector in a batch."""
    col = batch.column("embedding")
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        row = np.flatnonzero(size == dim)
        yield int(dim), row, flat[start[row][:, None] + np.arange(dim)]


class Cells:
    """Centres for vectors of each length, and what the bound needs."""

    def __init__(self, centres: np.ndarray, r: float, probes: int | None):
        self.centres, self.r, self.probes, self.made = centres, r, probes, {}

    def visits(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and a mask of the cells that it is compared in."""
        dim = u.shape[1]
        if dim not in self.made:
            c = centres_for(self.centres, dim)
            square = (c * c).sum(1)
            self.made[dim] = c, np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0)) + 1e-7
        c, apart = self.made[dim]
        own, mask = np.empty(len(u), np.int64), np.empty((len(u), len(c)), bool)
        for a in range(0, len(u), 1024):
            s = u[a : a + 1024] @ c.T
            row = np.arange(len(s))
            mine = s.argmax(1)
            m = s[row, mine][:, None] - s <= self.r * apart[mine] + 1e-9
            if self.probes and self.probes < len(c):
                near = np.zeros_like(m)
                near[row[:, None], np.argpartition(-s, self.probes - 1, axis=1)[:, : self.probes]] = True
                m &= near
            m[row, mine] = True
            own[a : a + 1024], mask[a : a + 1024] = mine, m
        return own, mask


def count_cells(shared):
    def run(batches):
        cells, held = shared.value, {}
        for batch in batches:
            for dim, _, x in vectors(batch):
                own, mask = cells.visits(unit_rows(x))
                m, v = held.setdefault(dim, np.zeros((2, mask.shape[1]), np.int64))
                m += np.bincount(own, minlength=len(m))
                v += mask.sum(0)
        rows = [(d, k, int(m[k]), int(v[k])) for d, (m, v) in held.items() for k in np.flatnonzero(v)]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["dim", "cell", "members", "visitors"])

    return run


BLOCK_SCHEMA = "key long, role int, cell int, dim int, ids binary, weight binary, cells binary, x binary"


def spread(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number below n for each id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)


def visited(mask: np.ndarray) -> np.ndarray:
    """The cells of each row of a mask, filled up by -1."""
    n = mask.sum(1)
    row, cell = np.nonzero(mask)
    out = np.full((len(mask), int(n.max(initial=1))), -1, np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = cell
    return out


def send_blocks(shared, plan, kind: str):
    """Members (with the cells they visit) and visitors (with their own) to the blocks of their cells."""

    def run(batches):
        cells, blocks = shared.value, plan.value
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            out = []
            for dim, row, x in vectors(batch):
                own, mask = cells.visits(unit_rows(x))
                m_blocks, v_blocks, base = blocks[dim]
                where = visited(mask)
                i, k = np.nonzero(mask)
                keep = m_blocks[k] > 0  # a cell without members has no pairs
                for role, i, k in ((0, np.arange(len(x)), own), (1, i[keep], k[keep])):
                    mine, others = (m_blocks, v_blocks) if role == 0 else (v_blocks, m_blocks)
                    at, n = spread(ids[row[i]], mine[k]), others[k]
                    o = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    i, k, at = np.repeat(i, n), np.repeat(k, n), np.repeat(at, n)
                    key = base[k] + (at * v_blocks[k] + o if role == 0 else o * v_blocks[k] + at)
                    order = np.argsort(key, kind="stable")
                    i, k, key = i[order], k[order], key[order]
                    edge = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)] if len(key) else []
                    for a, b in zip(edge[:-1], edge[1:]):
                        z = i[a:b]
                        seen = where[z] if role == 0 else own[z].astype(np.int32)
                        out.append((int(key[a]), role, int(k[a]), dim, ids[row[z]].astype("<i8").tobytes(), weight[row[z]].astype("<i8").tobytes(), seen.tobytes(), x[z].astype(kind).tobytes()))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], ["key", "role", "cell", "dim", "ids", "weight", "cells", "x"])

    return run


def by_key(batches):
    """(members' rows, visitors' rows) of one block after the other, of rows sorted by key."""
    now, sides = None, ([], [])
    for batch in batches:
        for key, role, *body in zip(*(batch.column(k).to_pylist() for k in ("key", "role", "cell", "dim", "ids", "weight", "cells", "x"))):
            if key != now:
                if sides[0] and sides[1]:
                    yield sides
                now, sides = key, ([], [])
            sides[role].append(body)
    if sides[0] and sides[1]:
        yield sides


FOUND_SCHEMA = "vec_id long, links long, a long, b long"


def compare_blocks(cosine: float, kind: str, mutual: bool):
    """mutual: whether both vectors of a pair visit each other's cell always, so that each counts its own links."""

    def run(batches):
        for sides in by_key(batches):
            cell, dim = sides[0][0][:2]
            (m_ids, m_weight, m), (ids, weight, v) = (
                (np.frombuffer(b"".join(s[2] for s in side), "<i8"), np.frombuffer(b"".join(s[3] for s in side), "<i8"), unit_rows(np.frombuffer(b"".join(s[5] for s in side), kind).reshape(-1, dim).astype(np.float64)))
                for side in sides
            )
            own = np.frombuffer(b"".join(s[4] for s in sides[1]), "<i4")
            rows = [np.frombuffer(s[4], "<i4").reshape(len(s[2]) // 8, -1) for s in sides[0]]
            wide = max(x.shape[1] for x in rows)
            where = np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=-1) for x in rows])
            m32, v32 = m.astype(np.float32), v.astype(np.float32)
            total, back = np.zeros(len(ids), np.int64), np.zeros(len(m_ids), np.int64)
            edges = [(np.zeros(0, np.int64),) * 2]
            for a in range(0, len(ids), ROWS):
                s = v32[a : a + ROWS] @ m32.T
                i, j = np.nonzero(s >= cosine - 1e-4)
                for p in range(0, len(i), 1 << 18):
                    x, y = i[p : p + (1 << 18)], j[p : p + (1 << 18)]
                    unsure = np.flatnonzero(s[x, y] < cosine + 1e-4)
                    ok = np.ones(len(x), bool)
                    ok[unsure] = np.einsum("ij,ij->i", v[a + x[unsure]], m[y[unsure]]) >= cosine
                    x, y = a + x[ok], y[ok]
                    total += np.bincount(x, weights=m_weight[y], minlength=len(ids)).astype(np.int64)
                    if not mutual:  # a member that does not come to the visitor's cell counts the pair here
                        alone = np.flatnonzero(own[x] != cell)
                        alone = alone[~(where[y[alone]] == own[x[alone]][:, None]).any(1)]
                        back += np.bincount(y[alone], weights=weight[x[alone]], minlength=len(m_ids)).astype(np.int64)
                    _, e1, e2 = forest(np.zeros(len(x), np.int32), ids[x], m_ids[y])
                    edges.append((e1, e2))
            _, e1, e2 = forest(np.zeros(sum(len(e[0]) for e in edges), np.int32), np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            who, links = np.concatenate([ids[total > 0], m_ids[back > 0]]), np.concatenate([total[total > 0], back[back > 0]])
            n, k = len(who), len(e1)
            void = np.concatenate([np.zeros(n, bool), np.ones(k, bool)])
            pad, none = np.zeros(k, np.int64), np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([who, pad]), mask=void), pa.array(np.concatenate([links, pad]), mask=void), pa.array(np.concatenate([none, e1]), mask=~void), pa.array(np.concatenate([none, e2]), mask=~void)],
                ["vec_id", "links", "a", "b"],
            )

    return run


def near_duplicates(table: DataFrame, cosine: float = 0.95, probes: int | None = PROBES, per_cell: int = PER_CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.  probes: cells that a vector is compared in at most; None: all
    that can hold a partner."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine lies above 0 and up to 1")
    if probes is not None and probes < 1:
        raise ValueError("a vector is compared in one cell at least")
    ship(table.sparkSession)
    small_batches(table.sparkSession)
    spark, stage = table.sparkSession, Stage(table.sparkSession)
    r = float(np.sqrt(max(2 - 2 * cosine, 0)))
    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    whole = rows.where(F.col("embedding").isNotNull() & finite).distinct()
    folded = stage.write(whole.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")))
    n = folded.count()
    lengths = folded.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0].d if n else 1
    level = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    got = folded.where(F.size("embedding") == dim).where(level < min(1.0, SAMPLE / max(n, 1))).select("embedding").limit(2 * SAMPLE).collect()
    sample = unit_rows(np.array([g.embedding for g in got], np.float64)) if got else np.eye(1, dim)
    centres = spherical_kmeans(sample, min(len(sample), MOST_CELLS, max(1, round(n / per_cell))))
    shared = spark.sparkContext.broadcast(Cells(centres, r, probes))
    sizes = folded.select("embedding").mapInArrow(count_cells(shared), "dim long, cell long, members long, visitors long").groupBy("dim", "cell").agg(F.sum("members").alias("m"), F.sum("visitors").alias("v"))
    plan, base = {}, 0
    for c in sizes.orderBy("dim", "cell").collect():  # a row for each cell: MOST_CELLS for each length
        m_blocks, v_blocks, first = plan.setdefault(c.dim, np.zeros((3, len(centres)), np.int64))
        if c.m:
            m_blocks[c.cell], v_blocks[c.cell], first[c.cell] = -(-c.m // MEMBERS), -(-c.v // VISITORS), base
            base += int(m_blocks[c.cell] * v_blocks[c.cell])
    kind = "<f4" if "float" in dict(folded.dtypes)["embedding"] else "<f8"
    blocks = meet(folded.mapInArrow(send_blocks(shared, spark.sparkContext.broadcast(plan), kind), BLOCK_SCHEMA), base // 4, "key")
    found = stage.write(blocks.mapInArrow(compare_blocks(cosine, kind, probes is None or probes >= len(centres)), FOUND_SCHEMA))
    links = found.where("vec_id is not null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    leads = folded.join(links, "vec_id").select("embedding", F.col("vec_id").alias("lead"), "links")
    all_links = whole.join(leads, "embedding").select("vec_id", "lead", (F.col("links") - 1).alias("n_links"))
    all_links = stage.write(all_links.groupBy("vec_id").agg(F.min("lead").alias("lead"), F.max("n_links").alias("n_links")))
    edges = found.where("a is not null").select(F.lit(0).alias("g"), "a", "b")
    twins = all_links.where("vec_id <> lead").select(F.lit(0).alias("g"), F.col("vec_id").alias("a"), F.col("lead").alias("b"))
    root = components(edges.unionByName(twins), stage).select(F.col("a").alias("vec_id"), F.col("b").alias("root"))
    out = rows.select("vec_id").join(all_links.select("vec_id", "n_links"), "vec_id", "left").join(root, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
