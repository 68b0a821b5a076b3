"""Textual near-duplicates: character shingles, Jaccard, MinHash, LSH.

A document is a row; its shingles are an array, made where the row is (no shuffle).  Only
comparisons move data: the inverted index for exact Jaccard, and the band buckets for LSH.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.functions.hashing import PRIME, hash_family, md5_32
from oremill.functions.saved import saved
from oremill.functions.ship import ship


def _hashed(text: str | None, k: int) -> np.ndarray:
    if not text or len(text) < k:
        return np.zeros(0, np.int64)
    grams = {text[i : i + k] for i in range(len(text) - k + 1)}
    tail = b"".join(hashlib.md5(g.encode()).digest()[-4:] for g in grams)
    return np.unique(np.frombuffer(tail, ">u4")).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    want = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(want) if _few_parts(d, want) else d


def _few_parts(d: DataFrame, want: int) -> bool:
    """Whether a scan of small files leaves cores idle for the work on each text."""
    return d.rdd.getNumPartitions() < want


def shingle_arrays(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", hashing: bool = True) -> DataFrame:
    """(doc_id, shingles): the sorted distinct k-character shingles, as strings or md5 numbers."""
    if k < 1:
        raise ValueError("a shingle has a character at least")
    kind = "bigint" if hashing else "string"

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            if hashing:
                out = pa.array([_hashed(t, k) for t in texts], pa.list_(pa.int64()))
            else:
                out = pa.array([sorted({t[i : i + k] for i in range(len(t) - k + 1)}) if t else [] for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "shingles"])

    d = _rows(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, shingles array<{kind}>")


def shingle_counts(docs: DataFrame, k: int = 10) -> DataFrame:
    return shingle_arrays(docs, k).select("doc_id", F.size("shingles").cast("long").alias("n_shingles"))


def jaccard(a, b):
    """Column: |a and b| / |a or b| of two array columns, 0.0 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def jaccard_pairs(shingles: DataFrame) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs doc_a < doc_b.

    The shared counts come from an inverted index (an equi-join on the shingle); the pairs themselves
    are the output asked for, so this is for corpora whose square is wanted.
    """
    s = shingles.select("doc_id", F.size("shingles").alias("n"))
    x = shingles.select("doc_id", F.explode("shingles").alias("s"))
    both = x.alias("a").join(x.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.doc_id") < F.col("b.doc_id"))).groupBy(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).count()
    pairs = s.select(F.col("doc_id").alias("doc_a"), F.col("n").alias("na")).join(s.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("nb")), F.col("doc_a") < F.col("doc_b"))
    out = pairs.join(both, ["doc_a", "doc_b"], "left").withColumn("c", F.coalesce("count", F.lit(0)))
    either = F.col("na") + F.col("nb") - F.col("c")
    return out.select("doc_a", "doc_b", F.when(either == 0, F.lit(0.0)).otherwise(F.col("c") / either).alias("jaccard"))


def signatures(docs: DataFrame, k: int = 10, n: int = 100, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True) -> DataFrame:
    """(doc_id, signature): the n minima of (a x + b) mod PRIME over a document's hashed shingles.

    A document without shingles has PRIME everywhere; keep_empty=False leaves it out.
    """
    a, b = hash_family(n, seed)
    wide = max(a) >= 1 << 32  # such a multiplier could overflow 64 bits

    def minima(x: np.ndarray) -> list[int]:
        if not len(x):
            return [PRIME] * n
        if wide:
            return [min((p * v + q) % PRIME for v in x.tolist()) for p, q in zip(a, b)]
        u, out = x.astype(np.uint64), []
        for p, q in zip(a, b):
            out.append(int((((u * np.uint64(p)) % np.uint64(PRIME) + np.uint64(q)) % np.uint64(PRIME)).min()))
        return out

    def run(batches):
        for batch in batches:
            sets = [_hashed(t, k) for t in batch.column("text").to_pylist()]
            keep = pa.array([keep_empty or len(s) > 0 for s in sets])
            sig = pa.array([minima(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sig], ["doc_id", "signature"]).filter(keep)

    d = _rows(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, signature array<bigint>")


def estimate(a, b):
    """Column: the share of equal components of two signature columns of one length."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    bad = F.raise_error(F.lit("signatures differ in length"))
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(bad.cast("double"))


def estimate_pairs(sigs: DataFrame) -> DataFrame:
    a = sigs.select(F.col("doc_id").alias("doc_a"), F.col("signature").alias("sa"))
    b = sigs.select(F.col("doc_id").alias("doc_b"), F.col("signature").alias("sb"))
    return a.join(b, F.col("doc_a") < F.col("doc_b")).select("doc_a", "doc_b", estimate("sa", "sb").alias("estimate"))


def choose_bands(n: int, t: float) -> int:
    """The divisor b of n whose threshold (1/b)**(b/n) is nearest to t; the smallest of equals."""
    return min((b for b in range(1, n + 1) if n % b == 0), key=lambda b: (min(1.0, abs((1 / b) ** (b / n) - t)), b))


@dataclass(frozen=True)
class LSH:
    """Banded candidates over signatures."""

    n: int = 100
    t: float = 0.8
    bands: int | None = None
    rows: int = field(init=False)

    def __post_init__(self):
        bands = choose_bands(self.n, self.t) if self.bands is None else self.bands
        if bands <= 0:
            raise ValueError("bands must be above 0")
        if self.n % bands:
            raise ValueError("bands must divide the signature length")
        object.__setattr__(self, "bands", bands)
        object.__setattr__(self, "rows", self.n // bands)

    def buckets(self, sigs: DataFrame) -> DataFrame:
        """(doc_id, band, bucket): md5 number of the band's components joined by a pipe."""
        size = F.when(F.size("signature") == self.n, F.col("signature")).otherwise(F.raise_error(F.lit("signatures differ in length")).cast("array<bigint>"))
        keys = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.struct(i.alias("band"), md5_32(F.array_join(F.slice(F.col("sig").cast("array<string>"), i * self.rows + 1, self.rows), "|")).alias("bucket")))
        return sigs.select("doc_id", size.alias("sig")).select("doc_id", F.explode(keys).alias("k")).select("doc_id", F.col("k.band").cast("long").alias("band"), F.col("k.bucket").alias("bucket"))

    def candidates(self, sigs: DataFrame) -> DataFrame:
        """(doc_a, doc_b): distinct pairs with a common bucket in some band."""
        x = self.buckets(sigs)
        return x.alias("a").join(x.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).distinct()

    def pairs(self, sigs: DataFrame) -> DataFrame:
        """(doc_a, doc_b, estimate) of candidates whose estimate reaches t."""
        a = sigs.select(F.col("doc_id").alias("doc_a"), F.col("signature").alias("sa"))
        b = sigs.select(F.col("doc_id").alias("doc_b"), F.col("signature").alias("sb"))
        return self.candidates(sigs).join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", estimate("sa", "sb").alias("estimate")).where(F.col("estimate") >= self.t)


def classes(sigs: DataFrame) -> DataFrame:
    """(doc_id, representative): documents of one signature under the smallest of them.  Copies would
    otherwise meet in every band, all pairs of them."""
    lead = sigs.groupBy("signature").agg(F.min("doc_id").alias("representative"))
    return sigs.join(lead, "signature").select("doc_id", "representative")


def representatives(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "signature")


class SimilarityPipeline:
    """Shingles, exact and estimated similarities, and LSH pairs of one corpus, each a lazy DataFrame."""

    def __init__(self, docs: DataFrame, k: int = 10, n: int = 100, t: float = 0.8, bands: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"):
        self.lsh = LSH(n, t, bands)
        self.shingles = shingle_arrays(docs, k, id_col, text_col)
        self.signatures = signatures(docs, k, n, seed, id_col, text_col)

    @property
    def counts(self) -> DataFrame:
        return self.shingles.select("doc_id", F.size("shingles").cast("long").alias("n_shingles"))

    @property
    def exact(self) -> DataFrame:
        return jaccard_pairs(self.shingles)

    @property
    def estimates(self) -> DataFrame:
        return estimate_pairs(self.signatures)

    @property
    def candidates(self) -> DataFrame:
        return self.lsh.candidates(self.signatures)

    @property
    def pairs(self) -> DataFrame:
        return self.lsh.pairs(self.signatures)

    def report(self) -> DataFrame:
        """(section, line) rows in reading order: parameters, shingle counts, similarities, pairs."""
        p = self.counts.sparkSession.createDataFrame([(0, "", f"signature length {self.lsh.n}, threshold {self.lsh.t}, bands {self.lsh.bands}")], "part int, k string, line string")
        c = self.counts.select(F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("k"), F.format_string("%s: %d shingles", F.col("doc_id").cast("string"), "n_shingles").alias("line"))
        s = self.exact.join(self.estimates, ["doc_a", "doc_b"]).select(F.lit(2).alias("part"), F.concat_ws(" ~ ", "doc_a", "doc_b").alias("k"), F.format_string("%s ~ %s exact %.3f est %.3f", F.col("doc_a").cast("string"), F.col("doc_b").cast("string"), "jaccard", "estimate").alias("line"))
        q = self.pairs.select(F.lit(3).alias("part"), F.concat_ws(" ~ ", "doc_a", "doc_b").alias("k"), F.concat_ws(" ~ ", "doc_a", "doc_b").alias("line"))
        return p.unionByName(c).unionByName(s).unionByName(q).orderBy("part", "k")
