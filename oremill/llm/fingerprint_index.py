"""Incremental substring deduplication over a log-structured fingerprint index.

A batch of texts is cut into fragments of 35-word windows (`winnow`) and becomes an
immutable run: a bucketed table whose rows hold a bucket's fingerprints, sorted.  A new run
is merge-joined with the runs before it, bucket by bucket and without moving them.  Equal
fragments are repeats on both sides; fragments that share only their minimiser are
candidates, and their windows are verified word by word.  Two runs of one level are then
compacted into one of the next, so that a batch meets few runs.

Every word that a repeated window covers is removed, at all its places.  Fragments count as
equal where minimiser and fragment agree in two 64-bit hashes; windows of different fragments are
compared by their words.  A minimiser of very many different fragments is dealt out over the buckets
(`repeats.homes`), and its own bucket keeps a mark.

Rows with a null doc_id are left out, null text has no words, repeated rows count once and
get equal results; so does a row that comes back in a later batch.  A doc_id must not come back with
another text.  A very long text is one slice and costs some 40 times its bytes in its worker.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .repeats import (
    BLOB_SCHEMA, BLOCK_BYTES, CAND, DIGEST_SCHEMA, FLUSH, GROUP, HOT, SPAN, SPAN_SCHEMA, blob_batch, candidates, dealt, dealt_out, fragment_rows,
    gathered, homes, in_flushes, in_order, list_rows, span_batch, union_by_doc, with_lists,
)
from .shared import Stage, binary_text, buckets, meet, met
from .winnow import FRAGMENT

WINDOW, GRAM = 35, 8

def word_spans(f: np.ndarray, window: int) -> np.ndarray:
    pos = f["pos"].astype(np.int64)
    return union_by_doc(f["doc"], pos, pos + f["n"] + (window - 1))


def folded(f: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First of equal fragments, marked `many` where there were more, and the spans that follow from that."""
    f, _, first = in_order(f)
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(f)))
    repeated = np.repeat(size > 1, size)
    spans = word_spans(f[repeated], window)
    seen = np.add.reduceat(f["many"].astype(np.int64), head) > 0 if len(head) else np.zeros(0, bool)
    f = f[first]
    f["many"] = (size > 1) | seen
    return f, spans


def send(window: int, gram: int, n_buckets: int, hot: int):
    def run(batches):
        for f in in_flushes(fragment_rows(batches, "words", window, gram), FLUSH):
            f, spans = folded(f, window)
            f, own = homes(f, hot)
            rows = [(b, x.tobytes(), b"") for b, x in dealt(own, n_buckets, f)]
            rows += [(b, b"", x.tobytes()) for b, x in dealt(A.mix(spans["doc"].astype(np.uint64)), n_buckets, spans)]
            yield blob_batch(rows)

    return run


def make_run(window: int):
    """One sorted row of fingerprints for each bucket, with spans that are certain within the batch."""

    def run(batches):
        for b, (body, sure) in met(batches, "body", "spans"):
            f, more = folded(np.frombuffer(b"".join(body), FRAGMENT).copy(), window)
            spans = np.concatenate([np.frombuffer(b"".join(sure), SPAN), more])
            yield blob_batch([(b, f.tobytes(), union_by_doc(spans["doc"], spans["start"], spans["stop"]).tobytes())])

    return run


def compact(window: int):
    """Two runs' rows of one bucket become one."""

    def run(batches):
        for batch in batches:
            out = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("bucket", "body", "older"))):
                f, _ = folded(np.frombuffer((x or b"") + (y or b""), FRAGMENT).copy(), window)
                out.append((b, f.tobytes(), b""))
            yield blob_batch(out)

    return run


def merge_join(window: int, n_old: int, n_buckets: int, group: int):
    """A new run against the older ones: spans of equal fragments, candidates where only minimisers agree."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, body, spans, *old = (batch.column(c)[row].as_py() for c in ["bucket", "body", "spans", *(f"old{i}" for i in range(n_old))])
                new = np.frombuffer(body, FRAGMENT)
                past = np.concatenate([np.frombuffer(x or b"", FRAGMENT) for x in old]) if old else new[:0]
                past = past[np.isin(past["mh"], new["mh"])]
                f = np.concatenate([past, new])
                recent = np.arange(len(f)) >= len(past)
                order = np.lexsort((recent, f["pos"], f["doc"], f["fh"], f["mh"]))
                f, recent = f[order], recent[order]
                again = np.zeros(len(f), bool)  # a row that came in before is no repeat of itself
                if len(f):
                    again[1:] = (f["mh"][1:] == f["mh"][:-1]) & (f["fh"][1:] == f["fh"][:-1]) & (f["doc"][1:] == f["doc"][:-1]) & (f["pos"][1:] == f["pos"][:-1]) & (f["n"][1:] > 0)
                f, recent = f[~again], recent[~again]
                far, mark = dealt_out(f, bucket, n_buckets), f["n"] == 0
                # a minimiser that this batch deals out for the first time makes candidates of its older fragments
                fresh_mark = np.isin(f["mh"], np.setdiff1d(f["mh"][mark & recent], f["mh"][mark & ~recent]))
                f, recent, far, fresh_mark = f[~mark], recent[~mark], far[~mark], fresh_mark[~mark]
                new_mh = np.ones(len(f), bool)
                new_mh[1:] = f["mh"][1:] != f["mh"][:-1]
                new_fh = new_mh.copy()
                new_fh[1:] |= f["fh"][1:] != f["fh"][:-1]
                head = np.flatnonzero(new_fh)
                size = np.diff(np.append(head, len(f)))
                found = np.concatenate([np.frombuffer(spans, SPAN), word_spans(f[np.repeat(size > 1, size)], window)])
                f, mh, recent = f[new_fh], new_mh[new_fh], np.add.reduceat(recent.astype(np.int64), head) == size if len(head) else recent
                far, fresh_mark = far[new_fh], fresh_mark[new_fh]
                edge = np.flatnonzero(mh)
                kinds = np.diff(np.append(edge, len(f)))
                fresh = np.add.reduceat(recent.astype(np.int64), edge) > 0 if len(edge) else recent
                keep = np.repeat((kinds > 1) & fresh, kinds) | (f["twice"] & recent) | (far & recent) | fresh_mark
                f, far = f[keep], far[keep]
                mh = np.ones(len(f), bool)
                mh[1:] = f["mh"][1:] != f["mh"][:-1]
                yield span_batch(union_by_doc(found["doc"], found["start"], found["stop"]), candidates(f, mh, window, group, far, bucket))

    return run


def send_words(n_buckets: int):
    """Candidates with the bytes of their words, by group."""

    def run(batches):
        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, x = list_rows(batch)
            for a, b in A.slices(off):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                lo, hi = np.searchsorted(row, a), np.searchsorted(row, b)
                start, end, before = A.words(d, o, A.NON_SPACE)
                r = row[lo:hi] - a
                ok = before[r] + x["stop"][lo:hi] <= before[r + 1]
                r = r[ok]
                c = np.empty(len(r), CAND)
                first = before[r] + x["start"][lo:hi][ok]
                last = before[r] + x["stop"][lo:hi][ok] - 1
                c["grp"], c["doc"], c["pos"], c["n"], c["hot"] = x["grp"][lo:hi][ok], ids[a:b][r], x["start"][lo:hi][ok], x["n"][lo:hi][ok], x["hot"][lo:hi][ok]
                c["size"] = end[last] - start[first] if len(r) else 0
                begin = start[first] if len(r) else np.zeros(0, np.int64)
                at = (c["grp"].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                c, begin, at = c[order], begin[order], at[order]
                edge = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else [0]
                yield blob_batch([(int(at[i]), c[i:j].tobytes(), gathered(d, begin[i:j], c["size"][i:j].astype(np.int64)).tobytes()) for i, j in zip(edge[:-1], edge[1:])])

    return run


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for each distinct word, by its bytes."""
    size = end - start
    flat = gathered(data, start, size)
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    col = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])
    return col.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def verify_block(c: np.ndarray, data: np.ndarray, begin: np.ndarray, window: int):
    """Windows with equal words: their places, and each hot group's distinct windows with digests."""
    size = c["size"].astype(np.int64)
    off = np.append(0, np.cumsum(size))
    flat = gathered(data, begin, size)
    start, end, before = A.words(flat, off, A.NON_SPACE)
    ids = exact_ids(flat, start, end)
    n = c["n"].astype(np.int64)
    own = np.repeat(np.arange(len(c)), n)
    shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, doc, pos = before[own] + shift, c["doc"][own], c["pos"][own] + shift
    h = A.Spans(A.mix(ids.astype(np.uint64) + np.uint64(1)))(at, at + window)
    order = np.lexsort((pos, doc, h))
    at, doc, pos, h, hot = at[order], doc[order], pos[order], h[order], c["hot"][own][order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    at, doc, pos, h, hot = at[once], doc[once], pos[once], h[once], hot[once]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    equal = np.ones(len(h), bool)
    member = np.flatnonzero(~new)
    for k in range(window):
        equal[member] &= ids[at[member] + k] == ids[at[lead[member]] + k]
    many = np.zeros(len(h), bool)
    good = member[equal[member]]
    many[good] = True
    many[lead[good]] = True
    odd: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(~equal):  # windows whose hashes collide with another's
        odd.setdefault(ids[at[i] : at[i] + window].tobytes(), []).append(int(i))
    for same in odd.values():
        if len(same) > 1:
            many[same] = True
    pick = np.flatnonzero(hot)
    dig = [xxhash.xxh3_128_digest(b" ".join(flat[start[w] : end[w]].tobytes() for w in range(at[i], at[i] + window))) for i in pick[new[pick] | ~equal[pick]]]
    pick = pick[new[pick] | ~equal[pick]]
    return (doc[many], pos[many]), (doc[pick], pos[pick], np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2))


def verify(window: int):
    def run(batches):
        for _, (cands, texts) in met(batches, "body", "spans"):
            c, data = np.frombuffer(b"".join(cands), CAND), np.frombuffer(b"".join(texts), np.uint8)
            begin = np.cumsum(c["size"], dtype=np.int64) - c["size"]
            order = np.argsort(c["grp"], kind="stable")
            c, begin = c[order], begin[order]
            edge = np.append(np.flatnonzero(np.append(True, c["grp"][1:] != c["grp"][:-1])), len(c)) if len(c) else np.zeros(1, int)
            ends = np.cumsum(c["size"], dtype=np.int64)
            k = 0
            while k < len(edge) - 1:
                a, j = edge[k], k + 1
                while j < len(edge) - 1 and ends[edge[j + 1] - 1] - (ends[a - 1] if a else 0) <= BLOCK_BYTES:
                    j += 1
                b, k = edge[j], j
                (doc, pos), (ldoc, lpos, h) = verify_block(c[a:b], data, begin[a:b], window)
                spans = union_by_doc(doc, pos, pos + window)
                m, r = len(spans), len(ldoc)
                none = np.concatenate([np.ones(m, bool), np.zeros(r, bool)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([spans["doc"], ldoc])), pa.array(np.concatenate([spans["start"], lpos])), pa.array(np.concatenate([spans["stop"], lpos + window])),
                        pa.array(np.concatenate([np.zeros(m, np.int64), h[:, 0]]), mask=none), pa.array(np.concatenate([np.zeros(m, np.int64), h[:, 1]]), mask=none),
                    ],
                    ["doc_id", "start", "stop", "h1", "h2"],
                )

    return run


class FingerprintIndex:
    """Immutable runs of fingerprints, oldest first.  `add` matches a batch with them and takes it in; `resolve` verifies what
    batches gave by their words.  A named index lasts: `open` finds its runs in the catalog again."""

    def __init__(self, spark, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, n_buckets: int = 256, name: str | None = None, hot: int = HOT):
        if not 0 < gram <= window:
            raise ValueError("a gram has a word, and a window is as long as a gram at least")
        self.spark, self.window, self.gram, self.group = spark, window, gram, group
        self.n, self.tables = n_buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[tuple[int, str]] = []
        self.stage, self.name = Stage(spark), name or f"oremill_run_{uuid.uuid4().hex}"
        self.made, self.hot = 0, hot
        if name:
            spark.createDataFrame([(window, gram, group, n_buckets, self.tables, hot)], "window int, gram int, grp int, buckets int, tables int, hot int").write.saveAsTable(f"{name}_options")

    @classmethod
    def open(cls, spark, name: str) -> FingerprintIndex:
        """The index that was made under this name."""
        o = spark.table(f"{name}_options").first()
        index = cls(spark, o.window, o.gram, o.grp, o.buckets, hot=o.hot)
        index.name, index.tables = name, o.tables
        found = [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}_run")]
        for made, level, table in sorted((*map(int, t.removeprefix(f"{name}_run").split("_")), t) for t in found):
            index.runs.append((level, table))
            index.made = made + 1
        return index

    def _table(self, df: DataFrame, level: int) -> str:
        name = f"{self.name}_run{self.made}_{level}"
        self.made += 1
        df.write.bucketBy(self.tables, "bucket").sortBy("bucket").saveAsTable(name)
        return name

    def _compact(self) -> None:
        while len(self.runs) > 1 and self.runs[-1][0] >= self.runs[-2][0]:
            (level, a), (_, b) = self.runs[-1], self.runs[-2]
            old = self.spark.table(b).select("bucket", F.col("body").alias("older"))
            both = self.spark.table(a).select("bucket", "body").hint("merge").join(old, "bucket", "full")
            self.runs[-2:] = [(level + 1, self._table(both.mapInArrow(compact(self.window), BLOB_SCHEMA), level + 1))]
            for t in (a, b):
                self.spark.sql(f"drop table {t}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Spans (grp null) and candidates, for `resolve`, that this batch gives for its own and older texts."""
        self._compact()
        sent = binary_text(docs).mapInArrow(send(self.window, self.gram, self.n, self.hot), BLOB_SCHEMA).repartition(self.tables, "bucket").sortWithinPartitions("bucket")
        run = self._table(sent.mapInArrow(make_run(self.window), BLOB_SCHEMA), 0)
        df = self.spark.table(run)
        for i, (_, name) in enumerate(self.runs):
            df = df.hint("merge").join(self.spark.table(name).select("bucket", F.col("body").alias(f"old{i}")), "bucket", "left")
        found = self.stage.write(df.mapInArrow(merge_join(self.window, len(self.runs), self.n, self.group), SPAN_SCHEMA))
        self.runs.append((0, run))
        return found

    def resolve(self, found: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc_id, start, stop) of repeated words, from what one or more batches gave.  docs: all documents that went in;
        only those with candidates are read out."""
        cands = found.where("grp is not null").groupBy("doc_id", "start", "stop", "grp", "n").agg(F.max("hot").alias("hot"))
        words = meet(with_lists(binary_text(docs), cands, ["start", "stop", "grp", "hot", "n"], "inner").mapInArrow(send_words(self.n), BLOB_SCHEMA), self.n)
        verified = self.stage.write(words.mapInArrow(verify(self.window), DIGEST_SCHEMA))
        leads = verified.where("h1 is not null").select("doc_id", "start", "stop", "h1", "h2").distinct()
        again = leads.groupBy("h1", "h2").count().where("count > 1")
        sure = found.where("grp is null").select("doc_id", "start", "stop").unionByName(verified.where("h1 is null").select("doc_id", "start", "stop"))
        return sure.unionByName(leads.join(again, ["h1", "h2"]).select("doc_id", "start", "stop"))

    def drop(self) -> None:
        """Delete the index with its runs."""
        for _, t in self.runs:
            self.spark.sql(f"drop table if exists {t}")
        self.spark.sql(f"drop table if exists {self.name}_options")
        self.runs = []


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 4, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(doc_id, start, stop) in words: windows whose words also stand elsewhere.  The documents go through a
    new index in `batches` parts (by a hash of doc_id)."""
    index = FingerprintIndex(docs.sparkSession, window, gram, group, buckets(docs), hot=hot)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches))
    try:
        found = [index.add(docs.where(part == b)) for b in range(batches)]
    finally:
        index.drop()
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return index.resolve(every, docs)


def cut_words(text: bool):
    def run(batches):
        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            row, x = list_rows(batch)
            out = []
            for a, b in A.slices(off):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                lo, hi = np.searchsorted(row, a), np.searchsorted(row, b)
                start, end, before = A.words(d, o, A.NON_SPACE)
                r = row[lo:hi] - a
                gone = np.zeros(len(start) + 1, np.int32)
                np.add.at(gone, np.minimum(before[r] + x["start"][lo:hi], before[r + 1]), 1)
                np.add.at(gone, np.minimum(before[r] + x["stop"][lo:hi], before[r + 1]), -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept_before = np.append(0, np.cumsum(keep))[before]
                start, size = start[keep], (end - start)[keep]
                # words with a space after each
                flat = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
                place = np.cumsum(size + 1) - (size + 1)
                flat[np.arange(int(size.sum())) + np.repeat(place - (np.cumsum(size) - size), size)] = gathered(d, start, size)
                edge = np.append(place, len(flat))[kept_before]
                n = np.diff(before)
                left = [flat[p : max(p, q - 1)].tobytes() for p, q in zip(edge[:-1], edge[1:])]
                out.append((n, n - np.diff(kept_before), left))
            n = np.concatenate([p[0] for p in out]) if out else np.zeros(0, np.int64)
            removed = np.concatenate([p[1] for p in out]) if out else np.zeros(0, np.int64)
            left = [t for p in out for t in p[2]]
            last = pa.array([t.decode("utf-8", "replace") for t in left], pa.string()) if text else pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), last], ["doc_id", "n_words", "n_removed", "text" if text else "kept_sha256"])

    return run


def remove_repeated_words(docs: DataFrame, text: bool = True, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of each document: the words left, joined by one space; with
    text=False their kept_sha256 in place of text."""
    joined = with_lists(binary_text(docs), repeated_words(docs, **options), ["start", "stop"], "left")
    return joined.mapInArrow(cut_words(text), f"doc_id long, n_words long, n_removed long, {'text' if text else 'kept_sha256'} string")
