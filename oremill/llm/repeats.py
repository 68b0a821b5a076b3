"""Suffix-array deduplication: removing every byte string of `window` bytes that started earlier.

Plan (all steps linear in the text):

1. Texts are cut into fragments of windows with one minimiser (`winnow`).  Each task first
   settles equal fragments among its own rows, so of a fragment that a third of all texts
   hold, a task sends one row.
2. Fragments meet by minimiser, one bucket of minimisers in memory at a time.  All but the first of equal
   fragments are repeats as a whole.  Different fragments with one minimiser become candidates, in groups of
   bounded size.  A minimiser of more than HOT different fragments in one task's batch (a phrase in
   very many texts) is dealt out by fragment, and its own bucket is told so.
3. The bytes of candidates are compared in blocks: the BWT interval expansion in `bwt` gives
   the classes of equal windows.  Where a minimiser has more than one group, each group's
   first windows meet once more by a 128-bit digest.
4. The spans of each text meet its bytes again, and are cut out.

Fragments count as equal where minimiser and fragment agree in two 64-bit hashes; windows of different
fragments are compared by their bytes.

Rows with a null doc_id are left out; null text is empty.  A repeated row is taken once and
gets the same spans as its twin; so do rows that share a doc_id with unequal texts.  Of equal strings the
one at the smallest (doc_id, start) stays.  A very long text is one slice and costs some 40 times its bytes in its
worker.  Columns other than doc_id and text are not read (`stripped` hands them on, and refuses one named spans).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bwt import repeat_classes
from .shared import Stage, binary_text, buckets, meet, met
from .winnow import FRAGMENT, fragments

#: Fragments of one minimiser that are compared in one block.
GROUP = 512
#: Fragments that a task holds before it settles and sends them.
FLUSH = 250_000
#: Different fragments of one minimiser in a task's batch from which on they are dealt out one by one.
HOT = 64
#: Bytes of candidates that one BWT covers.
BLOCK_BYTES = 1 << 19

SPAN_SCHEMA = "doc_id long, start long, stop long, grp long, hot boolean, n int"
BLOB_SCHEMA = "bucket int, body binary, spans binary"
SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("stop", "<i8")])
CAND = np.dtype([("grp", "<i8"), ("doc", "<i8"), ("pos", "<i8"), ("n", "<i4"), ("size", "<i4"), ("hot", "?")])


def union_by_doc(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Maximal disjoint spans of each document."""
    out = np.zeros(0, SPAN)
    if len(doc):
        ids, at = np.unique(doc, return_inverse=True)
        room = int(stop.max()) + 2
        s, e = A.covered(at * room + start, at * room + stop)
        out = np.empty(len(s), SPAN)
        out["doc"], out["start"], out["stop"] = ids[s // room], s % room, e % room
    return out


def in_order(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments by (mh, fh, doc, pos) without repeated rows; where a minimiser and where a fragment begins."""
    f = f[np.lexsort((f["pos"], f["doc"], f["fh"], f["mh"]))]
    if len(f):
        same = np.ones(len(f), bool)
        same[0] = False
        for k in ("mh", "fh", "doc", "pos"):
            same[1:] &= f[k][1:] == f[k][:-1]
        f = f[~same]
    new_mh = np.ones(len(f), bool)
    new_mh[1:] = f["mh"][1:] != f["mh"][:-1]
    new_fh = new_mh.copy()
    new_fh[1:] |= f["fh"][1:] != f["fh"][:-1]
    return f, new_mh, new_fh


def tokens_of(kind: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice and the tokens before each text: bytes, or words between white space."""
    if kind == "bytes":
        return A.BYTE_HASH[data], off
    start, end, before = A.words(data, off, A.NON_SPACE)
    return A.word_hashes(data, start, end), before


def fragment_rows(batches, kind: str, window: int, gram: int):
    """Arrays of fragments of a task's rows (doc_id, text), slice by slice."""
    for batch in batches:
        data, off = A.column_bytes(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, b in A.slices(off):
            x, before = tokens_of(kind, data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield fragments(x, before, ids[a:b], window, gram)


def in_flushes(arrays, limit: int):
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size >= limit:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def dealt(key: np.ndarray, n: int, rows: np.ndarray):
    """(bucket, rows of that bucket), in the rows' order."""
    at = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    edge = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else [], len(at)).astype(np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(at[a]), rows[a:b]


def blob_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    bucket, body, spans = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.array(spans, pa.binary())], ["bucket", "body", "spans"])


def homes(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different fragments in order, with a mark (n = 0) for each minimiser that has more than `most`; and each row's number,
    whose rest by n_buckets is its bucket: by minimiser, but for fragments of marked ones by fragment."""
    new = np.ones(len(f), bool)
    new[1:] = f["mh"][1:] != f["mh"][:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(f)))
    hot = np.repeat(size > most, size)
    marks = np.zeros(int((size > most).sum()), FRAGMENT)
    marks["mh"] = f["mh"][head[size > most]]
    own = np.where(hot, A.mix(f["mh"] ^ A.mix(f["fh"])), A.mix(f["mh"]))
    return np.concatenate([f, marks]), np.concatenate([own, A.mix(marks["mh"])])


def dealt_out(f: np.ndarray, bucket: int, n_buckets: int) -> np.ndarray:
    """Which rows of a bucket have a minimiser some of whose fragments are in other buckets."""
    marked = np.unique(f["mh"][f["n"] == 0])
    return np.isin(f["mh"], marked) | (A.mix(f["mh"]) % np.uint64(n_buckets) != np.uint64(bucket))


def send_fragments(window: int, gram: int, n_buckets: int, hot: int = HOT):
    """Step 1: blobs of first fragments by minimiser, and spans that are settled already."""

    def run(batches):
        for f in in_flushes(fragment_rows(batches, "bytes", window, gram), FLUSH):
            f, _, first = in_order(f)
            late = f[~first]
            spans = union_by_doc(late["doc"], late["pos"].astype(np.int64), late["pos"].astype(np.int64) + late["n"] + (window - 1))
            f, own = homes(f[first], hot)
            rows = [(b, x.tobytes(), b"") for b, x in dealt(own, n_buckets, f)]
            rows += [(b, b"", x.tobytes()) for b, x in dealt(A.mix(spans["doc"].astype(np.uint64)), n_buckets, spans)]
            yield blob_batch(rows)

    return run


def span_batch(spans: np.ndarray, cands: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of SPAN_SCHEMA: repeats (grp null) and candidates."""
    if cands is None:
        cands = np.zeros(0, CAND)
    k, c = len(spans), len(cands)
    none = np.concatenate([np.ones(k, bool), np.zeros(c, bool)])
    col = lambda a, b: pa.array(np.concatenate([a, b]))
    return pa.RecordBatch.from_arrays(
        [
            col(spans["doc"], cands["doc"]), col(spans["start"], cands["pos"]), col(spans["stop"], cands["pos"] + cands["size"]),
            pa.array(np.concatenate([np.zeros(k, np.int64), cands["grp"]]), mask=none), col(np.zeros(k, bool), cands["hot"]), col(np.zeros(k, np.int32), cands["n"]),
        ],
        ["doc_id", "start", "stop", "grp", "hot", "n"],
    )


def candidates(f: np.ndarray, new_mh: np.ndarray, window: int, group: int = GROUP, out_of: np.ndarray | None = None, bucket: int = 0) -> np.ndarray:
    """Candidate rows of fragments that lie in the order of `in_order`; groups hold `group` fragments at most.
    out_of: rows whose minimiser is in other buckets too, where it has groups of its own."""
    out = np.empty(len(f), CAND)
    if len(f):
        head = np.maximum.accumulate(np.where(new_mh, np.arange(len(f)), 0))
        sub = (np.arange(len(f)) - head) // group
        total = np.diff(np.append(np.flatnonzero(new_mh), len(f)))
        out["grp"] = A.mix(f["mh"] + A.mix(sub.astype(np.uint64) + np.uint64(bucket << 32))).view(np.int64)
        out["hot"] = np.repeat(total > group, total)
        if out_of is not None:
            out["hot"] |= out_of
        out["doc"], out["pos"], out["n"], out["size"] = f["doc"], f["pos"], f["n"], f["n"] + (window - 1)
    return out


def settle_fragments(window: int, n_buckets: int, group: int = GROUP):
    """Step 2: later twins of fragments are repeats; fragments that differ under one minimiser, or hold it
    twice, are candidates."""

    def run(batches):
        for bucket, (body, more) in met(batches, "body", "spans"):
            f, spans = np.frombuffer(b"".join(body), FRAGMENT), np.frombuffer(b"".join(more), SPAN)
            f, _, first = in_order(f)
            late = f[~first]
            spans = np.concatenate([spans, union_by_doc(late["doc"], late["pos"].astype(np.int64), late["pos"].astype(np.int64) + late["n"] + (window - 1))])
            f = f[first]
            far = dealt_out(f, bucket, n_buckets)
            f, far = f[f["n"] > 0], far[f["n"] > 0]
            new_mh = np.ones(len(f), bool)
            new_mh[1:] = f["mh"][1:] != f["mh"][:-1]
            size = np.diff(np.append(np.flatnonzero(new_mh), len(f)))
            keep = np.repeat(size > 1, size) | f["twice"] | far
            yield span_batch(union_by_doc(spans["doc"], spans["start"], spans["stop"]), candidates(f[keep], new_mh[keep], window, group, far[keep], bucket))

    return run


def with_lists(docs: DataFrame, spans: DataFrame, fields: list[str], how: str) -> DataFrame:
    """docs joined to the list of their spans, by a merge join, which spills what memory can't hold."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return docs.join(lists.hint("merge"), "doc_id", how)


def list_rows(batch: pa.RecordBatch, name: str = "spans") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number of each list element, and its fields."""
    col = batch.column(name)
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(len(size)), size), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    total = int(size.sum())
    return data[np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)] if total else data[:0]


def send_candidates(n_buckets: int):
    """Step 3a: candidates with their bytes, by group."""

    def run(batches):
        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            row, x = list_rows(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            c = np.empty(len(row), CAND)
            c["grp"], c["doc"], c["pos"], c["n"], c["hot"] = x["grp"], ids[row], x["start"], x["n"], x["hot"]
            c["size"] = x["stop"] - x["start"]
            ok = off[row] + x["stop"] <= off[row + 1]
            c, begin = c[ok], (off[row] + x["start"])[ok]
            at = (c["grp"].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            c, begin, at = c[order], begin[order], at[order]
            edge = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else [0]
            rows = [(int(at[a]), c[a:b].tobytes(), gathered(data, begin[a:b], c["size"][a:b].astype(np.int64)).tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            yield blob_batch(rows)

    return run


DIGEST_SCHEMA = "doc_id long, start long, stop long, h1 long, h2 long"


def compare_block(c: np.ndarray, data: np.ndarray, begin: np.ndarray, window: int):
    """Repeats among candidates, and the first windows of hot groups with digests: (doc, pos) arrays."""
    size = c["size"].astype(np.int64)
    s = np.zeros(int(size.sum()) + len(c) + 1, np.uint16)
    place = np.cumsum(size + 1) - (size + 1)
    flat = gathered(data, begin, size)
    s[np.arange(len(flat)) + np.repeat(place - (np.cumsum(size) - size), size)] = flat.astype(np.uint16) + 1
    sa, new = repeat_classes(s, window)
    owner = np.full(len(s), -1, np.int32)
    n = c["n"].astype(np.int64)
    at = np.arange(int(n.sum())) + np.repeat(place - (np.cumsum(n) - n), n)
    owner[at] = np.repeat(np.arange(len(c), dtype=np.int32), n)
    own = owner[sa]
    keep = own >= 0
    cls, own, where = np.cumsum(new)[keep], own[keep], sa[keep].astype(np.int64)
    pos = c["pos"][own] + where - place[own]
    multi = np.zeros(len(cls), bool)
    if len(cls) > 1:
        multi[1:] = cls[1:] == cls[:-1]
        multi[:-1] |= multi[1:]
    hot = c["hot"][own]
    idx = np.flatnonzero(multi | hot)
    idx = idx[np.lexsort((pos[idx], c["doc"][own[idx]], cls[idx]))]
    first = np.ones(len(idx), bool)
    first[1:] = cls[idx[1:]] != cls[idx[:-1]]
    lead = idx[first]
    leader = lead[np.cumsum(first) - 1]  # rows that share a doc_id may hold a window at its own place once more
    late = idx[(c["doc"][own[idx]] != c["doc"][own[leader]]) | (pos[idx] != pos[leader])]
    lead = lead[hot[lead]]
    text = (s - 1).astype(np.uint8)
    dig = [xxhash.xxh3_128_digest(text[p : p + window]) for p in where[lead]]
    h = np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2)
    return (c["doc"][own[late]], pos[late]), (c["doc"][own[lead]], pos[lead], h)


def once(c: np.ndarray, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by group, document and place, and where their bytes begin; what a repeated row sent again goes."""
    order = np.lexsort((c["pos"], c["doc"], c["grp"]))
    c, begin = c[order], begin[order]
    same = np.zeros(len(c), bool)
    if len(c):
        same[1:] = (c["grp"][1:] == c["grp"][:-1]) & (c["doc"][1:] == c["doc"][:-1]) & (c["pos"][1:] == c["pos"][:-1])
    seen: set[bytes] = set()
    for i in np.flatnonzero(same | np.append(same[1:], False)):  # rows of one doc_id may differ in their bytes
        if not same[i]:
            seen = set()
        body = data[begin[i] : begin[i] + c["size"][i]].tobytes()
        same[i] = body in seen
        seen.add(body)
    return c[~same], begin[~same]


def compare_candidates(window: int):
    """Step 3b: the BWT comparison, block by block."""

    def run(batches):
        for _, (cands, texts) in met(batches, "body", "spans"):
            c, data = np.frombuffer(b"".join(cands), CAND), np.frombuffer(b"".join(texts), np.uint8)
            begin = np.cumsum(c["size"], dtype=np.int64) - c["size"]
            c, begin = once(c, data, begin)
            edge = np.append(np.flatnonzero(np.append(True, c["grp"][1:] != c["grp"][:-1])), len(c)) if len(c) else np.zeros(1, int)
            ends = np.cumsum(c["size"], dtype=np.int64)
            k = 0
            while k < len(edge) - 1:
                a, j = edge[k], k + 1
                while j < len(edge) - 1 and ends[edge[j + 1] - 1] - (ends[a - 1] if a else 0) <= BLOCK_BYTES:
                    j += 1
                b, k = edge[j], j
                (doc, pos), (ldoc, lpos, h) = compare_block(c[a:b], data, begin[a:b], window)
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


def left_over(batch):
    """Of each row with its list of spans: bytes, bytes removed, maximal removed runs (row, start, stop), and
    what is left (bytes of all rows, offsets)."""
    data, off = A.column_bytes(batch.column("text"))
    row, x = list_rows(batch)
    s = e = np.zeros(0, np.int64)
    if len(row):  # spans of one text join where they touch; those of neighbouring texts must not
        s, e = A.covered(off[row] + x["start"] + row, np.minimum(off[row] + x["stop"], off[row + 1]) + row)
        s, e = s[e > s], e[e > s]
    at = np.searchsorted(off + np.arange(len(off)), s, side="right") - 1
    s, e = s - at, e - at
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, s, 1)
    np.add.at(gone, e, -1)
    keep = np.cumsum(gone[:-1]) == 0
    koff = np.append(0, np.cumsum(keep))[off]
    return np.diff(off), np.diff(off) - np.diff(koff), (at, s - off[at], e - off[at]), data[keep], koff


def cut_digests(batches):
    for batch in batches:
        n, removed, (at, _, _), left, koff = left_over(batch)
        sha = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(koff[:-1], koff[1:])]
        spans = np.bincount(at, minlength=len(n)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut_bytes(batches):
    for batch in batches:
        n, removed, (at, s, e), left, koff = left_over(batch)
        runs = [[] for _ in range(len(n))]
        for r, a, b in zip(at.tolist(), s.tolist(), e.tolist()):
            runs[r].append({"start": a, "stop": b})
        kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(koff.astype(np.int32)), pa.py_buffer(left)])
        cols = [batch.column("doc_id"), pa.array(n), pa.array(removed), kept, pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "kept", "removed"])


def cut_rows(names: list[str]):
    """The rows with what is left of text (a character that lost some of its bytes goes), and n_removed."""

    def run(batches):
        for batch in batches:
            _, removed, _, left, koff = left_over(batch)
            text = pa.array([left[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(koff[:-1], koff[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*(text if c == "text" else batch.column(c) for c in names), pa.array(removed)], [*names, "n_removed"])

    return run


def repeated_spans(docs: DataFrame, window: int = 100, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(doc_id, start, stop): byte spans covered by strings of `window` bytes that also start earlier (at a
    smaller doc_id, or before in the same text).  Spans of one text may overlap."""
    if window < 16:
        raise ValueError("a window has 16 bytes at least")
    spark = docs.sparkSession
    stage, n, gram = Stage(spark), buckets(docs), max(8, min(32, window // 3))
    texts = binary_text(docs)
    sent = meet(texts.mapInArrow(send_fragments(window, gram, n, hot), BLOB_SCHEMA), n)
    found = stage.write(sent.mapInArrow(settle_fragments(window, n, group), SPAN_SCHEMA))
    cands = with_lists(texts, found.where("grp is not null"), ["start", "stop", "grp", "hot", "n"], "inner")
    blobs = meet(cands.mapInArrow(send_candidates(n), BLOB_SCHEMA), n)
    compared = stage.write(blobs.mapInArrow(compare_candidates(window), DIGEST_SCHEMA))
    leads = compared.where("h1 is not null")
    firsts = leads.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1")
    later = leads.join(firsts, ["h1", "h2"]).where("doc_id <> f.doc_id or start <> f.start")
    return found.where("grp is null").select("doc_id", "start", "stop").unionByName(compared.where("h1 is null").select("doc_id", "start", "stop")).unionByName(later.select("doc_id", "start", "stop"))


def with_spans(docs: DataFrame, window: int, group: int = GROUP, hot: int = HOT, keep: list[str] = []) -> DataFrame:
    return with_lists(binary_text(docs, *keep), repeated_spans(docs, window, group, hot), ["start", "stop"], "left")


def remove_repeats(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept binary, removed array<struct<start, stop>>) for each document."""
    return with_spans(docs, window).mapInArrow(cut_bytes, "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start: long, stop: long>>")


def stripped(docs: DataFrame, window: int = 100) -> DataFrame:
    """docs with all their columns, text cut to what is left, and n_removed (which replaces a column of that name)."""
    docs = docs.drop("n_removed")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if "spans" in others:
        raise ValueError("a column must not be named spans")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` {kinds[c]}" for c in others), "n_removed long"])
    return with_spans(docs, window, keep=others).mapInArrow(cut_rows(["doc_id", "text", *others]), schema)


def repeat_report(docs: DataFrame, window: int = 100, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document."""
    return with_spans(docs, window, group, hot).mapInArrow(cut_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
