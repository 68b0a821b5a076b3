"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows (10 words, or the whole of a shorter item), and a
window the set of its word shingles.  Shingles are ordered by rarity, counted over all
documents.  Exact containment needs one prefix token a window: its rarest shingle, which is
joined with the documents' shingles.  A meeting fixes where the window would start, so bounds
of position and length discard it or leave one place, whose words are then compared.

The benchmark is broadcast in slices of at most SLICE_LIMIT bytes of text, and as flat arrays of about 40 bytes
a word; a longer item is cut into parts that share no window and lose none.  Each slice takes two passes over the documents
(any usual benchmark is one slice), and only one is in memory at a time; the slices' results are joined by
document.

Items with a null item_id and documents with a null doc_id are left out; null and empty texts
have no words and match nothing.  Repeated items count once; repeated documents give
repeated, equal rows, and rows that share a doc_id are judged each by its own text.  Of equally rare shingles a
window's prefix is that with the smaller hash, which changes no result.  A very long document is one slice of words and
costs some 40 times its bytes in its worker.  Columns other than doc_id and text are not read (`clean` hands them
on), and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .repeats import gathered
from .shared import Stage, binary_text

#: Bytes of benchmark text that are broadcast at once, and of one part of an item.
SLICE_LIMIT, PART_LIMIT = 8 << 20, 1 << 20
SHINGLE = 3
HIT_SCHEMA = "doc_id long, uid long, start long, stop long, item string"


class Windows:
    """Distinct windows of a slice of the benchmark: places in a stream of word numbers (exact ones, of a vocabulary),
    and their items."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        self.width = width
        data, off = A.column_bytes(pa.array([t for _, t in rows], pa.large_binary()))
        data = A.LOWER[data]
        start, end, before = A.words(data, off, A.ALNUM)
        hashes = A.word_hashes(data, start, end)
        self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.word_bytes = gathered(data, start[first], (end - start)[first])
        self.word_off = np.append(0, np.cumsum((end - start)[first]))
        # windows of every row, then one for each distinct sequence of words
        n = np.diff(before)
        times = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        own = np.repeat(np.arange(len(rows)), times)
        pos = before[:-1][own] + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        size = np.minimum(n[own], width)
        h = A.Spans(A.mix(hashes))(pos, pos + size) if len(pos) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        own, pos, size, h = own[order], pos[order], size[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        same = size == size[head]
        for j in range(width):
            inside = np.flatnonzero(same & (j < size))
            same[inside] &= self.ids[pos[inside] + j] == self.ids[pos[head[inside]] + j]
        new |= ~same  # a window whose hash is another's by chance stands for itself, and so do those after it
        for i in np.flatnonzero(~same):
            if i + 1 < len(h) and h[i + 1] == h[i]:
                new[i + 1] = True
        at = np.cumsum(new) - 1
        self.pos, self.size = pos[new], size[new]
        self.names, item = np.unique(np.array([r[0] for r in rows], dtype=object), return_inverse=True) if rows else (np.zeros(0, object), np.zeros(0, np.int64))
        pairs = np.unique(at * max(len(self.names), 1) + item[own]) if len(at) else np.zeros(0, np.int64)
        self.item = pairs % max(len(self.names), 1)
        self.item_at = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(self.pos) + 1))
        # the shingle that begins at each word (those of windows lie inside one row)
        self.grams = sorted({min(SHINGLE, int(k)) for k in np.unique(self.size)})
        self.at_word = {s: doc_grams(hashes, s) for s in self.grams}
        used = [self.at_word[s][p] for s, p, _ in self.places()]
        self.shingles = np.unique(np.concatenate(used)) if used else np.zeros(0, np.uint64)

    def places(self):
        """(shingle length, places, windows) of all shingles at one offset in their windows."""
        for k in range(1, self.width + 1):
            mine = np.flatnonzero(self.size == k)
            s = min(SHINGLE, k)
            for p in range(k - s + 1) if len(mine) else ():
                yield s, self.pos[mine] + p, mine

    def order(self, counts: np.ndarray) -> None:
        """Take each window's prefix: its rarest shingle (ties: the smaller hash)."""
        best = np.full(len(self.pos), np.iinfo(np.int64).max)
        prefix, offset = np.zeros(len(self.pos), np.uint64), np.zeros(len(self.pos), np.int64)
        for s, p, mine in self.places():
            h = self.at_word[s][p]
            df = counts[np.searchsorted(self.shingles, h)]
            better = (df < best[mine]) | ((df == best[mine]) & (h < prefix[mine]))
            mine, h, df, p = mine[better], h[better], df[better], p[better]
            best[mine], prefix[mine], offset[mine] = df, h, p - self.pos[mine]
        by = np.argsort(prefix, kind="stable")
        self.prefix, self.prefix_window, self.prefix_offset = prefix[by], by, offset[by]
        self.filter = gate(self.prefix)
        self.at_word, self.shingles = {}, self.shingles[:0]

    def items_of(self, windows: np.ndarray) -> list[str]:
        n = np.diff(self.item_at)[windows]
        at = np.arange(int(n.sum())) + np.repeat(self.item_at[windows] - (np.cumsum(n) - n), n)
        return self.names[np.unique(self.item[at])].tolist()


def gate(keys: np.ndarray) -> np.ndarray:
    """A table that says of most other hashes that they aren't among `keys`."""
    out = np.zeros(1 << 22, bool)
    out[keys >> np.uint64(42)] = True
    return out


def doc_grams(w: np.ndarray, s: int) -> np.ndarray:
    g = A.grams(w, s)
    return A.mix(g) if s == 1 else g


def doc_slices(batch):
    data, off = A.column_bytes(batch.column("text"))
    for a, b in A.slices(off):
        d, o = A.LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
        start, end, before = A.words(d, o, A.ALNUM)
        yield a, b, d, start, end, before, A.word_hashes(d, start, end)


def count_shingles(shared):
    """How often each shingle of the benchmark stands in the documents."""

    def run(batches):
        x: Windows = shared.value
        total, table = np.zeros(len(x.shingles), np.int64), gate(x.shingles)
        for batch in batches:
            for _, _, _, _, _, before, w in doc_slices(batch):
                for s in x.grams:
                    g = doc_grams(w, s)
                    n = np.diff(before)
                    ok = np.ones(len(w), bool)
                    for k in range(1, s):  # shingles that reach over a text's end
                        ok[(before[1:] - k)[n >= k]] = False
                    g = g[ok & table[g >> np.uint64(42)]]
                    at = np.searchsorted(x.shingles, g)
                    at[at == len(x.shingles)] = 0
                    total += np.bincount(at[x.shingles[at] == g], minlength=len(total)) if len(total) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "c"])

    return run


def meetings(x: Windows, d, start, end, before, w):
    """(text row, first word in the slice, window) of every occurrence of a window in a slice."""
    rows, places, wins = [], [], []
    for s in x.grams:
        g = doc_grams(w, s)
        p = np.flatnonzero(x.filter[g >> np.uint64(42)])
        lo, hi = np.searchsorted(x.prefix, g[p], "left"), np.searchsorted(x.prefix, g[p], "right")
        n = hi - lo
        p, k = np.repeat(p, n), np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        win, first = x.prefix_window[k], p - x.prefix_offset[k]
        row = np.searchsorted(before, p, side="right") - 1
        size = x.size[win]
        ok = (first >= before[row]) & (first + size <= before[row + 1]) & (np.minimum(size, SHINGLE) == s)  # bounds of position and length
        row, first, win, size = row[ok], first[ok], win[ok], size[ok]
        same = np.ones(len(first), bool)
        for j in range(x.width):
            inside = np.flatnonzero(same & (j < size))
            same[inside] = w[first[inside] + j] == x.vocab[x.ids[x.pos[win[inside]] + j]]
        rows.append(row[same])
        places.append(first[same])
        wins.append(win[same])
    row, first, win = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, places, wins))
    if len(first):  # the bytes of the words, each place once
        size = x.size[win]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place, word = np.repeat(first, size) + at, x.ids[x.pos[np.repeat(win, size)] + at]
        place, k = np.unique(place, return_index=True)
        word = word[k]
        n = (end - start)[place]
        fit = n == np.diff(x.word_off)[word]
        mine, theirs = gathered(d, start[place][fit], n[fit]), gathered(x.word_bytes, x.word_off[word][fit], n[fit])
        wrong = np.zeros(len(place), bool)
        wrong[~fit] = True
        if not np.array_equal(mine, theirs):
            owner = np.repeat(np.flatnonzero(fit), n[fit])
            wrong[owner[mine != theirs]] = True
        if wrong.any():
            bad = np.zeros(len(start) + 1, np.int64)
            bad[place[wrong] + 1] = 1
            bad = np.cumsum(bad)
            ok = bad[first + size] == bad[first]
            row, first, win = row[ok], first[ok], win[ok]
    return row, first, win


def digest_rows(ids, n_words, n_hit, items: list[list[str]], kept=None) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(sorted(set(i))).encode()).hexdigest() for i in items]
    cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(set(i)) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array(np.asarray(n_hit) > 0)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def covered_words(before, row, start, stop, total: int) -> np.ndarray:
    """Words of each text that spans cover (start and stop count from the slice's first word)."""
    hit = np.zeros(total + 1, np.int64)
    np.add.at(hit, start, 1)
    np.add.at(hit, stop, -1)
    return np.diff(np.append(0, np.cumsum(np.cumsum(hit[:-1]) > 0))[before])


def report_slice(shared):
    """The whole report, where one slice holds the benchmark."""

    def run(batches):
        x: Windows = shared.value
        for batch in batches:
            n, hit, items = [], [], []
            for a, b, d, start, end, before, w in doc_slices(batch):
                row, first, win = meetings(x, d, start, end, before, w)
                n.append(np.diff(before))
                hit.append(covered_words(before, row, first, first + x.size[win], len(start)))
                mine: list[list[str]] = [[] for _ in range(b - a)]
                for r in np.unique(row):
                    mine[r] = x.items_of(np.unique(win[row == r]))
                items += mine
            none = [np.zeros(0, np.int64)]
            yield digest_rows(batch.column("doc_id"), np.concatenate(n or none), np.concatenate(hit or none), items)

    return run


def clean_slice(shared):
    """The rows without any window, where one slice holds the benchmark."""

    def run(batches):
        x: Windows = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, d, start, end, before, w in doc_slices(batch):
                keep[a + meetings(x, d, start, end, before, w)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def hit_rows(shared):
    """For one of several slices: the words (as spans) and, apart from these, the items of each document that it hits."""

    def run(batches):
        x: Windows = shared.value
        for batch in batches:
            ids, uid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "uid"))
            for a, _, d, start, end, before, w in doc_slices(batch):
                row, first, win = meetings(x, d, start, end, before, w)
                out = []
                for r in np.unique(row):
                    mine = row == r
                    lo, hi = A.covered(first[mine], first[mine] + x.size[win[mine]])
                    out += [(r, p - before[r], q - before[r], None) for p, q in zip(lo.tolist(), hi.tolist())]
                    out += [(r, None, None, i) for i in x.items_of(np.unique(win[mine]))]
                at, lo, hi, item = zip(*out) if out else ((),) * 4
                at = a + np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(uid[at]), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(item, pa.string())], ["doc_id", "uid", "start", "stop", "item"])

    return run


def report_lists(batches):
    for batch in batches:
        col = batch.column("spans")
        of = np.repeat(np.arange(batch.num_rows), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = col.flatten()
        name = flat.field(2).to_pylist()
        items: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for r, i in zip(of.tolist(), name):
            if i is not None:
                items[r].append(i)
        span = np.array([i is None for i in name], bool)
        row, lo, hi = of[span], *(flat.field(k).to_numpy(zero_copy_only=False)[span].astype(np.int64) for k in (0, 1))
        n, hit = [], []
        for a, b, _, start, _, before, _ in doc_slices(batch):
            mine = (row >= a) & (row < b)
            r = row[mine] - a
            n.append(np.diff(before))
            hit.append(covered_words(before, r, before[r] + lo[mine], before[r] + hi[mine], len(start)))
        none = [np.zeros(0, np.int64)]
        yield digest_rows(batch.column("doc_id"), np.concatenate(n or none), np.concatenate(hit or none), items)


REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_parts(width: int, part: int):
    """(item, part, text): items, those longer than `part` bytes in parts; the next part begins where a part's last whole
    window would be followed by another."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                text = text.as_py()
                if len(text) <= part:
                    out.append((item, 0, text))
                    continue
                data = np.frombuffer(text, np.uint8)
                start, end, _ = A.words(A.LOWER[data], np.array([0, len(data)]), A.ALNUM)
                last = max(len(start) - width, 0)  # where the last window begins
                a = 0
                while a <= last and len(start):
                    b = min(max(int(np.searchsorted(end, start[a] + part, side="right")) - width, a), last)  # the part's last window
                    out.append((item, a, data[start[a] : end[min(b + width, len(start)) - 1]].tobytes()))
                    a = b + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 3, (pa.string(), pa.int64(), pa.binary()))], ["item", "part", "text"])

    return run


def benchmark_slices(texts: DataFrame, benchmark: DataFrame, width: int, limit: int):
    """The benchmark's slices one after the other, as (broadcast with its prefixes chosen, whether it is the only one)."""
    if width < 1:
        raise ValueError("a window has a word at least")
    spark = texts.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = Stage(spark).write(items.mapInArrow(item_parts(width, min(limit, PART_LIMIT)), "item string, part long, text binary"))
    total = int(parts.agg(F.sum(F.length("text") + 64)).first()[0] or 0)
    rows, size = [], 0

    def built():
        x = Windows(rows, width)
        counts = np.zeros(len(x.shingles), np.int64)
        shared = spark.sparkContext.broadcast(x)
        seen = texts.mapInArrow(count_shingles(shared), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # a row for each shingle of the slice at most
        counts[seen.column("k").to_numpy()] = seen.column("c").to_numpy()
        shared.destroy()
        x.order(counts)
        return spark.sparkContext.broadcast(x), total <= limit

    if total > limit:
        parts = parts.repartition(-(-total // (PART_LIMIT * 2)), F.xxhash64("item", "part"))
    for r in parts.toLocalIterator() if total > limit else parts.collect():  # a partition at a time, of some 2 MiB
        if rows and size + len(r.text) + 64 > limit:
            yield built()
            rows, size = [], 0
        rows.append((r.item, bytes(r.text)))
        size += len(r.text) + 64
    yield built()


def all_hits(texts: DataFrame, slices) -> DataFrame:
    """Rows of HIT_SCHEMA of several slices, each written before the next one is built."""
    stage, hits = Stage(texts.sparkSession), None
    for shared, _ in slices:
        h = stage.write(texts.mapInArrow(hit_rows(shared), HIT_SCHEMA))
        shared.destroy()
        hits = h if hits is None else hits.unionByName(h)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = SLICE_LIMIT) -> DataFrame:
    """The report of REPORT_SCHEMA for each document."""
    texts = binary_text(docs)
    slices = benchmark_slices(texts, benchmark, width, limit)
    shared, alone = next(slices)
    if alone:
        return texts.mapInArrow(report_slice(shared), REPORT_SCHEMA)
    texts = texts.withColumn("uid", F.xxhash64("text"))
    hits = all_hits(texts, itertools.chain([(shared, alone)], slices))
    lists = hits.distinct().groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "stop", "item")).alias("spans"))
    return texts.join(lists.hint("merge"), ["doc_id", "uid"], "left").mapInArrow(report_lists, REPORT_SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = SLICE_LIMIT) -> DataFrame:
    """Documents that hold no window of the benchmark, with all their columns."""
    docs = docs.where("doc_id is not null")
    texts = binary_text(docs)
    slices = benchmark_slices(texts, benchmark, width, limit)
    shared, alone = next(slices)
    if alone:
        return docs.mapInArrow(clean_slice(shared), docs.schema)
    hits = all_hits(texts.withColumn("uid", F.xxhash64("text")), itertools.chain([(shared, alone)], slices))
    uid = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    bad = hits.select(F.col("doc_id").alias("_doc"), F.col("uid").alias("_uid")).distinct()
    return docs.join(bad, (F.col("doc_id").cast("long") == F.col("_doc")) & (uid == F.col("_uid")), "left_anti")
