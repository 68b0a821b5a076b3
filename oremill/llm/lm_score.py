"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A word's probability is that of its class in its context times its share of the class:
p(w | h) = p(class(w) | h) (c(w) + 0.5) / T(class).  A class is a group of word endings that
follow similar words (spherical k-means on counts over all training tokens).  Each class keeps
half a count for unknown words, so probabilities sum to one over the known words and one unknown
word a class.

The class softmax has two kinds of features:

* back-off features in a table of fixed size: a bias, the hashed ending of the word before, and the class
  of the word two before.  They are fitted by gradient updates that are summed over the tasks
  holding the events, each step scaled by its feature's expected count, until the step is small;
* n-gram features in tables that grow with the corpus and stay dealt by hash: the word before (whole,
  by a hash), and that word together with the class of the word two before (a skip bigram).  A word's events are
  all in one bucket, so its weights are fitted there by gradient updates on top of the back-off features
  (a block of coordinate ascent), and those of the pair in closed form, drawn to the word's own
  distribution by PRIOR counts.

Counts of all words and contexts are never on one machine: they stay dealt by hash, and the words
and contexts of a text meet them there; the most frequent words and contexts (FREQUENT and
FREQUENT_CONTEXTS at most) are broadcast so that common ones need no shuffle.  A word is identified by 52
bits of a hash and 12 of its ending's, its context feature by 39 of a hash and its ending's.

Rows with a null doc_id are left out; null text is empty and has the end token alone.
Repeated rows count each in training and get equal results.  Without training rows every
count is zero.  A very long text is one slice and costs some 60 times its bytes in its worker.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .embedding_dedup import spherical_kmeans
from .jaccard_join import BLOB_SCHEMA, FLUSH, blobs, packed, unpacked
from .repeats import dealt
from .shared import Stage, binary_text, buckets, meet, met

CLASSES, ENDINGS, NEIGHBOURS = 48, 4096, 256
#: Feature rows: ending of the word before, class of the word two before (each with a row for none), bias.
BEFORE, SKIP = ENDINGS + 1, CLASSES + 1
FEATURES = BEFORE + SKIP + 1
#: Words, and contexts, that are broadcast at most.
FREQUENT, FREQUENT_CONTEXTS = 1 << 17, 1 << 16
#: Gradient updates at most, and the mean step that ends them.
ROUNDS, SMALL_STEP = 12, 1e-3
#: Updates and penalty of a word's own weights; counts by which a context is drawn to its word's distribution.
WORD_ROUNDS, PENALTY, PRIOR = 6, 2.0, 12.0
#: Contexts whose distributions are held at once.
CONTEXTS = 1 << 14
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A271)
#: A context's number is a word's hash (39 bits) and ending (13), with 12 bits for SKIP * CLASSES codes below.
CODE_BITS = np.uint64(12)


class Tokens:
    """Token hashes of a slice's texts, each closed by END, with endings and the two tokens before."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = A.LOWER[data]
        start, end, before = A.words(data, off, A.NON_SPACE)
        n = np.diff(before)
        self.at = np.append(0, np.cumsum(n + 1))
        self.word = np.full(self.at[-1], END)
        place = np.arange(len(start)) + np.repeat(np.arange(len(n)), n)
        self.row = np.repeat(np.arange(len(n)), n + 1)
        pad = np.concatenate([np.zeros(3, np.uint8), data])
        last = [np.where(end - start > k, pad[end + 2 - k], 0).astype(np.uint32) for k in range(3)]
        h = (last[0] * np.uint32(0x9E3779B1) + last[1] * np.uint32(0x85EBCA77) + last[2] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        self.ending = np.full(self.at[-1], ENDINGS, np.int64)  # the end token has a place of its own
        self.ending[place] = h
        self.word[place] = A.word_hashes(data, start, end) & ~np.uint64(ENDINGS - 1) | h.astype(np.uint64)
        self.one = np.append(START, self.word[:-1])
        self.two = np.append(np.array([START, START]), self.word[:-2])[: len(self.word)]
        self.one[self.at[:-1]] = START
        self.two[self.at[:-1]] = START
        second = self.at[:-1][n > 0] + 1
        self.two[second] = START
        self.one_row, self.two_ending = context_endings(self.one), context_endings(self.two)


def context_endings(word: np.ndarray) -> np.ndarray:
    """The ending of a word of the context; ENDINGS where there is none."""
    return np.where(word == START, ENDINGS, (word & np.uint64(ENDINGS - 1)).astype(np.int64))


def skip_rows(of: np.ndarray) -> np.ndarray:
    """The feature row of each ending two words before."""
    return np.append(of[:-1], CLASSES)


def slices(batch):
    data, off = A.column_bytes(batch.column("text"))
    for a, b in A.slices(off):
        yield a, b, Tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return key[head], np.add.reduceat(value, head) if len(head) else value


class Counter:
    """Sums by key of what arrives in pieces."""

    def __init__(self, limit: int = 1 << 20):
        self.keys, self.values, self.size, self.limit = [], [], 0, limit

    def add(self, key: np.ndarray, value: np.ndarray | None = None) -> bool:
        k, v = np.unique(key, return_counts=True) if value is None else (key, value)
        self.keys.append(k)
        self.values.append(v.astype(np.int64))
        self.size += len(k)
        if self.size > self.limit:
            k, v = summed(np.concatenate(self.keys), np.concatenate(self.values))
            self.keys, self.values, self.size = [k], [v], len(k)
        return self.size > self.limit // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        got = summed(np.concatenate(self.keys), np.concatenate(self.values)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.values, self.size = [], [], 0
        return got


def keyed(counter: Counter, n_buckets: int, mixed: bool = True) -> pa.RecordBatch:
    k, v = counter.take()
    k = k.astype(np.uint64)
    return blobs([(b, packed(k[x], v[x]), b"") for b, x in dealt(A.mix(k) if mixed else k, n_buckets, np.arange(len(k)))])


#: Buckets below 0 hold pairs of an ending and the neighbour before it, not words.


def count_words(n_buckets: int):
    def run(batches):
        word, pair = Counter(), Counter()
        for batch in batches:
            for _, _, t in slices(batch):
                full = word.add(t.word)
                pair.add(t.ending * NEIGHBOURS + (A.mix(t.one) >> np.uint64(32)).astype(np.int64) % NEIGHBOURS)
                if full:
                    yield keyed(word, n_buckets)
        yield keyed(word, n_buckets)
        got = keyed(pair, min(n_buckets, 64))
        yield pa.RecordBatch.from_arrays([pa.array(-1 - np.asarray(got.column(0)), pa.int32()), got.column(1), got.column(2)], ["bucket", "body", "extra"])

    return run


def sum_buckets(batches):
    for b, (bodies,) in met(batches, "body"):
        yield blobs([(b, packed(*summed(*unpacked(bodies, ["<u8", "<i8"]))), b"")])


STATS_SCHEMA = "k int, types long, tokens long"


def endings_of(key: np.ndarray) -> np.ndarray:
    return np.where(key == END, ENDINGS, (key & np.uint64(ENDINGS - 1)).astype(np.int64))


def word_stats(batches):
    """Types and tokens of each ending (k from 0 to ENDINGS), and of each count by its bits (k below 0)."""
    types, tokens = np.zeros((2, ENDINGS + 65), np.int64)
    for batch in batches:
        for body in batch.column("body").to_pylist():
            key, c = unpacked([body], ["<u8", "<i8"])
            for at in (64 + endings_of(key), np.floor(np.log2(np.maximum(c, 1))).astype(int)):
                types += np.bincount(at, minlength=len(types))
                tokens += np.bincount(at, weights=c, minlength=len(types)).astype(np.int64)
    some = np.flatnonzero(types)
    yield pa.RecordBatch.from_arrays([pa.array((some - 64).astype(np.int32)), pa.array(types[some]), pa.array(tokens[some])], ["k", "types", "tokens"])


def frequent_rows(least: int):
    def run(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                k, c = unpacked([body], ["<u8", "<i8"])
                keep = c >= least
                yield blobs([(0, packed(k[keep], c[keep]), b"")])

    return run


class Classes:
    """Class of each ending, and what the softmax needs."""

    def __init__(self, pairs: np.ndarray):
        seen = pairs.sum(1)
        x = np.sqrt(pairs / np.maximum(seen, 1)[:, None])
        good = np.flatnonzero(seen[:-1] >= max(1, min(20, seen[:-1].max())))
        self.of = np.zeros(ENDINGS + 1, np.int64)
        if len(good):
            u = x[good] / np.linalg.norm(x[good], axis=1, keepdims=True)
            self.of[:-1] = (x[:-1] @ spherical_kmeans(u, min(CLASSES - 1, len(good))).T).argmax(1)
        self.of[-1] = CLASSES - 1


def contexts(t: Tokens, skip: np.ndarray) -> np.ndarray:
    """Each token's context: the word before and the class two before, with the codes' room below."""
    word = A.mix(t.one) >> np.uint64(25) << np.uint64(13) | t.one_row.astype(np.uint64)
    return word << CODE_BITS | (skip[t.two_ending] * CLASSES).astype(np.uint64)


def of_events(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word feature, back-off row of its ending, class two before and own class of each event."""
    word, code = key >> CODE_BITS, (key & np.uint64((1 << 12) - 1)).astype(np.int64)
    return word, (word & np.uint64((1 << 13) - 1)).astype(np.int64), code // CLASSES, code % CLASSES


def count_contexts(shared, n_buckets: int):
    """Training events (context, class), dealt by the word before."""

    def run(batches):
        of, events = shared.value, Counter()
        skip = skip_rows(of)
        for batch in batches:
            for _, _, t in slices(batch):
                if events.add(contexts(t, skip) + of[t.ending].astype(np.uint64)):
                    yield by_word(events, n_buckets)
        yield by_word(events, n_buckets)

    return run


def by_word(events: Counter, n_buckets: int) -> pa.RecordBatch:
    k, v = events.take()
    return blobs([(b, packed(k[x], v[x]), b"") for b, x in dealt(A.mix(k >> CODE_BITS), n_buckets, np.arange(len(k)))])


def back_off_events(n_buckets: int):
    """The same events without the word, of which there is a fixed number."""

    def run(batches):
        events = Counter()
        for batch in batches:
            for body in batch.column("body").to_pylist():
                k, c = unpacked([body], ["<u8", "<i8"])
                _, one, two, cls = of_events(k)
                if events.add(*summed(((one * SKIP + two) * CLASSES + cls).astype(np.uint64), c)):
                    yield by_context(events, n_buckets)
        yield by_context(events, n_buckets)

    return run


def by_context(events: Counter, n_buckets: int) -> pa.RecordBatch:
    k, v = events.take()
    return blobs([(b, packed(k[x], v[x]), b"") for b, x in dealt(A.mix(k // np.uint64(CLASSES)), n_buckets, np.arange(len(k)))])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def heads(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def word_models(k: np.ndarray, c: np.ndarray, w: np.ndarray):
    """From the sorted events of a bucket, some words at a time: the words' features and weights, their contexts,
    the log-probabilities of all classes in each, and the contexts' counts."""
    first = heads(k >> CODE_BITS)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + CONTEXTS)))
        lo, hi = first[a], first[b] if b < len(first) else len(k)
        word, one, two, cls = of_events(k[lo:hi])
        context = k[lo:hi] - cls.astype(np.uint64)
        at = heads(context)
        x = np.zeros((len(at), CLASSES))
        x[np.searchsorted(at, np.arange(hi - lo), side="right") - 1, cls] = c[lo:hi]
        start = heads(word[at])
        own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
        z, total, seen = class_logits(w, one[at], two[at]), x.sum(1), np.add.reduceat(x, start)
        u = np.zeros((len(start), CLASSES))
        for _ in range(WORD_ROUNDS):
            want = np.add.reduceat(np.exp(log_softmax(z + u[own])) * total[:, None], start)
            u += np.clip((seen - want - PENALTY * u) / (want + PENALTY), -2, 2) * 0.7
        q = np.exp(log_softmax(z + u[own]))
        yield word[at][start], u, context[at], np.log((x + PRIOR * q) / (total + PRIOR)[:, None]), total
        a = b


def context_sizes(batches):
    """How many contexts have a count of so many bits."""
    n = np.zeros(64, np.int64)
    for batch in batches:
        for body in batch.column("body").to_pylist():
            k, c = unpacked([body], ["<u8", "<i8"])
            if len(k):
                at = heads(k - of_events(k)[3].astype(np.uint64))
                n += np.bincount(np.floor(np.log2(np.add.reduceat(c, at))).astype(np.int64), minlength=64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array(n)], ["k", "n"])


def frequent_contexts(shared, least: int):
    """The distributions of contexts seen `least` times or more."""

    def run(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                k, c = unpacked([body], ["<u8", "<i8"])
                if not len(k) or np.add.reduceat(c, heads(k >> CODE_BITS)).max() < least:
                    continue
                at = heads(k >> CODE_BITS)
                size = np.diff(np.append(at, len(k)))
                keep = np.repeat(np.add.reduceat(c, at) >= least, size)
                for _, _, context, lp, total in word_models(k[keep], c[keep], shared.value):
                    many = total >= least
                    yield blobs([(0, context[many].tobytes(), lp[many].astype("<f4").tobytes())])

    return run


def class_logits(w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What the back-off features give each class in each context."""
    return w[one] + w[BEFORE + two] + w[-1]


def class_probabilities(w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Log-probabilities of all classes by the back-off features alone."""
    return log_softmax(class_logits(w, one, two))


def gradients(shared):
    """Observed and expected counts of each feature and class, for one task's events."""

    def run(batches):
        w = shared.value
        seen, want = np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES))
        for batch in batches:
            for body in batch.column("body").to_pylist():
                k, c = unpacked([body], ["<u8", "<i8"])
                context, cls = (k // np.uint64(CLASSES)).astype(np.int64), (k % np.uint64(CLASSES)).astype(np.int64)
                head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(k) else np.zeros(0, int)
                for a in range(0, len(head), 1 << 16):
                    h = head[a : a + (1 << 16)]
                    stop = head[a + (1 << 16)] if a + (1 << 16) < len(head) else len(k)
                    one, two = context[h] // SKIP, context[h] % SKIP
                    x = np.zeros((len(h), CLASSES))
                    x[np.searchsorted(h, np.arange(h[0], stop), side="right") - 1, cls[h[0] : stop]] = c[h[0] : stop]
                    p = np.exp(class_probabilities(w, one, two)) * x.sum(1, keepdims=True)
                    for total, part in ((seen, x), (want, p)):
                        for base, row, size in ((0, one, BEFORE), (BEFORE, two, SKIP)):
                            order = np.argsort(row, kind="stable")
                            first = np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))
                            total[base + row[order][first]] += np.add.reduceat(part[order], first)
                        total[-1] += part.sum(0)
        part = -(-FEATURES // 8)
        yield blobs([(i, seen[i * part : (i + 1) * part].tobytes(), want[i * part : (i + 1) * part].tobytes()) for i in range(8)])

    return run


def sum_gradients(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for b, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x, y = np.frombuffer(x), np.frombuffer(y)
            held[b] = [held[b][0] + x, held[b][1] + y] if b in held else [x, y]
    yield blobs([(b, x.tobytes(), y.tobytes()) for b, (x, y) in held.items()])


def fit(events: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the class softmax; the bias starts at the classes' shares."""
    spark = events.sparkSession
    w = np.zeros((FEATURES, CLASSES), np.float32)
    w[-1] = np.log(share)
    for _ in range(rounds):
        got = events.mapInArrow(gradients(spark.sparkContext.broadcast(w.astype(np.float64))), BLOB_SCHEMA).repartition(8, "bucket").mapInArrow(sum_gradients, BLOB_SCHEMA).collect()
        got = sorted((r.bucket, bytes(r.body), bytes(r.extra)) for r in got)
        if not got:
            break
        seen, want = (np.concatenate([np.frombuffer(r[k]) for r in got]).reshape(FEATURES, CLASSES) for k in (1, 2))
        step = np.clip((seen - want - 0.5 * w) / (want + 2.0), -2, 2).astype(np.float32) / 2
        w += step
        if (np.abs(step) * want).sum() < SMALL_STEP * want.sum():  # by how often its feature and class are expected
            break
    return w


DOC = np.dtype([("doc", "<i8"), ("row", "<i8"), ("n", "<i8"), ("known", "<i8"), ("common", "<f8"), ("model", "<f8")])
SENT_SCHEMA = "bucket long, words binary, contexts binary, base binary"
#: Parts of SENT_SCHEMA that the tables of counts and of events fill.
TABLES = ("counts", "events")


def gate(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    out[keys >> np.uint64(42)] = True
    return out


def places(keys: np.ndarray, table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the sorted keys (whose gate is `table`), and where."""
    maybe = np.flatnonzero(table[x >> np.uint64(42)])
    if not len(keys):
        return maybe[:0], maybe[:0]
    at = np.minimum(np.searchsorted(keys, x[maybe]), len(keys) - 1)
    hit = keys[at] == x[maybe]
    return maybe[hit], at[hit]


def send_scores(shared, n_buckets: int):
    """What the broadcast tables settle of each text; other words and contexts go to where their counts are."""

    def run(batches):
        keys, counts, of, often, lp, log_total = shared.value
        skip, key_gate, often_gate = skip_rows(of), gate(keys), gate(often)
        held: list[tuple] = []

        def flush():
            word, doc, tf, context, cdoc, d = (np.concatenate(c) for c in zip(*held))
            held.clear()
            rows: dict[int, list[bytes]] = {}
            for at, n, parts in (
                (0, len(word), ((k, packed(word[x], doc[x], tf[x])) for k, x in dealt(A.mix(word), n_buckets, np.arange(len(word))))),
                (1, len(context), ((k, packed(context[x], cdoc[x])) for k, x in dealt(A.mix(context >> CODE_BITS), n_buckets, np.arange(len(context))))),
                (2, len(d), ((k, x.tobytes()) for k, x in dealt(A.mix(d["doc"].astype(np.uint64)), n_buckets, d))),
            ):
                for k, body in parts:
                    rows.setdefault(k, [b"", b"", b""])[at] = body
            bucket, *cols = list(rows), *zip(*rows.values())
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "words", "contexts", "base"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, t in slices(batch):
                n = np.diff(t.at)
                d = np.zeros(b - a, DOC)
                d["doc"], d["n"] = ids[a:b], n
                cls = of[t.ending]
                value = -log_total[cls]
                context = contexts(t, skip)
                hit, at = places(often, often_gate, context)
                value[hit] += lp[at, cls[hit]] / np.log(10)
                d["model"] = np.add.reduceat(value, t.at[:-1])
                far = np.ones(len(cls), bool)
                far[hit] = False
                far = np.flatnonzero(far)
                context = context[far] + cls[far].astype(np.uint64)
                cdoc = ids[a:b][t.row[far]]
                common = np.zeros(len(cls), bool)
                hit, at = places(keys, key_gate, t.word)
                common[hit] = True
                value = np.zeros(len(cls))
                value[hit] = np.log10(counts[at] + 0.5)
                d["common"] = np.add.reduceat(value, t.at[:-1])
                d["known"] = np.add.reduceat(common.astype(np.int64), t.at[:-1])
                rest = np.flatnonzero(~common)
                word, row = t.word[rest], t.row[rest]
                order = np.lexsort((word, row))
                word, row = word[order], row[order]
                head = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))) if len(word) else np.zeros(0, int)
                tf = np.diff(np.append(head, len(word))).astype(np.uint32)
                held.append((word[head], ids[a:b][row[head]], tf, context, cdoc, d))
                if sum(len(h[0]) + len(h[3]) for h in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


PART = np.dtype([("doc", "<i8"), ("known", "<i8"), ("sum", "<f8"), ("model", "<f8")])


def parts_of(doc: np.ndarray, known: np.ndarray, total: np.ndarray, model: np.ndarray) -> np.ndarray:
    """One record for each document."""
    order = np.argsort(doc, kind="stable")
    head = heads(doc[order])
    part = np.zeros(len(head), PART)
    if len(head):
        part["doc"] = doc[order][head]
        for name, x in (("known", known), ("sum", total), ("model", model)):
            part[name] = np.add.reduceat(x[order], head)
    return part


def context_values(k: np.ndarray, c: np.ndarray, w: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Log-probabilities of sorted queries (context and class) under the sorted events of their bucket."""
    out, done = np.empty(len(query)), 0
    feature, one, two, cls = of_events(query)

    def part(a: int, b: int, words, u, known, lp):
        for i in range(a, b, CONTEXTS):
            q = slice(i, min(i + CONTEXTS, b))
            z = class_logits(w, one[q], two[q])
            if len(words):
                at = np.minimum(np.searchsorted(words, feature[q]), len(words) - 1)
                z = z + np.where((words[at] == feature[q])[:, None], u[at], 0)
            z = log_softmax(z)
            row = np.arange(len(z))
            out[q] = z[row, cls[q]]
            if len(known):
                mine = query[q] - cls[q].astype(np.uint64)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[at] == mine
                out[q][hit] = lp[at[hit], cls[q][hit]]

    for words, u, known, lp, _ in word_models(k, c, w) if len(query) else ():
        stop = int(np.searchsorted(feature, words[-1], side="right"))
        part(done, stop, words, u, known, lp)
        done = max(done, stop)
    part(done, len(query), feature[:0], None, feature[:0], None)
    return out


def meet_counts(shared, n_buckets: int):
    """Words and contexts of texts meet their counts; sums go to the texts."""

    def run(batches):
        w = shared.value
        for _, (words, asked, base, tables, events) in met(batches, "words", "contexts", "base", *TABLES):
            key, count = unpacked(tables, ["<u8", "<i8"])
            word, doc, tf = unpacked(words, ["<u8", "<i8", "<u4"])
            c = np.zeros(len(word), np.int64)
            if len(key) and len(word):
                order = np.argsort(key)
                key, count = key[order], count[order]
                at = np.minimum(np.searchsorted(key, word), len(key) - 1)
                c = np.where(key[at] == word, count[at], 0)
            query, cdoc = unpacked(asked, ["<u8", "<i8"])
            order = np.argsort(query, kind="stable")
            value = context_values(*unpacked(events, ["<u8", "<i8"]), w, query[order]) / np.log(10)
            none = np.zeros(len(query))
            part = parts_of(np.concatenate([doc, cdoc[order]]), np.concatenate([tf * (c > 0), none.astype(np.int64)]), np.concatenate([tf * np.log10(c + 0.5), none]), np.concatenate([np.zeros(len(doc)), value]))
            d = np.frombuffer(b"".join(base), DOC)
            rows: dict[int, list[bytes]] = {}
            for at, x in ((0, part), (1, d)):
                for k, y in dealt(A.mix(x["doc"].astype(np.uint64)), n_buckets, x):
                    rows.setdefault(k, [b"", b""])[at] = y.tobytes()
            yield blobs([(k, *x) for k, x in rows.items()])

    return run


def total_scores(tokens: int, types: int):
    def run(batches):
        for _, (body, extra) in met(batches, "body", "extra"):
            part, d = np.frombuffer(b"".join(body), PART), np.frombuffer(b"".join(extra), DOC)
            ids, at, copies = np.unique(d["doc"], return_inverse=True, return_counts=True)
            own = np.searchsorted(ids, part["doc"])
            # a repeated row sends its words each time; twins share the sum
            rare, known, model = (np.bincount(own, weights=part[k], minlength=len(ids)) / np.maximum(copies, 1) for k in ("sum", "known", "model"))
            total = d["common"] + rare[at]
            cols = [
                pa.array(np.ascontiguousarray(d["doc"])), pa.array(np.ascontiguousarray(d["n"])), pa.array(np.rint(d["known"] + known[at]).astype(np.int64)), pa.array(np.full(len(d), tokens, np.int64)),
                pa.array(total - d["n"] * np.log10(tokens + 0.5 * (types + 1))), pa.array(total + d["model"] + model[at]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lowest(sizes: dict[int, int], most: int) -> int:
    """The lowest power of two that `most` counts at most reach."""
    least, above = 1 << 62, 0
    for bits in range(61, -1, -1):
        above += sizes.get(bits, 0)
        if above > most:
            break
        least = 1 << bits
    return least


def score(docs: DataFrame, train: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs under a model of train."""
    spark = docs.sparkSession
    stage, n = Stage(spark), buckets(train)
    share = spark.sparkContext.broadcast
    texts = binary_text(train)
    counts = stage.write(meet(texts.mapInArrow(count_words(n), BLOB_SCHEMA), n).mapInArrow(sum_buckets, BLOB_SCHEMA))
    words = counts.where(F.col("bucket") >= 0)
    stats = {r.k: (r.types, r.tokens) for r in words.mapInArrow(word_stats, STATS_SCHEMA).groupBy("k").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()}
    types, tokens = (sum(v[i] for k, v in stats.items() if k >= 0) for i in (0, 1))
    least = lowest({k + 64: v[0] for k, v in stats.items() if k < 0}, FREQUENT)
    keys, c = unpacked([bytes(r.body) for r in words.mapInArrow(frequent_rows(least), BLOB_SCHEMA).select("body").collect()], ["<u8", "<i8"])  # FREQUENT rows at most
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    pairs = np.zeros((ENDINGS + 1) * NEIGHBOURS)
    k, v = unpacked([bytes(r.body) for r in counts.where(F.col("bucket") < 0).select("body").collect()], ["<u8", "<i8"])  # a fixed number of pairs
    pairs[k.astype(np.int64)] = v
    pairs = pairs.reshape(ENDINGS + 1, NEIGHBOURS)
    of = Classes(pairs).of
    # a class holds its words' tokens, half a count for each of them, and half a count for unknown words
    held = np.full(CLASSES, 0.5)
    for k, (t, c_k) in stats.items():
        if k >= 0:
            held[of[k]] += c_k + 0.5 * t
    events = stage.write(meet(texts.mapInArrow(count_contexts(share(of), n), BLOB_SCHEMA), n).mapInArrow(sum_buckets, BLOB_SCHEMA))
    w = fit(stage.write(meet(events.mapInArrow(back_off_events(min(n, 256)), BLOB_SCHEMA)).mapInArrow(sum_buckets, BLOB_SCHEMA)), held / held.sum(), rounds)
    weights = share(w)
    sizes = {r.k: r.n for r in events.mapInArrow(context_sizes, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    got = events.mapInArrow(frequent_contexts(weights, lowest(sizes, FREQUENT_CONTEXTS)), BLOB_SCHEMA).select("body", "extra").collect()  # FREQUENT_CONTEXTS rows at most
    often = np.frombuffer(b"".join(bytes(r.body) for r in got), "<u8")
    order = np.argsort(often)
    lp = np.frombuffer(b"".join(bytes(r.extra) for r in got), "<f4").reshape(-1, CLASSES)[order]
    sent = binary_text(docs).mapInArrow(send_scores(share((keys, c, of, often[order], lp, np.log10(held))), n), SENT_SCHEMA)
    for name, table in zip(TABLES, (words, events)):
        sent = sent.unionByName(table.select(F.col("bucket").cast("long").alias("bucket"), F.col("body").alias(name)), allowMissingColumns=True)
    summed_up = meet(sent, n).mapInArrow(meet_counts(weights, n), BLOB_SCHEMA)
    return meet(summed_up, n).mapInArrow(total_scores(tokens, types), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
