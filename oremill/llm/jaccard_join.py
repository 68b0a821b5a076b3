"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets that link share a token among the first n - ceil(t n) + 1 of each, under any one
order of all tokens.  Three orders are used, each with rare tokens first and its own ties:

1. Each text gives a hashed part of its shingles (enough to fill its prefix), which are
   counted over all texts; tokens of one text alone can match nothing and are not sent back.  A token of more
   than HOT texts in some task's batch comes last in every order, whatever its count; its texts are dealt out, and
   the token's own bucket is told so.
2. Under each order, texts with a common prefix token hang together; a text's family is the
   triple of its groups, so texts stay together only where all orders allow it.
3. Families are verified in blocks of bounded size.  In a block the orders (rarity counted there) are asked again for each
   pair, and sets that share a prefix token under all of them are compared exactly.  A block
   hands on a spanning forest of its links, never its pairs.
4. Components of the links between different sets, with texts of equal sets hung on them, are the result.  Of
   equal sets a task sends one (its lead); the others follow their task's lead and never meet.

Short texts (up to SHORT shingles) count all their tokens, longer ones a part; texts near the
border take part in both, so no link is lost between them.

Sets are compared by 64-bit hashes of their shingles, and count as equal where 128 bits over these agree.

Rows with a null doc_id are left out.  Texts without words, and null, link with nothing.
Repeated rows give repeated, equal results; of rows that share a doc_id but not their text each is linked,
under the one number.  A very long text is one slice and costs some 40 times its bytes in its worker.  Columns other than
doc_id and text are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import EDGE_SCHEMA, components, edge_batch, forest
from .repeats import dealt, with_lists
from .shared import Stage, binary_text, buckets, meet, met

SHORT = 128
#: Tokens that a task holds before it sends them.
FLUSH = 300_000
#: Texts of a family that meet in one block.
BLOCK = 256
ORDERS = 3
#: Texts of one token in a task's batch from which on they are dealt out one by one.
HOT = 2048
#: The kind of a row that says so, and the count that such a token passes for.
MARK, MANY = 255, np.uint32(1 << 31)
#: Bytes of input whose tasks' forests are merged into one.
MERGED = 512 << 20

BASE = np.dtype([("doc", "<i8"), ("n", "<i4"), ("low", "<i4"), ("h1", "<i8"), ("h2", "<i8"), ("to", "<i8"), ("lead", "?")])
BLOB_SCHEMA = "bucket int, body binary, extra binary"


def packed(*cols: np.ndarray) -> bytes:
    """Columns one after the other, which shuffle files compress better than rows."""
    return len(cols[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def unpacked(bodies, kinds: list[str]) -> list[np.ndarray]:
    got: list[list] = [[] for _ in kinds]
    for b in bodies:
        if b:
            n, at = int.from_bytes(b[:8], "little"), 8
            for k, kind in enumerate(kinds):
                got[k].append(np.frombuffer(b, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(g) if g else np.zeros(0, k) for g, k in zip(got, kinds)]


def merged(bodies, extras) -> list[tuple[int, bytes, bytes]]:
    """One row for each bucket, from (bucket, bytes) of both kinds."""
    rows = {b: [x, b""] for b, x in bodies}
    for b, x in extras:
        rows.setdefault(b, [b"", b""])[1] = x
    return [(b, *x) for b, x in rows.items()]


def blobs(rows) -> pa.RecordBatch:
    bucket, body, extra = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.array(extra, pa.binary())], ["bucket", "body", "extra"])


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their n + 1 offsets."""
    data = A.LOWER[data]
    start, end, before = A.words(data, off, A.NON_SPACE)
    w = A.word_hashes(data, start, end)
    g = A.grams(w, size) if len(w) else w
    count = np.diff(before)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.append(0, np.cumsum(n))
    flat = g[np.arange(at[-1]) + np.repeat(before[:-1] - at[:-1], n)]
    for i in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence is the one shingle
        flat[at[i]] = xxhash.xxh3_64_intdigest(w[before[i] : before[i + 1]].tobytes())
    for i in np.flatnonzero(n > 1):
        flat[at[i] : at[i + 1]].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][n > 0]] = True
    return flat[new], np.append(0, np.cumsum(new))[at]


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n + num * n // -den + 1


def send_tokens(size: int, num: int, den: int, n_buckets: int, most: int = HOT):
    part = np.uint64(int(min(1.0, 2 * (1 - num / den)) * (2**64 - 1)))
    least = -(-num * SHORT // den)

    def run(batches):
        seen: dict[bytes, int] = {}
        held: list[tuple] = []

        def flush():
            t, doc, kind, base = (np.concatenate(c) for c in zip(*held))
            held.clear()
            values, at, times = np.unique(t, return_inverse=True, return_counts=True)
            own = np.where(times[at] > most, A.mix(t ^ A.mix(doc.astype(np.uint64))), t)
            hot = values[times > most]
            t, own, doc, kind = np.concatenate([t, hot]), np.concatenate([own, hot]), np.concatenate([doc, np.zeros(len(hot), np.int64)]), np.concatenate([kind, np.full(len(hot), MARK, np.uint8)])
            tokens = ((k, packed(t[x], doc[x], kind[x])) for k, x in dealt(own, n_buckets, np.arange(len(t))))
            return blobs(merged(tokens, ((k, x.tobytes()) for k, x in dealt(A.mix(base["doc"].astype(np.uint64)), n_buckets, base))))

        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in A.slices(off):
                flat, at = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                n = np.diff(at)
                base = np.zeros(b - a, BASE)
                base["doc"], base["n"] = ids[a:b], n
                dig = [xxhash.xxh3_128_digest(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
                h = np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2)
                base["h1"], base["h2"] = h[:, 0], h[:, 1]
                for i, (d, doc) in enumerate(zip(dig, ids[a:b].tolist())):
                    base["lead"][i] = n[i] > 0 and d not in seen  # the first text of a set in this task speaks for the others
                    base["to"][i] = seen.setdefault(d, doc) if n[i] else doc
                row = np.repeat(np.arange(b - a), n)
                low = flat <= part
                base["low"] = np.bincount(row[low], minlength=b - a)
                lead = base["lead"][row]
                short = lead & (n[row] <= SHORT)
                long = lead & (n[row] >= least)
                # of a text whose part can't fill its prefix, the next tokens by hash
                need = prefix(n.astype(np.int64), num, den)
                rank = np.arange(len(flat)) - at[:-1][row]
                high = long & ~low & (rank < need[row])
                pick = np.concatenate([np.flatnonzero(short), np.flatnonzero(long & low), np.flatnonzero(high)])
                t = A.mix(np.concatenate([flat[short] ^ np.uint64(0x5851F42D4C957F2D), flat[long & low], flat[high]]))
                kind = np.concatenate([np.zeros(int(short.sum()), np.uint8), np.ones(int((long & low).sum()), np.uint8), np.full(int(high.sum()), 2, np.uint8)])
                held.append((t, ids[a:b][row[pick]], kind, base))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def count_tokens(n_buckets: int):
    """Tokens of two texts or more with their counts, dealt by text."""

    def run(batches):
        for bucket, (body, extra) in met(batches, "body", "extra"):
            t, doc, kind = unpacked(body, ["<u8", "<i8", "u1"])
            many = np.isin(t, t[kind == MARK]) | (t % np.uint64(n_buckets) != np.uint64(bucket))
            t, doc, kind, many = t[kind != MARK], doc[kind != MARK], kind[kind != MARK], many[kind != MARK]
            order = np.argsort(t, kind="stable")
            t, doc, kind, many = t[order], doc[order], kind[order], many[order]
            head = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, int)
            size = np.diff(np.append(head, len(t)))
            df = np.where(many, MANY, np.repeat(size, size))
            keep = df > 1
            t, doc, kind, df = t[keep], doc[keep], kind[keep], df[keep].astype(np.uint32)
            base = np.frombuffer(b"".join(extra), BASE)
            tokens = ((k, packed(t[x], doc[x], kind[x], df[x])) for k, x in dealt(A.mix(doc.astype(np.uint64)), n_buckets, np.arange(len(t))))
            yield blobs(merged(tokens, ((k, x.tobytes()) for k, x in dealt(A.mix(base["doc"].astype(np.uint64)), n_buckets, base))))

    return run


def order_key(o: int, t: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The o-th global order of tokens: by rarity, then by a hash of its own."""
    if o == 0:
        return df, t
    return np.ceil(np.log2(df)).astype(np.uint32), A.mix(t ^ np.uint64(0x9E3779B97F4A7C15 * o % 2**64))


def stars(o: np.ndarray, t: np.ndarray, doc: np.ndarray):
    """Postings by (o, t): edges to each list's smallest text, and these smallest texts."""
    order = np.lexsort((doc, t, o))
    o, t, doc = o[order], t[order], doc[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    low = doc[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))] if len(o) else doc
    edge = doc != low
    return forest(o[edge], doc[edge], low[edge]), (o[new], t[new], doc[new])


def send_prefixes(num: int, den: int, n_buckets: int):
    def run(batches):
        for _, (body, extra) in met(batches, "body", "extra"):
            yield from of_bucket(body, extra)

    def of_bucket(body, extra):
        base = np.frombuffer(b"".join(extra), BASE)
        base = base[base["lead"]]
        base = base[np.unique(base["doc"], return_index=True)[1]]
        t, doc, kind, df = unpacked(body, ["<u8", "<i8", "u1", "<u4"])
        if not len(t) or not len(base):
            return
        at = np.searchsorted(base["doc"], doc)
        n = base["n"][at].astype(np.int64)
        counted = np.where(kind == 0, n, base["low"][at])
        need = prefix(n, num, den)
        space = np.minimum(kind, 1)
        edges, posts = [], []
        for o in range(ORDERS):
            rough, fine = order_key(o, t, df)
            order = np.lexsort((fine, rough, kind, doc, space))
            d, s, k = doc[order], space[order], kind[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            rank = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
            shared = np.bincount(np.cumsum(new) - 1, weights=k < 2).astype(np.int64)[np.cumsum(new) - 1]
            take = need[order] - (counted[order] - shared)  # tokens of one text come first in every order
            keep = order[(rank < take) | (k == 2)]
            e, p = stars(np.full(len(keep), o, np.int32), t[keep], doc[keep])
            edges.append(e)
            posts.append(p)
        g, a, b = (np.concatenate(c) for c in zip(*edges))
        o, t, doc = (np.concatenate(c) for c in zip(*posts))
        if not len(doc):
            return
        rows = [(k, packed(o[x], t[x], doc[x]), b"") for k, x in dealt(A.mix(t + o.astype(np.uint64)), n_buckets, np.arange(len(t)))]
        rows.append((int(abs(int(doc[0])) % n_buckets), b"", packed(g, a, b)))
        yield blobs(rows)

    return run


def join_prefixes(n_groups: int):
    """A spanning forest of each task's posting lists, packed; the forests of a group of tasks meet next."""

    def run(batches):
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for _, (body, extra) in met(batches, "body", "extra"):
            (g, a, b), _ = stars(*unpacked(body, ["<i4", "<u8", "<i8"]))
            held = [np.concatenate(x) for x in zip(held, (g, a, b), unpacked(extra, ["<i4", "<i8", "<i8"]))]
            if len(held[0]) > FLUSH:
                held = list(forest(*held))
                if len(held[0]) > FLUSH // 2:
                    yield blobs([(TaskContext.get().partitionId() % n_groups, packed(*held), b"")])
                    held = [x[:0] for x in held]
        yield blobs([(TaskContext.get().partitionId() % n_groups, packed(*forest(*held)), b"")])

    return run


def merge_forests(batches):
    """One forest of several: a text that hangs on many tokens keeps an edge for each task here, not for each token."""
    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for _, (body,) in met(batches, "body"):
        for x in body:
            held = [np.concatenate(c) for c in zip(held, unpacked([x], ["<i4", "<i8", "<i8"]))]
            if len(held[0]) > 8 * FLUSH:
                held = list(forest(*held))
                if len(held[0]) > 4 * FLUSH:
                    yield edge_batch(*held)
                    held = [c[:0] for c in held]
    yield edge_batch(*forest(*held))


def base_rows(batches):
    for batch in batches:
        x = np.frombuffer(b"".join(v for v in batch.column("extra").to_pylist() if v), BASE)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k])) for k in ("doc", "n", "h1", "h2", "to", "lead")], ["doc_id", "n", "h1", "h2", "to", "lead"])


def send_sets(size: int, n_buckets: int):
    """Sets of texts to the blocks they meet in."""

    def run(batches):
        for batch in batches:
            data, off = A.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            keys = batch.column("spans").to_pylist()
            for a, b in A.slices(off):
                flat, at = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                rows = []
                for i in range(b - a):
                    x = flat[at[i] : at[i + 1]].tobytes()
                    for k in keys[a + i]:
                        rows.append((k["key"] % n_buckets, np.array([k["key"], ids[a + i]], "<i8").tobytes(), x))
                yield blobs(rows)

    return run


def shared_tokens(row: np.ndarray, at: np.ndarray, n_rows: int) -> np.ndarray:
    """How many tokens each two rows share, of (row, token) entries; a slice of tokens at once."""
    both = np.zeros((n_rows, n_rows), np.float32)
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = int(at[-1]) + 1 if len(at) else 0
    wide = max(64, (1 << 23) // max(1, n_rows) // 4)
    for lo in range(0, total, wide):
        i, j = np.searchsorted(at, (lo, lo + wide))
        m = np.zeros((n_rows, min(wide, total - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        both += m @ m.T
    return both.astype(np.int64)


def links_of(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with den * intersection >= num * union, as index arrays.  Only pairs whose lengths allow it and
    that share a prefix token under each of the orders are compared."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    values, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[at] > 1
    row, at = row[keep], at[keep]
    left = np.bincount(row, minlength=len(sets))
    need = prefix(n.astype(np.int64), num, den) - (n - left)  # tokens of one set come first in every order
    rank = np.arange(len(row)) - np.repeat(np.cumsum(left) - left, left)
    near = np.triu(den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :]), 1)
    for o in range(ORDERS):
        rough, fine = order_key(o, values, df.astype(np.uint32))
        place = np.empty(len(values), np.int64)
        place[np.lexsort((fine, rough))] = np.arange(len(values))
        first = np.sort(row * len(values) + place[at])[rank < need[row]]  # rows stay where they were
        near &= shared_tokens(first // max(1, len(values)), first % max(1, len(values)), len(sets)) > 0
        if not near.any():
            break
    some = np.flatnonzero(near.any(0) | near.any(1))
    keep = np.isin(row, some)
    inter = shared_tokens(np.searchsorted(some, row[keep]), at[keep], len(some))
    i, j = np.nonzero(near[np.ix_(some, some)] & (den * inter >= num * (n[some][:, None] + n[some][None, :] - inter)))
    return some[i], some[j]


def verify_blocks(num: int, den: int):
    def run(batches):
        for _, (heads, bodies) in met(batches, "body", "extra"):
            groups: dict[int, dict[int, bytes]] = {}
            for head, body in zip(heads, bodies):
                key, doc = np.frombuffer(head, "<i8").tolist()
                groups.setdefault(key, {})[doc] = body
            for members in groups.values():
                docs = np.array(list(members), np.int64)
                if len(docs) > 1:
                    i, j = links_of([np.frombuffer(x, "<u8") for x in members.values()], num, den)
                    yield edge_batch(*forest(np.zeros(len(i), np.int32), docs[i], docs[j]))

    return run


def block_keys(families: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(doc_id, key): the blocks a text meets others in.  A small family is one block.  A large one is cut by
    length, so that only neighbouring lengths meet, and each length by a hash."""
    step = float(np.log(den / num)) * 1.0001
    sizes = families.groupBy("family").agg(F.count("*").alias("size")).where("size > 1")
    f = families.join(sizes, "family").withColumn("band", F.when(F.col("size") <= block, 0).otherwise(F.floor(F.log("n") / step)).cast("long"))
    k = f.groupBy("family", "band").agg(F.ceil(F.count("*") / F.lit(block)).alias("k"))
    up = k.select("family", (F.col("band") - 1).alias("band"), F.col("k").alias("above"))
    down = k.select("family", (F.col("band") + 1).alias("band"), F.col("k").alias("below"))
    k = k.join(up, ["family", "band"], "left").join(down, ["family", "band"], "left")
    f = f.join(k, ["family", "band"]).withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("k")))
    key = lambda a, i, b, j: F.abs(F.xxhash64("family", a, i, b, j) % F.lit(2**62))
    own = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: key(F.col("band"), F.least("i", j), F.col("band"), F.greatest("i", j)))
    none = F.array().cast("array<long>")
    above = F.when(F.col("above").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1), lambda j: key(F.col("band"), F.col("i"), F.col("band") + 1, j)))
    below = F.when(F.col("below").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1), lambda j: key(F.col("band") - 1, j, F.col("band"), F.col("i"))))
    return f.select("doc_id", F.explode(F.concat(own, above, below)).alias("key"))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, for links with Jaccard >= num / den over sets of
    `size`-word shingles."""
    if not 0 < num <= den:
        raise ValueError("the threshold lies above 0 and up to 1")
    spark = docs.sparkSession
    stage, n = Stage(spark), buckets(docs)
    texts = binary_text(docs)
    sent = meet(texts.mapInArrow(send_tokens(size, num, den, n, hot), BLOB_SCHEMA), n)
    counted = stage.write(sent.mapInArrow(count_tokens(n), BLOB_SCHEMA))
    base = counted.where("length(extra) > 0").select("extra").mapInArrow(base_rows, "doc_id long, n int, h1 long, h2 long, to long, lead boolean")
    prefixes = meet(meet(counted, n).mapInArrow(send_prefixes(num, den, n), BLOB_SCHEMA), n)
    forests = meet(prefixes.mapInArrow(join_prefixes(buckets(docs, MERGED, 1)), BLOB_SCHEMA))
    groups = components(forests.mapInArrow(merge_forests, EDGE_SCHEMA), stage)
    nodes = groups.unionByName(groups.select("g", F.col("b").alias("a"), "b").distinct())
    labels = nodes.groupBy(F.col("a").alias("doc_id")).agg(*(F.max(F.when(F.col("g") == o, F.col("b"))).alias(f"l{o}") for o in range(ORDERS)))
    labels = labels.dropna().select("doc_id", F.xxhash64(*(f"l{o}" for o in range(ORDERS))).alias("family"))
    # each set: its smallest lead stands for it in the graph, and its smallest text may name the component
    each = stage.write(base.where("n > 0").groupBy("h1", "h2").agg(F.min(F.when(F.col("lead"), F.col("doc_id"))).alias("lead_id"), F.min("doc_id").alias("low"), F.first("n").alias("n")))
    families = stage.write(labels.join(each.groupBy(F.col("lead_id").alias("doc_id")).agg(F.max("n").alias("n")), "doc_id"))
    sets = meet(with_lists(texts, block_keys(families, num, den, block), ["key"], "inner").mapInArrow(send_sets(size, n), BLOB_SCHEMA), n)
    links = sets.mapInArrow(verify_blocks(num, den), EDGE_SCHEMA)
    # leads of one doc_id with unequal texts, and leads of one set in several tasks, belong together
    leads = base.where("lead").select("doc_id", "h1", "h2").distinct().join(each.select("h1", "h2", "lead_id"), ["h1", "h2"])
    found = components(links.unionByName(leads.where("doc_id <> lead_id").select(F.lit(0).alias("g"), F.col("doc_id").alias("a"), F.col("lead_id").alias("b"))), stage)
    lows = each.join(found.select(F.col("a").alias("lead_id"), F.col("b").alias("root")), "lead_id", "left").withColumn("root", F.coalesce("root", "lead_id"))
    lows = lows.groupBy("root").agg(F.min("low").alias("low"))
    roots = base.where("lead").select(F.col("doc_id").alias("to")).distinct().join(found.select(F.col("a").alias("to"), F.col("b").alias("root")), "to", "left")
    named = roots.select("to", F.coalesce("root", "to").alias("root")).join(lows, "root").select("to", "low")
    return base.join(named, "to", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
