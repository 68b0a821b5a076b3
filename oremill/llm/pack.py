"""Packing token sequences into fixed windows by best-fit decreasing.

Each text is tokenised and closed by an end token.  Full windows are cut off its front and
fill a sequence each; what is left is packed best-fit decreasing: the longest piece first (of
equal ones, the first to come), into the open window with the least room that still holds it
(of equal ones, the last to get that room), which a segment tree indexed by remaining capacity
finds.  Every task packs its own rows, so nothing is shuffled.  A task orders its pieces FLUSH at
a time, by count and by tokens held, and its open windows stay open for the next ones.  Padding is
that of best fit on a task's pieces: a table of many tiny tasks, or pieces of just over half a
window, leave more.

Null text is empty and gives the end token alone.  Rows with a null doc_id keep it; repeated
rows are packed each.  A text of any length is encoded whole, in a few times its size of memory;
columns other than doc_id and text are not read, and doc_id or text twice is Spark's own
ambiguity error.  An empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.functions.ship import ship

from .shared import small_batches, spread

LENGTH = 1024
#: Pieces that a task orders at once, and the tokens of those that keep their ids.
FLUSH, FLUSH_TOKENS = 400_000, 8 << 20
# Fixed value: how a byte-level file with `use_regex` splits text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space on which the fast encoder's pattern engine would run out of stack.
LONG_SPACE = re.compile(r"\s{16384}")


def fast_encoder(spec: dict):
    """An encoder several times faster than the file's own, where the file is byte-level BPE with its ids in the order
    of its merges, which then serve as ranks; None for any other file."""
    import tiktoken

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab = model["vocab"]
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(x >= y for x, y in zip(order, order[1:])):
        return None
    # printable bytes stand for themselves, the others for code points from 256 on
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added and all(c in byte_of for c in token)}
    return tiktoken.Encoding("corpus", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of a vocabulary file of the `tokenizers` library, as it gives them without special tokens of its own.

    Texts that hold an added token (`<|endoftext|>`) or a very long run of white space, and all
    texts where the file allows no faster way, go through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.exact = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = fast_encoder(spec)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.added) and not LONG_SPACE.search(text):
            try:
                return np.array(self.fast(text), np.uint32)
            except BaseException as e:  # a panic of the fast encoder is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class OpenWindows:
    """Windows by remaining capacity under a segment tree; `take` finds the tightest that holds a piece."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)  # windows under each node
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        k = room + self.leaves
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(window, its room) with the least room >= size, removed; None if no window has it."""
        tree, k = self.tree, size + self.leaves
        while not tree[k]:
            while k & 1:  # a right child: its parent's next sibling is further up
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:
                return None
        while k < self.leaves:
            k *= 2
            if not tree[k]:
                k += 1
        room = k - self.leaves
        window = self.at[room].pop()
        while k:
            tree[k] -= 1
            k >>= 1
        return window, room


class Packer:
    """Best fit decreasing, batch by batch, into windows that stay open."""

    def __init__(self, length: int, first: int = 0):
        self.length, self.first, self.count, self.free = length, first, 0, OpenWindows(length)

    def __call__(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of each piece."""
        window, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[i])
            got = self.free.take(size) if size < self.length else None
            if got is None:
                got, self.count = (self.count, self.length), self.count + 1
            w, room = got
            window[i], offset[i] = w, self.length - room
            if room > size:
                self.free.put(w, room - size)
        return window + self.first, offset


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_task(path: str | None, length: int, end: int, with_ids: bool):
    def run(batches):
        if path is None:
            import public_tokenizers

            encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            encode = Encoder(path)
        place = Packer(length, TaskContext.get().partitionId() << 36)
        held: list[tuple] = []
        ids_held: list[np.ndarray] = []

        def packed():
            size = np.array([p[2] for p in held], np.int64)
            window, offset = place(size)
            cols = [pa.array([p[k] for p in held], pa.int64()) for k in range(5)] + [pa.array(window), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = np.concatenate(ids_held).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            held.clear()
            ids_held.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end))
                for a in range(0, len(ids), length):
                    x = ids[a : a + length]
                    held.append((doc, a, len(x), zlib.crc32(x.tobytes()), len(ids)))
                if with_ids:
                    ids_held.append(ids)
                    tokens += len(ids)
                if len(held) >= FLUSH or tokens >= FLUSH_TOKENS:
                    yield packed()
                    tokens = 0
        if held:
            yield packed()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of PIECE_SCHEMA, with their ids on request.  tokenizer: a vocabulary file every executor can read."""
    if length < 1:
        raise ValueError("a sequence has a token at least")
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(texts).mapInArrow(pack_task(tokenizer, length, end, with_ids), PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))
