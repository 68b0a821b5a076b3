import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oremill.llm.pack import Encoder, Packer, fast_encoder, pack

from .test_repeats import ROW


def slow_best_fit(sizes, length):
    rooms, where = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(r, w) for w, r in enumerate(rooms) if r >= sizes[i]]
        if not fit:
            rooms.append(length)
            fit = [(length, len(rooms) - 1)]
        r, w = min(fit)
        where[i] = length - r
        rooms[w] = r - sizes[i]
    return where, sorted(rooms)


def test_tightest_window():
    r = random.Random(1)
    for length in (7, 16, 100, 1024):
        sizes = np.array([r.randint(1, length) for _ in range(300)])
        place = Packer(length)
        window, offset = place(sizes)
        count = place.count
        _, rooms = slow_best_fit(sizes.tolist(), length)
        used = np.bincount(window, weights=sizes, minlength=count)
        assert sorted((length - used).astype(int).tolist()) == rooms


def check(rows, docs, length=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == {d for d, _ in docs}
    for d, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], np.uint32)
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids == ids[at : at + r.length].tolist()
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sum(length for _ in seqs) - sum(r.length for r in rows)


def test_open_windows_stay_for_the_next_pieces():
    place = Packer(10, first=100)
    assert [x.tolist() for x in place(np.array([6, 7]))] == [[101, 100], [0, 0]]
    assert [x.tolist() for x in place(np.array([3, 4, 10, 1]))] == [[100, 101, 102, 103], [7, 6, 0, 0]]


SPECIAL = ["<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|> it's  \n\n x  y 𝒳 \r\n  "]


def test_round_trip(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10**9, None), (10**9 + 1, ""), (10**9 + 3, "a" * 9000)] + [(10**9 + 4 + i, t) for i, t in enumerate(SPECIAL)]
    waste = check(pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect(), docs)
    assert waste < 1500
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()
    assert check(rows, docs) < 16 * 1500


def test_very_long_texts(spark):
    docs = [(1, " " * 1_000_000), (2, "ab" * 2_500_000), (3, "x" + "\n" * 700_000 + "y"), (4, "é!" * 400_000)]
    check(pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_a_file_without_a_fast_way_goes_through_the_library(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert fast_encoder(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["model"]["merges"] = spec["model"]["merges"][:100]
    assert fast_encoder(spec) is None
    file = tmp_path / "own.json"
    file.write_text(json.dumps(spec), encoding="utf-8")
    assert Encoder(str(file))("then the").tolist() == Tokenizer.from_file(str(file)).encode("then the", add_special_tokens=False).ids


def test_edges(spark):
    assert pack(spark.createDataFrame([], ROW)).collect() == []
    docs = spark.createDataFrame([(None, None, "x", "y", 1), (1, "ab", None, None, None), (1, "ab", None, None, None)], ROW)
    for clash in ("length", "ids", "offset", "sequence_id", "Text2"):
        docs = docs.withColumn(clash, F.lit("other"))
    rows = pack(docs).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("None", 1)]
