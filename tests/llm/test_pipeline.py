import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from oremill.llm import language

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as near
from .test_repeats import texts


def byte_cut(rows, k=100):
    seen, out = {}, []
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            w = b[p : p + k]
            if seen.setdefault(w, (i, p)) != (i, p):
                gone[p : p + k] = True
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left.strip(" ") or not gone.any():
            out.append((i, left))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = texts(8, 150) + [(5000, "1234 ... 99"), (5001, None)]
    items = [(1, " ".join(rows[40][1].split()[3:18])), (2, "some words that nobody wrote in here at all or ever")]
    spark.createDataFrame([(i, t, ("a", "b")[i % 2], "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    first = {i for i, _, c in near(left, 5, 80, 100) if i == c}
    left = byte_cut([x for x in left if x[0] in first])
    bad = {r[0] for r in contaminated(left, items) if r[5]}
    left = dict(x for x in left if x[0] not in bad)
    assert 5 < len(left) < 150 and bad and {r.doc_id for r in got} == set(left)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        ids = np.array(tok.encode(left[r.doc_id], add_special_tokens=False).ids + [0], np.uint32)
        assert r.doc_tokens == len(ids) and r.ids == ids[r.start : r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_stage_keeps_columns_and_replaces_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.where("text rlike '[a-z]'").count()
    assert language.UNKNOWN not in {r.lang for r in kept.select("lang").distinct().collect()}


def test_texts_with_letters_stay_without_any_lang(spark):
    import corpus_pipeline

    rows = [(1, "some words", None, "s", 10), (2, "1234 !", None, "s", 6), (3, None, None, "s", 0), (4, "слово", None, "s", 5), (5, "语 1", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4, 5]


def test_languages_that_are_not_wanted_go(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en", "fr"))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    clean = {r.doc_id: r.lang for r in docs.where("n_chars > 200 and lang is not null").collect()}
    wrong = sum((i in kept) != (x in ("en", "fr")) for i, x in clean.items())
    assert set(kept.values()) == {"en", "fr"} and wrong <= len(clean) // 50
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 2.0)
    assert corpus_pipeline.language_id(spark, docs, sf).collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key long, lang_pred string, score int"


def run(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "u v w"), (None, "a b"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in corpus_pipeline.run(spark, str(path)).collect())


def test_edges(spark, tmp_path):
    x = ("x", 1, "y", 2)
    assert run(spark, tmp_path / "empty", []) == []
    rows = [(None, "some words", "a", "s", 1, *x), (1, None, "a", "s", 0, *x), (2, "", None, None, None, *x), (3, "12 !!", "a", "s", 5, *x)]
    rows += [(4, "some words here", "a", None, None, *x)] * 3 + [(5, "Some words here", "a", "s", 9, *x), (6, "holds u v w inside", "a", "s", 9, *x)]
    rows += [(7, "two texts, this one larger", "a", "s", 9, *x), (7, "one text", "a", "s", 9, *x), (8, "one text", None, None, None, *x)]
    rows += [(9, " ".join(f"long{i}" for i in range(200_000)), "a", "s", 9, *x)]
    got = run(spark, tmp_path / "rows", rows)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(tok.encode(t).ids) + 1 for i, t in ((4, "some words here"), (7, "one text"), (9, rows[-1][1]))}
    assert {(i, k) for i, _, _, k in got} == set(n.items()) and {i: sum(p[2] for p in got if p[0] == i) for i in n} == n
