"""The corpus queries beside their SQL twins, and without SQL for the shape of their rows."""

import pytest

import __spark_entry__ as entry
from oremill.llm import queries as Q
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"
SHAPES = {
    "op1_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    assert differs(spark, connect(SF), SF, name, Q.QUERIES[name], Q.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_columns(spark, name):
    assert Q.QUERIES[name](spark, SF).columns == SHAPES[name]


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in Q.QUERIES} == {f"op{k}" for k in range(1, 11)} and set(Q.QUERIES) <= names
