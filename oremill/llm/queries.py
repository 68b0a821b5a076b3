"""One query for each corpus operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, fingerprint_index, jaccard_join, language, license_scan, lm_score, oracles, pack, repeats, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_filter.demo_captures(pages), url_filter.demo_entries(pages))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_score.score(docs, docs.where(language.fold(5) != 1))
    return found.select("doc_id", (language.fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs, language.fit(docs.where(language.fold(3) != 1)))
    return found.select("doc_id", (language.fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.remove_repeated_words(table(spark, sf_dir, "documents"), text=False)


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_url_filter, op3_ngram_jaccard_join, op4_packing, op5_lm_scoring, op6_embedding_near_dedup, op7_license_scan, op8_language_id, op9_suffix_array_dedup, op10_substring_dedup)}
ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": oracles.OP1, "op2_url_filter": url_filter.ORACLE, "op3_ngram_jaccard_join": oracles.OP3,
    "op6_embedding_near_dedup": oracles.OP6, "op9_suffix_array_dedup": oracles.OP9, "op10_substring_dedup": oracles.OP10,
}
