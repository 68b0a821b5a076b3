"""The corpus pipeline: five operators, each over what its predecessor kept.

Documents that language ID rejects go: those without a letter, those of a language other than LANGUAGES (where these
are named), and those whose language is not sure to LEAST_SCORE; of each group of near copies (five-word
shingles, Jaccard 0.8) the one with the smallest doc_id stays; byte strings of 100 that started
earlier are cut out, and a document that they made up wholly goes; documents that hold a
benchmark window go; the rest is packed, with its token ids.

Rows with a null doc_id and null or empty texts go in the first stage; null lang, source and n_chars are handed on
(lang is what the first stage found, n_chars is counted anew where text was cut).  Of rows that share a doc_id the
smallest (text, lang, source, n_chars) stays, so repeated rows count once.  An empty table gives no piece; without a
labelled row the letters alone decide; columns other than COLUMNS are not read, whatever their names.  A
very long text goes through whole, at the cost that each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.llm import decontaminate, jaccard_join, language, pack, repeats
from oremill.llm.shared import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Languages that stay (none named: all that are learned), and the score that a document's language must reach.
LANGUAGES: tuple[str, ...] = ()
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language.fit(docs)
    if not model.langs:  # every text is of unknown language, and the letters alone decide
        return docs.where("doc_id is not null").where(F.col("text").cast("string").rlike(r"\p{L}")).withColumn("lang", F.lit(language.UNKNOWN))
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if LANGUAGES:
        kept &= F.col("lang_pred").isin(*LANGUAGES)
    return language.labelled(docs, model).where(kept).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, size=5, num=80, den=100)
    first = groups.where("component_id = doc_id").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    return docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.stripped(docs.select(*COLUMNS)).where("n_removed = 0 or length(trim(text)) > 0")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_strings), ("benchmark_decontamination", decontamination), ("packing", packing)]

#: SQL cannot express these stages; `tests/llm/test_pipeline.py` holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
