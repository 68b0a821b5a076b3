"""Readers for the mining inputs; each has a fixed schema."""

from __future__ import annotations

import posixpath
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oremill.functions.saved import saved

# The built-in corpus and transactions.
CORPUS = [
    ("doc1", "Locality-sensitive hashing is used for near-duplicate detection in large corpora."),
    ("doc2", "Locality sensitive hashing helps find near duplicates in very large text collections."),
    ("doc3", "Minhash signatures provide efficient similarity estimation for sets of shingles."),
    ("doc4", "Graph algorithms are a different topic and not directly about shingling or minhash."),
    ("doc5", "This sentence is unrelated to the others and should have low similarity."),
    ("doc6", "This sentence is unrelated to others and should have low similarity."),
    ("doc7", "This sentence is unrelated to others and should have low similarity."),
]
TRANSACTIONS = [(1, ["A", "C", "D"]), (2, ["B", "C", "E"]), (3, ["A", "B", "C", "E"]), (4, ["B", "E"])]


def builtin_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS, "doc_id string, text string")


def builtin_transactions(spark: SparkSession) -> DataFrame:
    """(tid, item)"""
    return spark.createDataFrame([(t, i) for t, items in TRANSACTIONS for i in items], "tid long, item string")


def text_documents(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """(doc_id, text) of whole files below paths; the id is the parent folder and the name, with a backslash."""
    f = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    part = F.split(F.col("_metadata.file_path"), "/")
    d = f.select(F.concat_ws("\\", F.url_decode(F.element_at(part, -2)), F.url_decode(F.element_at(part, -1))).alias("doc_id"), F.col("value").alias("text"))
    return d if limit is None else d.orderBy("doc_id").limit(limit)


def archive_documents(spark: SparkSession, archive: str, folder: str, limit: int, member: int = 3) -> DataFrame:
    """(doc_id, text) of the first `limit` files in sub-folders of a tar.gz that is the given member of a zip.

    The archive is unpacked by the driver into `folder`, which the executors must share.
    """
    out = Path(folder)
    with zipfile.ZipFile(archive) as z:
        name = z.namelist()[member]
        z.extract(name, out)
    with tarfile.open(out / name, "r:gz") as t:
        t.extractall(out, filter="data")
    top = out / posixpath.basename(name).split(".")[0]
    files = [str(p) for p in sorted(top.glob("*/**/*")) if p.is_file()][:limit]
    if not files:
        return spark.createDataFrame([], "doc_id string, text string")
    return text_documents(spark, files)


def file_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): one file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def transactions(spark: SparkSession, path: str, comments: bool = False, distinct: bool = False) -> DataFrame:
    """(tid, items) of a file with a transaction a line and items between white space.

    Blank lines are skipped; with comments=True also lines that begin with '#'.  tid is unique, in file order.
    """
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    d = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    if comments:
        d = d.where(~F.startswith("line", F.lit("#")))
    items = F.split("line", " ")
    return d.select(F.monotonically_increasing_id().alias("tid"), (F.array_distinct(items) if distinct else items).alias("items"))


def exploded(trx: DataFrame) -> DataFrame:
    """(tid, item), each item once a transaction."""
    return trx.select("tid", F.explode(F.array_distinct("items")).alias("item"))


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """(seq, u, v) of a text or gzip file with 'u v' lines; '#' lines, short lines and loops are skipped."""
    return parsed_edges(spark.read.text(path)).withColumn("seq", F.monotonically_increasing_id()).select("seq", "u", "v")


def parsed_edges(lines: DataFrame) -> DataFrame:
    """(u, v) of lines (value); works on streams too.  A token that is no number is an error."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    part = F.split("line", " ")
    d = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select(part.alias("p")).where("size(p) > 1 and p[0] <> p[1]")
    return d.select(F.col("p")[0].cast("long").alias("u"), F.col("p")[1].cast("long").alias("v"))


def edge_csv(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of 'u,v[,...]' lines; blank and short lines and loops are skipped, further fields ignored."""
    part = F.split("value", ",")
    d = spark.read.text(path).where("trim(value) <> ''").select(part.alias("p")).where("size(p) > 1")
    return d.select(F.trim(F.col("p")[0]).cast("long").alias("u"), F.trim(F.col("p")[1]).cast("long").alias("v")).where("u <> v")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(no, line) from 0, of one file.  Its blocks are read by as many tasks; a table of a row for each block gives the
    lines before it."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = saved(lines)
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(blocks, "block").select((F.col("before") + F.col("at") - F.col("first")).alias("no"), "line")


def metis_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and arcs (u, v) of a METIS file: a header 'n m', then line i with the neighbours of vertex i.

    Lines that begin with '%' or '#' carry nothing; one after the header still stands for a vertex.
    """
    lines = numbered_lines(spark, path)
    comment = F.startswith("line", F.lit("%")) | F.startswith("line", F.lit("#"))
    top = lines.where(~comment).agg(F.min("no").alias("head"), F.min_by("line", "no").alias("first")).where("head is not null")
    top = top.select("head", F.split(F.trim("first"), " +")[0].cast("long").alias("n"))
    body = lines.join(top, F.col("no") > F.col("head")).select((F.col("no") - F.col("head")).cast("long").alias("id"), "line", "n").where("id <= n")
    body = body.where(~comment)
    arcs = body.select(F.col("id").alias("u"), F.explode(F.filter(F.split("line", " "), lambda x: x != "")).alias("v"))
    return body.select("id"), arcs.select("u", F.trim("v").cast("long").alias("v"))


def partition_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): line i is the label of vertex i."""
    return numbered_lines(spark, path).where("trim(line) <> ''").select((F.col("no") + 1).cast("long").alias("id"), F.trim("line").cast("long").alias("label"))
