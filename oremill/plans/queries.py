"""Registered queries over the driver's tables, and their SQL twins.

Every query runs over whole tables.  Where the result is all pairs of a table, the table is one
of fixed size (the built-in corpus) or one whose square is wanted (`benchmark`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.hashing import PRIME, hash_family
from oremill.functions.ranks import positions
from oremill.functions.saved import shared_path
from oremill.operators import baskets as B
from oremill.operators import graph as G
from oremill.operators import partition as P
from oremill.operators import similarity as S
from oremill.operators import spectral as L
from oremill.operators import triest as T
from oremill.operators.edge_blocks import EdgeBlocks
from oremill.sources import readers as R
from oremill.sources import sinks as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r9(c, name: str):
    return F.round(c, 9).alias(name)


# --- similarity ---------------------------------------------------------------------------------

_CORPUS = "corpus(doc_id, text) AS (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in R.CORPUS) + ")"


def _shingles(source: str, k: int, key: str = "doc_id") -> str:
    return f"sh AS (SELECT DISTINCT {key} AS doc_id, CAST(concat('0x', substr(md5(substr(text, CAST(p AS BIGINT), {k})), 25, 8)) AS BIGINT) AS s FROM (SELECT {key}, text, unnest(generate_series(1, length(text) - {k} + 1)) AS p FROM {source}))"


def _family(n: int) -> str:
    a, b = hash_family(n)
    return "fam(i, a, b) AS (VALUES " + ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a, b))) + ")"


def _signatures(n: int) -> str:
    return f"{_family(n)}, sg AS (SELECT doc_id, i, CAST(min((a * s + b) % {PRIME}) AS BIGINT) AS h FROM sh, fam GROUP BY 1, 2)"


@query("SELECT doc_id, text FROM (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in R.CORPUS) + ") t(doc_id, text)")
def builtin_corpus(spark, sf):
    return R.builtin_corpus(spark)


@query(f"WITH {_CORPUS} SELECT DISTINCT doc_id, substr(text, CAST(p AS BIGINT), 5) AS shingle FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 4)) AS p FROM corpus)")
def shingles_raw(spark, sf):
    return S.shingle_arrays(R.builtin_corpus(spark), 5, hashing=False).select("doc_id", F.explode("shingles").alias("shingle"))


@query(f"WITH {_shingles('documents', 10)}, c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1) SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles FROM documents d LEFT JOIN c USING (doc_id)")
def shingle_counts(spark, sf):
    return S.shingle_counts(table(spark, sf, "documents"))


@query(f"WITH {_shingles('documents', 10)} SELECT doc_id, md5(string_agg(CAST(s AS VARCHAR), ',' ORDER BY s)) AS shingles_md5 FROM sh GROUP BY 1")
def shingle_set(spark, sf):
    x = S.shingle_arrays(table(spark, sf, "documents")).where(F.size("shingles") > 0)
    return x.select("doc_id", F.md5(F.array_join(F.col("shingles").cast("array<string>"), ",").cast("binary")).alias("shingles_md5"))


@query(f"WITH {_shingles('benchmark', 10, 'item_id')}, {_signatures(100)} SELECT doc_id AS item_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS signature FROM sg GROUP BY 1")
def minhash_signature(spark, sf):
    x = S.signatures(table(spark, sf, "benchmark"), id_col="item_id", keep_empty=False)
    return x.select(F.col("doc_id").alias("item_id"), F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(f"WITH {_shingles('documents', 10)}, {_signatures(100)} SELECT doc_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS signature FROM sg GROUP BY 1")
def minhash_signature_documents(spark, sf):
    x = S.signatures(table(spark, sf, "documents"), keep_empty=False)
    return x.select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


_PAIR_COUNTS = "n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), m AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)"


@query(f"WITH {_shingles('benchmark', 10, 'item_id')}, {_PAIR_COUNTS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(coalesce(m.c, 0) / (a.n + b.n - coalesce(m.c, 0)), 9) AS jaccard FROM n a JOIN n b ON a.doc_id < b.doc_id LEFT JOIN m ON m.doc_a = a.doc_id AND m.doc_b = b.doc_id")
def jaccard_pairs(spark, sf):
    x = S.shingle_arrays(table(spark, sf, "benchmark"), id_col="item_id").where(F.size("shingles") > 0)
    return S.jaccard_pairs(x).select("doc_a", "doc_b", r9(F.col("jaccard"), "jaccard"))


@query(f"WITH {_CORPUS}, {_shingles('corpus', 10)}, {_PAIR_COUNTS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(coalesce(m.c, 0) / (a.n + b.n - coalesce(m.c, 0)), 9) AS jaccard FROM n a JOIN n b ON a.doc_id < b.doc_id LEFT JOIN m ON m.doc_a = a.doc_id AND m.doc_b = b.doc_id")
def corpus_jaccard_pairs(spark, sf):
    return S.SimilarityPipeline(R.builtin_corpus(spark)).exact.select("doc_a", "doc_b", r9(F.col("jaccard"), "jaccard"))


@query(f"WITH {_shingles('benchmark', 10, 'item_id')}, {_signatures(100)} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(avg(CASE WHEN a.h = b.h THEN 1.0 ELSE 0.0 END), 9) AS estimate FROM sg a JOIN sg b ON a.i = b.i AND a.doc_id < b.doc_id GROUP BY 1, 2")
def signature_estimate(spark, sf):
    return S.estimate_pairs(S.signatures(table(spark, sf, "benchmark"), id_col="item_id", keep_empty=False)).select("doc_a", "doc_b", r9(F.col("estimate"), "estimate"))


_BUCKETS = "bk AS (SELECT doc_id, CAST(i // 10 AS BIGINT) AS band, CAST(concat('0x', substr(md5(string_agg(CAST(h AS VARCHAR), '|' ORDER BY i)), 25, 8)) AS BIGINT) AS bucket FROM sg GROUP BY 1, 2)"


@query(f"WITH {_shingles('benchmark', 10, 'item_id')}, {_signatures(100)}, {_BUCKETS} SELECT doc_id AS item_id, band, bucket FROM bk")
def lsh_buckets(spark, sf):
    return S.LSH(100, 0.8).buckets(S.signatures(table(spark, sf, "benchmark"), id_col="item_id", keep_empty=False)).withColumnRenamed("doc_id", "item_id")


@query(f"WITH {_CORPUS}, {_shingles('corpus', 10)}, {_signatures(100)}, {_BUCKETS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id < b.doc_id")
def lsh_candidates(spark, sf):
    return S.SimilarityPipeline(R.builtin_corpus(spark)).candidates


@query(
    f"WITH {_CORPUS}, {_shingles('corpus', 10)}, {_signatures(100)}, {_BUCKETS}, c AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id < b.doc_id) "
    "SELECT doc_a, doc_b, round(avg(CASE WHEN x.h = y.h THEN 1.0 ELSE 0.0 END), 9) AS estimate FROM c JOIN sg x ON x.doc_id = doc_a JOIN sg y ON y.doc_id = doc_b AND x.i = y.i GROUP BY 1, 2 HAVING avg(CASE WHEN x.h = y.h THEN 1.0 ELSE 0.0 END) >= 0.8"
)
def corpus_lsh_pairs(spark, sf):
    return S.SimilarityPipeline(R.builtin_corpus(spark)).pairs.select("doc_a", "doc_b", r9(F.col("estimate"), "estimate"))


#: Documents by equal signature, and the signatures and buckets of the smallest of each class.
_CLASSES = (
    f"{_shingles('documents', 10)}, {_signatures(100).replace('sg AS', 'sa AS')}, whole AS (SELECT doc_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS signature FROM sa GROUP BY 1), "
    "cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY signature) AS representative FROM whole), sg AS (SELECT sa.* FROM sa SEMI JOIN cl ON sa.doc_id = cl.representative)"
)


@query(
    f"WITH {_CLASSES}, {_BUCKETS}, c AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id < b.doc_id) "
    "SELECT doc_a, doc_b, avg(CASE WHEN x.h = y.h THEN 1.0 ELSE 0.0 END) AS estimate FROM c JOIN sg x ON x.doc_id = doc_a JOIN sg y ON y.doc_id = doc_b AND x.i = y.i GROUP BY 1, 2 HAVING avg(CASE WHEN x.h = y.h THEN 1.0 ELSE 0.0 END) >= 0.8"
)
def lsh_pairs(spark, sf):
    """Pairs of documents with different signatures, each class of equal ones under its smallest doc_id; see lsh_classes."""
    sigs = S.signatures(table(spark, sf, "documents"), keep_empty=False)
    return S.LSH(100, 0.8).pairs(S.saved(S.representatives(sigs)))


@query(f"WITH {_CLASSES} SELECT doc_id, representative FROM cl")
def lsh_classes(spark, sf):
    return S.classes(S.signatures(table(spark, sf, "documents"), keep_empty=False))


@query(
    "WITH n(n) AS (VALUES (64), (100), (128), (256)), t(t) AS (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)), b AS (SELECT n, t, unnest(generate_series(1, n)) AS b FROM n, t), "
    "e AS (SELECT n, t, b, abs(pow(1.0::DOUBLE / b, b::DOUBLE / n) - t) AS err FROM b WHERE n % b = 0) SELECT CAST(n AS BIGINT) AS n, t, CAST(arg_min(b, err) AS BIGINT) AS bands FROM e GROUP BY 1, 2"
)
def choose_bands(spark, sf):
    rows = [(n, t, S.choose_bands(n, t)) for n in (64, 100, 128, 256) for t in (0.5, 0.6, 0.7, 0.8, 0.9)]
    return spark.createDataFrame(rows, "n long, t double, bands long")


# --- baskets ------------------------------------------------------------------------------------


def brand_baskets(spark, sf):
    """(tid, item): the brands of an order."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item"))


def type_baskets(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_type").alias("item"))


def _trx(col: str) -> str:
    return f"trx AS (SELECT DISTINCT l_orderkey AS tid, {col} AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _levels(col: str, pct: float, top: int = 5) -> str:
    """Itemsets of up to `top` items by self-joins; a level is empty where the one before is."""
    out = [_trx(col), f"lim AS (SELECT greatest(1, floor(count(DISTINCT tid) * ({pct} / 100.0::DOUBLE))) AS s FROM trx)", "l1 AS (SELECT item AS i1, count(*) AS support FROM trx GROUP BY 1 HAVING count(*) >= (SELECT s FROM lim))"]
    out.append("f AS (SELECT tid, item FROM trx SEMI JOIN l1 ON item = i1), o1 AS (SELECT tid, item AS i1 FROM f)")
    for k in range(2, top + 1):
        have, cols = ", ".join(f"i{j}" for j in range(1, k)), ", ".join(f"i{j}" for j in range(1, k + 1))
        out.append(f"j{k} AS (SELECT o.tid, {', '.join(f'o.i{j}' for j in range(1, k))}, f.item AS i{k} FROM o{k - 1} o JOIN f ON f.tid = o.tid AND f.item > o.i{k - 1} SEMI JOIN l{k - 1} USING ({have}))")
        out.append(f"l{k} AS (SELECT {cols}, count(*) AS support FROM j{k} GROUP BY {cols} HAVING count(*) >= (SELECT s FROM lim))")
        out.append(f"o{k} AS (SELECT j{k}.* FROM j{k} SEMI JOIN l{k} USING ({cols}))")
    union = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, [{', '.join(f'i{j}' for j in range(1, k + 1))}] AS itemset, support FROM l{k}" for k in range(1, top + 1))
    return ", ".join(out) + f", sets AS ({union})"


@query("SELECT tid, item FROM (VALUES " + ", ".join(f"({t}::BIGINT, '{i}')" for t, items in R.TRANSACTIONS for i in items) + ") t(tid, item)")
def transactions(spark, sf):
    return R.builtin_transactions(spark)


@query(f"WITH {_trx('p_brand')} SELECT item, count(*) AS support FROM trx GROUP BY 1")
def item_counts(spark, sf):
    return B.item_counts(brand_baskets(spark, sf))


@query(f"WITH {_trx('p_brand')}, p(pct) AS (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) SELECT pct, CAST(greatest(1, floor(n * (pct / 100))) AS BIGINT) AS min_support FROM p, (SELECT count(DISTINCT tid) AS n FROM trx)")
def support_threshold(spark, sf):
    n = brand_baskets(spark, sf).select("tid").distinct().count()
    return spark.createDataFrame([(p, B.support_threshold(n, p)) for p in (0.1, 1.0, 10.0)], "pct double, min_support long")


@query(f"WITH {_levels('p_brand', 4.0, 1)} SELECT a.i1 || '|' || b.i1 AS itemset FROM l1 a JOIN l1 b ON a.i1 < b.i1")
def candidates_k2(spark, sf):
    x = brand_baskets(spark, sf)
    m = B.BasketMiner(x, min_support_percent=4.0)
    ones = B.item_counts(x).where(F.col("support") >= m.min_support).select(F.array("item").alias("itemset"))
    return B.candidates(ones, 2).select(F.array_join("itemset", "|").alias("itemset"))


@query(f"WITH {_levels('p_brand', 1.4, 2)} SELECT a.i1 || '|' || a.i2 || '|' || b.i2 AS itemset FROM l2 a JOIN l2 b ON a.i1 = b.i1 AND a.i2 < b.i2 JOIN l2 c ON c.i1 = a.i2 AND c.i2 = b.i2")
def candidates_k3_pruned(spark, sf):
    x = brand_baskets(spark, sf)
    m = B.BasketMiner(x, min_support_percent=1.4)
    pairs = B.frequent_itemsets(x, m.min_support, max_size=2).where("k = 2").select("itemset")
    return B.candidates(pairs, 3).select(F.array_join("itemset", "|").alias("itemset"))


@query(f"WITH {_levels('p_brand', 0.3)} SELECT k, array_to_string(itemset, '|') AS itemset, support FROM sets")
def frequent_itemsets(spark, sf):
    m = B.BasketMiner(brand_baskets(spark, sf), min_support_percent=0.3).fit()
    return m.itemsets.select("k", F.array_join("itemset", "|").alias("itemset"), "support")


_SPLITS = (
    "masked AS (SELECT itemset, support, unnest(generate_series(1, CAST(pow(2, len(itemset)) AS BIGINT) - 2)) AS mask FROM sets WHERE len(itemset) > 1), "
    "split AS (SELECT support, array_to_string(list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 1), '|') AS lhs, array_to_string(list_filter(itemset, lambda x, i: (mask >> (i - 1)) & 1 = 0), '|') AS rhs FROM masked), "
    "base AS (SELECT array_to_string(itemset, '|') AS lhs, support AS lhs_support FROM sets)"
)


@query(f"WITH {_levels('p_type', 10.0, 6)}, {_SPLITS} SELECT lhs, rhs FROM split")
def itemset_subsets(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    return B.proper_subsets(m.itemsets).select(F.array_join("lhs", "|").alias("lhs"), F.array_join("rhs", "|").alias("rhs"))


@query(f"WITH {_levels('p_type', 10.0, 6)}, {_SPLITS} SELECT lhs, rhs, support, round(support / lhs_support, 9) AS confidence FROM split JOIN base USING (lhs) WHERE support / lhs_support >= 0.5")
def rules_absolute(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    return B.rules(m.itemsets, 0.5).select(F.array_join("lhs", "|").alias("lhs"), F.array_join("rhs", "|").alias("rhs"), "support", r9(F.col("confidence"), "confidence"))


@query(f"WITH {_levels('p_type', 10.0, 6)}, {_SPLITS}, n AS (SELECT count(DISTINCT tid) AS n FROM trx) SELECT lhs, rhs, round(support / n, 9) AS support, round(support / lhs_support, 9) AS confidence FROM split JOIN base USING (lhs), n WHERE support / lhs_support + 1e-12 >= 0.5")
def rules_fraction(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    x = B.rules_fraction(m.itemsets, m.n, 0.5, m.min_support / m.n)
    return x.select(F.array_join("lhs", "|").alias("lhs"), F.array_join("rhs", "|").alias("rhs"), r9(F.col("support"), "support"), r9(F.col("confidence"), "confidence"))


@query(f"WITH {_levels('p_brand', 1.0)} SELECT k, row_number() OVER (PARTITION BY k ORDER BY support DESC, itemset) AS rank, '{{' || array_to_string(itemset, ', ') || '}}: ' || support AS line FROM sets")
def itemset_report(spark, sf):
    m = B.BasketMiner(brand_baskets(spark, sf), min_support_percent=1.0).fit()
    return K.itemset_lines(m.itemsets).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_levels('p_type', 10.0, 6)}, {_SPLITS}, r AS (SELECT lhs, rhs, support, support / lhs_support AS confidence FROM split JOIN base USING (lhs) WHERE support / lhs_support >= 0.5) SELECT row_number() OVER (ORDER BY confidence DESC, support DESC, string_split(lhs, '|'), string_split(rhs, '|')) AS rank, lhs, rhs FROM r")
def rules_ordered(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    x = m.rules(0.5).select("lhs", "rhs", F.monotonically_increasing_id().alias("at"))
    return positions(x, "at").select((F.col("pos") + 1).alias("rank"), F.array_join("lhs", "|").alias("lhs"), F.array_join("rhs", "|").alias("rhs"))


def _rule_report(values: str, line: str, least: str) -> str:
    return (
        f"WITH {_levels('p_type', 10.0, 6)}, {_SPLITS}, n AS (SELECT count(DISTINCT tid) AS n FROM trx), r AS (SELECT lhs, rhs, {values} FROM split JOIN base USING (lhs), n WHERE {least}) "
        f"SELECT row_number() OVER (ORDER BY confidence DESC, support DESC, string_split(lhs, '|'), string_split(rhs, '|')) AS rank, '{{' || replace(lhs, '|', ', ') || '}} -> {{' || replace(rhs, '|', ', ') || '}} ' || {line} AS line FROM r"
    )


@query(_rule_report("support, support / lhs_support AS confidence", "printf('support: %d, confidence: %.4f', support, confidence)", "support / lhs_support >= 0.5"))
def rules_report(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    return K.rule_lines(m.rules(0.5))


@query(_rule_report("support / n AS support, support / lhs_support AS confidence", "printf('support: %.3f, conf: %.3f', support, confidence)", "support / lhs_support + 1e-12 >= 0.5"))
def rules_report_fraction(spark, sf):
    m = B.BasketMiner(type_baskets(spark, sf), min_support_percent=10.0).fit()
    return K.rule_lines(m.rules(0.5, fractional=True), fractional=True)


@query(f"WITH {_levels('p_brand', 0.3)} SELECT k, count(*) AS itemsets, CAST(sum(support) AS BIGINT) AS total FROM sets GROUP BY 1 UNION ALL SELECT max(k) + 1, 0, 0 FROM sets")
def mining_summary(spark, sf):
    """Levels of the miner, the last one empty; times are left out."""
    levels: list = []
    m = B.BasketMiner(brand_baskets(spark, sf), min_support_percent=0.3)
    found = B.frequent_itemsets(m.trx, m.min_support, levels=levels)
    per = spark.createDataFrame([(k, n) for k, _, n, _ in levels], "k int, itemsets long")
    return per.join(found.groupBy("k").agg(F.sum("support").alias("total")), "k", "left").select("k", "itemsets", F.coalesce("total", F.lit(0)).alias("total"))


# --- sources, each over files written from the tables -------------------------------------------


def written(lines: DataFrame, **options: str) -> str:
    """The path of a text written from (value)."""
    path = shared_path(lines.sparkSession)
    lines.write.options(**options).text(path)
    return path


def part_file(spark, path: str) -> str:
    """The one file of a text that was written from one partition."""
    return spark.read.text(path).select("_metadata.file_path").first()[0]


@query("SELECT doc_id AS folder, text FROM (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in R.CORPUS) + ") t(doc_id, text)")
def source_text_documents(spark, sf):
    top = shared_path(spark)
    R.builtin_corpus(spark).repartition("doc_id").select("doc_id", F.col("text").alias("value")).write.partitionBy("doc_id").text(top)
    d = R.text_documents(spark, top)
    return d.select(F.regexp_replace(F.element_at(F.split("doc_id", r"\\"), 1), "^doc_id=", "").alias("folder"), F.regexp_replace("text", r"\n$", "").alias("text"))


@query("SELECT string_agg('row ' || n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation")
def source_file_text(spark, sf):
    rows = table(spark, sf, "nation").repartition(1).sortWithinPartitions("n_nationkey").select(F.concat(F.lit("row "), F.col("n_nationkey").cast("string"), F.lit(": "), "n_name").alias("value"))
    return R.file_text(spark, part_file(spark, written(rows))).select(F.regexp_replace("text", r"\n$", "").alias("text"))


_ORDER_LINES = "o AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS items FROM {} GROUP BY 1)"


def order_lines(spark, sf):
    """(value): an order's parts in a line, a comment and a blank line beside each."""
    x = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "  ").alias("p"))
    return x.select(F.explode(F.array(F.col("p"), F.lit("# a comment"), F.lit("  "))).alias("value"))


@query(f"WITH {_ORDER_LINES.format('lineitem')} SELECT items, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT '#|a|comment', count(*) FROM o")
def source_transactions(spark, sf):
    x = R.transactions(spark, written(order_lines(spark, sf)))
    return x.groupBy(F.array_join(F.array_sort("items"), "|").alias("items")).agg(F.count("*").alias("n"))


@query(f"WITH {_ORDER_LINES.format('(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)')} SELECT items, count(*) AS n FROM o GROUP BY 1")
def source_transaction_sets(spark, sf):
    x = R.transactions(spark, written(order_lines(spark, sf)), comments=True, distinct=True)
    return x.groupBy(F.array_join(F.array_sort("items"), "|").alias("items")).agg(F.count("*").alias("n"))


_LOOPED = "SELECT user_id AS u, user_id * 7 % 151 AS v FROM events WHERE user_id <> user_id * 7 % 151"


def event_pairs(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("u"), (F.col("user_id") * 7 % 151).cast("string").alias("v"))


@query(_LOOPED)
def source_edge_stream(spark, sf):
    lines = event_pairs(spark, sf).select(F.explode(F.array(F.concat("u", F.lit(" \t"), "v"), F.lit("# head"), F.col("u"))).alias("value"))
    return R.edge_stream(spark, written(lines, compression="gzip")).select("u", "v")


@query(_LOOPED)
def source_edge_csv(spark, sf):
    lines = event_pairs(spark, sf).select(F.explode(F.array(F.concat("u", F.lit(", "), "v", F.lit(",9")), F.lit(" "), F.col("u"))).alias("value"))
    return R.edge_csv(spark, written(lines))


def metis_lines(spark, sf):
    """(value): the graph of parts as a METIS file, whose vertices count from 1 where parts count from 0."""
    v, arcs = part_graph(spark, sf)
    near = arcs.groupBy(F.col("u").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("v") + 1)).cast("array<string>"), " ").alias("p"))
    body = v.select("id").join(near, "id", "left").select((F.col("id") + 1).alias("no"), F.coalesce("p", F.lit("")).alias("value"))
    head = v.agg(F.count("id")).join(arcs.agg(F.count("*").alias("m"))).toDF("n", "m").select(F.lit(0).cast("long").alias("no"), F.concat_ws(" ", F.col("n").cast("string"), F.floor(F.col("m") / 2).cast("string")).alias("value"))
    remark = head.select(F.lit(-1).cast("long").alias("no"), F.lit("% a remark").alias("value"))
    return body.unionByName(head).unionByName(remark).repartition(1).sortWithinPartitions("no").select("value")


@query("WITH pp AS (SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) SELECT u, v FROM pp UNION ALL SELECT v, u FROM pp")
def source_metis_arcs(spark, sf):
    return R.metis_graph(spark, part_file(spark, written(metis_lines(spark, sf))))[1].select((F.col("u") - 1).alias("u"), (F.col("v") - 1).alias("v"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id FROM part")
def source_metis_vertices(spark, sf):
    return R.metis_graph(spark, part_file(spark, written(metis_lines(spark, sf))))[0].select((F.col("id") - 1).alias("id"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) % 4 AS label FROM part")
def source_partition_labels(spark, sf):
    v = P.colored(parts(spark, sf), "ROUND_ROBIN", 4, 0).repartition(1).sortWithinPartitions("id")
    x = R.partition_labels(spark, part_file(spark, written(v.select(F.concat(F.lit(" "), F.col("color").cast("string")).alias("value")))))
    return x.select((F.col("id") - 1).alias("id"), "label")


# --- graphs and streams -------------------------------------------------------------------------


def order_pairs(spark, sf):
    """(u, v): parts that stand in one order, a pair once for each such order."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null").repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    first = x.select("p", F.posexplode("p").alias("at", "u"))
    return first.select("u", F.explode(F.slice("p", F.col("at") + 2, F.greatest(F.size("p") - F.col("at") - 1, F.lit(0)))).alias("v"))


def part_pairs(spark, sf):
    """(u, v): parts that stand in one order, each pair once."""
    return order_pairs(spark, sf).distinct()


_PAIRS = "pp AS (SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
_TRIANGLES = "tri AS (SELECT count(*) AS n FROM pp a JOIN pp b ON a.u = b.u AND a.v < b.v JOIN pp c ON c.u = a.v AND c.v = b.v)"


@query("SELECT event_id AS seq, least(user_id, user_id * 7 % 151) AS u, greatest(user_id, user_id * 7 % 151) AS v FROM events WHERE user_id <> user_id * 7 % 151")
def edges_canonical(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("u"), (F.col("user_id") * 7 % 151).alias("v"))
    return G.canonical(e)


@query(f"WITH {_PAIRS}, {_TRIANGLES} SELECT n AS triangles FROM tri")
def triangles_exact(spark, sf):
    return G.triangle_count(order_pairs(spark, sf))


_ORDER = "md5('0|' || u || '|' || v)"


@query(f"WITH {_PAIRS} SELECT u, v FROM pp ORDER BY {_ORDER}, u, v LIMIT 1000")
def reservoir_sample(spark, sf):
    """A sampling operator: 1000 rows are its result."""
    return T.bottom_sample(G.simple(part_pairs(spark, sf)), 1000)


def _sampled(m: int) -> str:
    return (
        f"s{m} AS (SELECT u, v FROM pp ORDER BY {_ORDER}, u, v LIMIT {m}), e{m} AS (SELECT CAST({m} AS BIGINT) AS m, t, least(t, {m}) AS sample_size, "
        f"CASE WHEN t <= {m} THEN 1.0 ELSE greatest(1.0, CAST(t AS DOUBLE) * (CAST(t AS DOUBLE) - 1) * (CAST(t AS DOUBLE) - 2) / ({m}.0::DOUBLE * {m - 1}.0::DOUBLE * {m - 2}.0::DOUBLE)) END * "
        f"(SELECT count(*) FROM s{m} a JOIN s{m} b ON a.u = b.u AND a.v < b.v JOIN s{m} c ON c.u = a.v AND c.v = b.v) AS estimate FROM (SELECT count(*) AS t FROM pp))"
    )


@query(f"WITH {_PAIRS}, {_sampled(5000)} SELECT m, t, sample_size, round(estimate, 3) AS estimate FROM e5000")
def triest_base_sampled(spark, sf):
    x = T.sampled_estimate(order_pairs(spark, sf), 5000)
    return x.select("m", "t", "sample_size", F.round("estimate", 3).alias("estimate"))


@query(f"WITH {_PAIRS}, {_TRIANGLES}, {_sampled(5000)}, {_sampled(20000)}, e AS (SELECT * FROM e5000 UNION ALL SELECT * FROM e20000) SELECT m, round(estimate, 3) AS estimate, round(abs(estimate - n) / n, 6) AS rel_error FROM e, tri")
def triest_rel_error(spark, sf):
    e = EdgeBlocks(order_pairs(spark, sf))
    x = T.sampled_estimates(e.rows(), e.size, [5000, 20000])
    return T.relative_error(x, e.triangle_count()).select("m", F.round("estimate", 3).alias("estimate"), F.round("rel_error", 6).alias("rel_error"))


def supplier_edges(spark, sf):
    """(seq, u, v): suppliers of one nation, as a stream by (u, v)."""
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("u"), "s_nationkey")
    # a small table makes many pairs: its rows are dealt out so that more than one task makes them
    e = p.repartition(4 * spark.sparkContext.defaultParallelism).join(p.select(F.col("u").alias("v"), "s_nationkey"), "s_nationkey").where("u < v").select("u", "v")
    return e.withColumn("seq", F.col("u") * 1_000_000 + F.col("v"))


_SUPPLIERS = "pp AS (SELECT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"


def _exact_regime(variant: str) -> str:
    return f"WITH {_SUPPLIERS}, {_TRIANGLES} SELECT CAST(100000000 AS BIGINT) AS m, '{variant}' AS variant, t, t AS sample_size, CAST(n AS DOUBLE) AS estimate FROM tri, (SELECT count(*) AS t FROM pp)"


@query(_exact_regime("base"))
def triest_base_exact(spark, sf):
    return T.run_triest(supplier_edges(spark, sf), [100_000_000], "base")


@query(_exact_regime("impr"))
def triest_impr_exact(spark, sf):
    return T.run_triest(supplier_edges(spark, sf), [100_000_000], "impr")


@query()
def triest_stream_sampled(spark, sf):
    e = supplier_edges(spark, sf)
    return T.run_triest(e, [50, 100, 200], "base").unionByName(T.run_triest(e, [50, 100, 200], "impr"))


# --- spectral -----------------------------------------------------------------------------------


def brand_edges(spark, sf):
    """(u, v): a line for each order and pair of brands in it, brands as numbers."""
    x = brand_baskets(spark, sf).distinct().groupBy("tid").agg(F.array_sort(F.collect_set(F.regexp_extract("item", r"(\d+)", 1).cast("long"))).alias("b"))
    first = x.select("b", F.posexplode("b").alias("at", "u"))
    return first.select("u", F.explode(F.slice("b", F.col("at") + 2, F.greatest(F.size("b") - F.col("at") - 1, F.lit(0)))).alias("v"))


_BRANDS = (
    f"{_trx('p_brand')}, nb AS (SELECT DISTINCT tid, CAST(regexp_extract(item, '(\\d+)', 1) AS BIGINT) AS b FROM trx), e AS (SELECT x.b AS u, y.b AS v FROM nb x JOIN nb y ON x.tid = y.tid AND x.b < y.b), "
    "idx AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT u AS node FROM e UNION SELECT v FROM e)), "
    "one AS (SELECT a.idx AS i, b.idx AS j FROM e JOIN idx a ON e.u = a.node JOIN idx b ON e.v = b.node), adj AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS w FROM (SELECT i, j FROM one UNION ALL SELECT j, i FROM one) GROUP BY 1, 2), "
    "deg AS (SELECT i AS idx, sum(w) AS degree FROM adj GROUP BY 1)"
)


@query(f"WITH {_BRANDS} SELECT node, idx FROM idx")
def node_index(spark, sf):
    return L.node_index(brand_edges(spark, sf))


@query(f"WITH {_BRANDS} SELECT i, j, w FROM adj")
def adjacency(spark, sf):
    return L.adjacency(brand_edges(spark, sf))


@query(f"WITH {_BRANDS} SELECT idx, degree FROM deg")
def degrees(spark, sf):
    return L.degree_vector(L.adjacency(brand_edges(spark, sf)))


@query(f"WITH {_BRANDS} SELECT a.idx AS i, b.idx AS j, round(CASE WHEN a.idx = b.idx THEN 1.0 ELSE 0.0 END - coalesce(w, 0.0) / sqrt(a.degree * b.degree), 9) AS value FROM deg a JOIN deg b ON TRUE LEFT JOIN adj ON adj.i = a.idx AND adj.j = b.idx WHERE w IS NOT NULL OR a.idx = b.idx")
def laplacian(spark, sf):
    return L.laplacian(L.adjacency(brand_edges(spark, sf))).select("i", "j", r9(F.col("value"), "value"))


@query()
def eigenvalues(spark, sf):
    return L.spectrum(L.laplacian(L.adjacency(brand_edges(spark, sf))), 11)


@query()
def eigengap(spark, sf):
    return L.eigengap_k(L.spectrum(L.laplacian(L.adjacency(brand_edges(spark, sf))), 11)).select(F.col("k").cast("long").alias("k"))


SPECTRUM = [0.0, 0.0, 0.0, 0.19, 0.2, 0.65, 0.7, 1.0, 1.1, 1.2, 1.9, 2.0]


@query("WITH s(idx, v) AS (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(SPECTRUM)) + "), g AS (SELECT idx, lead(v) OVER (ORDER BY idx) - v AS gap FROM s WHERE idx <= 10) SELECT CAST(idx + 1 AS BIGINT) AS k FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, idx LIMIT 1")
def eigengap_of_table(spark, sf):
    """The widest gap of a fixed spectrum."""
    spec = spark.createDataFrame(list(enumerate(SPECTRUM)), "idx long, eigenvalue double")
    return L.eigengap_k(spec).select(F.col("k").cast("long").alias("k"))


@query()
def spectral_labels(spark, sf):
    return L.SpectralClustering(k=3).fit(brand_edges(spark, sf)).labels


@query(f"WITH {_BRANDS}, lab AS (SELECT idx, node % 4 AS label FROM idx), pos AS (SELECT idx, row_number() OVER (ORDER BY label, idx) - 1 AS pos FROM lab) SELECT a.pos AS \"row\", b.pos AS col, w FROM adj JOIN pos a ON adj.i = a.idx JOIN pos b ON adj.j = b.idx")
def adjacency_reordered(spark, sf):
    e = brand_edges(spark, sf)
    labels = L.node_index(e).select("idx", (F.col("node") % 4).alias("label"))
    return L.reordered(L.adjacency(e), labels)


# --- partitioning -------------------------------------------------------------------------------

CONFIG = P.PartitionConfig(rounds=3)


def parts(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") + 0).cast("long").alias("id"))


def part_graph(spark, sf, coloring: str = "ROUND_ROBIN"):
    ids = parts(spark, sf)
    n = ids.agg(F.max("id")).first()[0]
    e = part_pairs(spark, sf)
    return P.colored(ids, coloring, CONFIG.partitions, n, CONFIG.seed), e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


_IDS = "ids AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part), n AS (SELECT max(id) AS n FROM ids), vx AS (SELECT id, id % 4 AS color FROM ids)"
_ARCS = f"{_PAIRS}, arcs AS (SELECT u, v FROM pp UNION ALL SELECT v, u FROM pp)"


@query(f"WITH {_IDS} SELECT id, color, color AS init_color FROM vx")
def color_round_robin(spark, sf):
    return P.colored(parts(spark, sf), "ROUND_ROBIN", 4, 0)


_BATCH = "bt AS (SELECT id, CAST(min(i) AS BIGINT) AS color FROM ids, n, (SELECT unnest(generate_series(0, 3)) AS i) WHERE id <= (i + 1) * (CAST(n AS DOUBLE) / 4) GROUP BY 1)"


@query(f"WITH {_IDS}, {_BATCH} SELECT id, color, color AS init_color FROM bt")
def color_batch(spark, sf):
    ids = parts(spark, sf)
    return P.colored(ids, "BATCH", 4, ids.agg(F.max("id")).first()[0])


@query(f"WITH {_IDS}, r AS (SELECT id, CAST(concat('0x', substr(md5(id || '|0'), 25, 8)) AS BIGINT) % 4 AS color FROM ids) SELECT id, color, color AS init_color FROM r")
def color_random(spark, sf):
    return P.colored(parts(spark, sf), "RANDOM", 4, 0)


@query(f"WITH {_IDS}, {_BATCH} SELECT color, count(*) AS n FROM bt GROUP BY 1")
def color_distribution(spark, sf):
    return P.color_distribution(color_batch(spark, sf))


@query(f"WITH {_IDS}, {_ARCS} SELECT u, color, count(*) AS degree FROM arcs JOIN vx ON v = id GROUP BY 1, 2")
def color_degree(spark, sf):
    return P.color_degree(*part_graph(spark, sf))


@query(f"WITH {_ARCS} SELECT u, count(*) AS degree FROM arcs GROUP BY 1")
def node_degree(spark, sf):
    return P.node_degree(part_graph(spark, sf)[1])


_NEIGHBORS = "nb AS (SELECT u AS p, v AS q FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY md5('0|' || u || '|' || v), v) AS r FROM arcs) WHERE r <= 3)"


@query(f"WITH {_ARCS}, {_NEIGHBORS} SELECT p, q FROM nb")
def neighbor_sample(spark, sf):
    return P.neighbor_sample(part_graph(spark, sf)[1], 3)


@query(
    f"WITH {_IDS}, d AS (SELECT id AS p, j, 1 + CAST(concat('0x', substr(md5('0|' || id || '|' || j), 25, 8)) AS BIGINT) % n AS q FROM ids, n, (SELECT unnest(generate_series(1, 18)) AS j) UNION ALL SELECT id, 18 + j, 1 + (CAST(concat('0x', substr(md5('0|' || id || '|1'), 25, 8)) AS BIGINT) % n + j) % n FROM ids, n, (SELECT unnest(generate_series(1, 13)) AS j)), "
    "f AS (SELECT p, q, min(j) AS j FROM d WHERE q <> p GROUP BY 1, 2) SELECT p, q FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY j) AS r FROM f) WHERE r <= 6"
)
def uniform_sample(spark, sf):
    ids = parts(spark, sf)
    return P.uniform_sample(ids, 6, ids.agg(F.max("id")).first()[0])


@query(f"WITH {_IDS}, {_ARCS} SELECT CAST(count(*) FILTER (WHERE a.color <> b.color) // 2 AS BIGINT) AS edge_cut FROM arcs JOIN vx a ON u = a.id JOIN vx b ON v = b.id")
def edge_cut(spark, sf):
    return P.edge_cut(*part_graph(spark, sf))


@query(f"WITH {_IDS}, {_BATCH} SELECT count(*) FILTER (WHERE vx.color <> bt.color) AS migrations FROM vx JOIN bt USING (id)")
def migrations(spark, sf):
    a, b = color_round_robin(spark, sf), color_batch(spark, sf)
    return P.migrations(a.select("id", "color").join(b.select("id", "init_color"), "id"))


@query("SELECT CAST(r AS BIGINT) AS round, CAST(round(greatest(1.0, 2.0 - r * 0.003), 4) AS DOUBLE) AS temperature FROM (SELECT unnest(generate_series(0, 399)) AS r)")
def cooling_schedule(spark, sf):
    rows = [(r, round(t, 4)) for r, t in P.cooling_schedule(2.0, 0.003, 400)]
    return spark.createDataFrame(rows, "round long, temperature double")


@query(
    f"WITH {_IDS}, {_ARCS}, {_NEIGHBORS}, dg AS (SELECT u, color, count(*) AS degree FROM arcs JOIN vx ON v = id GROUP BY 1, 2), "
    "x AS (SELECT p, q, a.color AS cp, b.color AS cq FROM nb JOIN vx a ON p = a.id JOIN vx b ON q = b.id WHERE a.color <> b.color), "
    "y AS (SELECT p, q, pow(coalesce(d1.degree, 0), 2) + pow(coalesce(d2.degree, 0), 2) AS old, pow(coalesce(d3.degree, 0), 2) + pow(coalesce(d4.degree, 0), 2) AS benefit FROM x "
    "LEFT JOIN dg d1 ON d1.u = p AND d1.color = cp LEFT JOIN dg d2 ON d2.u = q AND d2.color = cq LEFT JOIN dg d3 ON d3.u = p AND d3.color = cq LEFT JOIN dg d4 ON d4.u = q AND d4.color = cp) "
    "SELECT p, q, benefit FROM (SELECT p, q, benefit, row_number() OVER (PARTITION BY p ORDER BY benefit DESC, q) AS r FROM y WHERE benefit * 2.0 > old) WHERE r = 1"
)
def best_partner(spark, sf):
    v, arcs = part_graph(spark, sf)
    return P.best_partner(v, arcs, P.neighbor_sample(arcs, 3), 2.0, 2.0)


@query()
def jabeja_report(spark, sf):
    v, arcs = part_graph(spark, sf)
    return P.Jabeja(S.saved(v), S.saved(arcs), CONFIG).run().report
