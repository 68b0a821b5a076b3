"""Frequent itemsets by levels, and association rules.

An occurrence of an itemset keeps the frequent items that its basket has after it, so a level extends itemsets
inside the row: no join on the basket, one shuffle for the counts.  Candidates are pruned before counting
(every subset frequent) and meet the occurrences as a semi-join.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oremill.functions.saved import saved


def item_counts(trx: DataFrame) -> DataFrame:
    """(item, support) of (tid, item); an item counts once a basket."""
    return trx.select("tid", "item").distinct().groupBy("item").agg(F.count("*").alias("support"))


def support_threshold(n: int, percent: float | None = 1.0, absolute: int | None = None) -> int:
    """A percentage of n baskets as a count, 1 at least; an absolute count wins."""
    if absolute is not None:
        return absolute
    if not 0 < percent <= 100:
        raise ValueError("the percentage lies above 0 and up to 100")
    return max(1, int(n * (percent / 100)))


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """Itemsets of size k whose subsets of size k - 1 are all in `frequent` (itemset)."""
    a, b = frequent.select(F.col("itemset").alias("x")), frequent.select(F.col("itemset").alias("y"))
    same = F.slice("x", 1, k - 2) == F.slice("y", 1, k - 2) if k > 2 else F.lit(True)
    joined = a.join(b, same & (F.element_at("x", -1) < F.element_at("y", -1))).select(F.concat("x", F.array(F.element_at("y", -1))).alias("itemset"))
    if k == 2:
        return joined
    subs = joined.withColumn("sub", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.filter("itemset", lambda v, j: j != i - 1))))
    return subs.join(frequent.select(F.col("itemset").alias("sub")), "sub").groupBy("itemset").count().where(F.col("count") == k).select("itemset")


def frequent_itemsets(trx: DataFrame, min_support: int, max_size: int | None = None, levels: list | None = None) -> DataFrame:
    """(k, itemset, support) with support >= min_support, itemsets as sorted arrays.

    levels: a list that gets (k, candidates that occur, frequent itemsets, seconds) of each level.
    """
    start = time.perf_counter()
    counts = saved(item_counts(trx.where("item is not null")))
    ones = saved(counts.where(F.col("support") >= min_support))
    level = ones.select(F.lit(1).alias("k"), F.array("item").alias("itemset"), "support")
    found = level
    held = trx.select("tid", "item").distinct().join(ones.select("item"), "item", "left_semi").groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("rest"))
    # an occurrence: an itemset, and the items of its basket that come after
    rest_after = lambda at: F.slice("rest", at + 2, F.greatest(F.size("rest") - at - 1, F.lit(0)))
    occ = held.where(F.size("rest") > 1).select(F.array().cast(f"array<{dict(trx.dtypes)['item']}>").alias("itemset"), "rest")
    occ = occ.select("itemset", "rest", F.posexplode("rest").alias("at", "i")).select(F.array("i").alias("itemset"), rest_after(F.col("at")).alias("rest"))
    k, n_candidates = 1, counts.count() if levels is not None else 0
    while True:
        if levels is not None:
            levels.append((k, n_candidates, level.count(), time.perf_counter() - start))
        start = time.perf_counter()
        if max_size is not None and k >= max_size:
            return found
        k += 1
        longer = occ.where(F.size("rest") > 0).select("itemset", "rest", F.posexplode("rest").alias("at", "i")).select(F.concat("itemset", F.array("i")).alias("itemset"), rest_after(F.col("at")).alias("rest"))
        if k > 2:  # any two frequent items are a candidate
            longer = longer.join(candidates(level, k), "itemset", "left_semi")
        longer = saved(longer)
        counts = saved(longer.groupBy("itemset").agg(F.count("*").alias("support")))
        level = counts.where(F.col("support") >= min_support).select(F.lit(k).alias("k"), "itemset", "support")
        n_candidates = counts.count() if levels is not None else 0
        if level.isEmpty():
            if levels is not None:
                levels.append((k, n_candidates, 0, time.perf_counter() - start))
            return found
        found = found.unionByName(level)
        occ = longer.join(level.select("itemset"), "itemset", "left_semi")


def proper_subsets(itemsets: DataFrame) -> DataFrame:
    """itemsets with `lhs` and `rhs`: every split into two non-empty parts."""
    masks = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("itemset")).cast("int") - 2))
    d = itemsets.where(F.size("itemset") > 1).withColumn("mask", masks)
    bit = lambda j: F.call_function("getbit", F.col("mask").cast("long"), j)
    lhs, rhs = F.filter("itemset", lambda v, j: bit(j) == 1), F.filter("itemset", lambda v, j: bit(j) == 0)
    return d.withColumn("lhs", lhs).withColumn("rhs", rhs).drop("mask")


def rules(frequent: DataFrame, min_confidence: float) -> DataFrame:
    """(lhs, rhs, support, confidence): support counts baskets that hold both sides."""
    if not 0 <= min_confidence <= 1:
        raise ValueError("a confidence lies between 0 and 1")
    base = frequent.select(F.col("itemset").alias("lhs"), F.col("support").alias("lhs_support"))
    out = proper_subsets(frequent.select("itemset", "support")).join(base, "lhs").withColumn("confidence", F.col("support") / F.col("lhs_support"))
    return out.where(F.col("confidence") >= min_confidence).select("lhs", "rhs", "support", "confidence")


def rules_fraction(frequent: DataFrame, n: int, min_confidence: float, min_support: float = 0.0) -> DataFrame:
    """As `rules`, with support as a share of n baskets, and both bounds met within 1e-12."""
    f = frequent.select("itemset", (F.col("support") / F.lit(float(max(n, 1)))).alias("support"))
    base = f.select(F.col("itemset").alias("lhs"), F.col("support").alias("lhs_support"))
    out = proper_subsets(f.where(F.col("support") + 1e-12 >= min_support)).join(base, "lhs").where(F.col("lhs_support") > 1e-12).withColumn("confidence", F.col("support") / F.col("lhs_support"))
    return out.where(F.col("confidence") + 1e-12 >= min_confidence).select("lhs", "rhs", "support", "confidence")


def ordered_rules(r: DataFrame) -> DataFrame:
    return r.orderBy(F.desc("confidence"), F.desc("support"), "lhs", "rhs")


class BasketMiner:
    """Itemsets and rules of one table of baskets (tid, item)."""

    def __init__(self, trx: DataFrame, min_support: int | None = None, min_support_percent: float = 1.0):
        self.trx = trx
        self.n = trx.select("tid").distinct().count()
        self.min_support = support_threshold(self.n, min_support_percent, min_support)

    def fit(self) -> BasketMiner:
        self.itemsets = saved(frequent_itemsets(self.trx, self.min_support))
        return self

    def summary(self) -> DataFrame:
        """(k, candidates, itemsets, seconds) of each level; mines anew."""
        levels: list = []
        frequent_itemsets(self.trx, self.min_support, levels=levels)
        return self.trx.sparkSession.createDataFrame(levels, "k int, candidates long, itemsets long, seconds double")

    def rules(self, min_confidence: float = 0.5, fractional: bool = False) -> DataFrame:
        if fractional:
            return ordered_rules(rules_fraction(self.itemsets, self.n, min_confidence, self.min_support / self.n if self.n else 0.0))
        return ordered_rules(rules(self.itemsets, min_confidence))

    def report(self) -> DataFrame:
        """Itemsets by size, the most frequent first."""
        return self.itemsets.orderBy("k", F.desc("support"), "itemset")
