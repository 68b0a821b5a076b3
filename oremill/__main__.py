"""Command line of the mining programs: python -m oremill similarity | itemsets | triangles | spectral | partition."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.operators.baskets import BasketMiner
from oremill.operators.partition import COLORINGS, POLICIES, Jabeja, PartitionConfig
from oremill.operators.similarity import SimilarityPipeline
from oremill.operators.spectral import SpectralClustering
from oremill.operators.triest import relative_error, run_triest
from oremill.sources import readers, sinks


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="oremill", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)
    p = sub.add_parser("similarity", help="shingles, signatures and LSH pairs of documents")
    p.add_argument("path", nargs="?", help="a folder of texts; the built-in corpus without it")
    p.add_argument("--limit", type=int)
    p.add_argument("-k", type=int, default=10, help="characters of a shingle")
    p.add_argument("-n", type=int, default=100, help="length of a signature")
    p.add_argument("-t", type=float, default=0.8, help="least similarity")
    p.add_argument("--bands", type=int)
    p = sub.add_parser("itemsets", help="frequent itemsets and association rules")
    p.add_argument("path", nargs="?", help="a file of transactions; the built-in ones without it")
    p.add_argument("--support", type=float, default=1.0, help="in percent of the transactions")
    p.add_argument("--min-support", type=int, help="as a count, which wins")
    p.add_argument("--confidence", type=float, default=0.5)
    p.add_argument("--fractional", action="store_true", help="supports as shares")
    p = sub.add_parser("triangles", help="triangle estimates of an edge stream")
    p.add_argument("path")
    p.add_argument("-m", type=int, nargs="+", default=[10_000], help="edges held")
    p.add_argument("--variant", choices=("base", "impr"), default="base")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--truth", type=int, help="the true count, for the relative error")
    p = sub.add_parser("spectral", help="spectral clustering of a graph in CSV lines")
    p.add_argument("path")
    p.add_argument("-k", type=int, help="clusters; by the eigengap without it")
    p.add_argument("--binary", action="store_true", help="repeated edges count once")
    p = sub.add_parser("partition", help="balanced partitioning of a METIS graph by swaps")
    p.add_argument("path")
    c = PartitionConfig()
    for name, value in (("rounds", c.rounds), ("partitions", c.partitions), ("uniform-sample", c.uniform_sample), ("neighbor-sample", c.neighbor_sample), ("seed", c.seed)):
        p.add_argument(f"--{name}", type=int, default=value)
    for name, value in (("temperature", c.temperature), ("delta", c.delta), ("alpha", c.alpha)):
        p.add_argument(f"--{name}", type=float, default=value)
    p.add_argument("--coloring", choices=COLORINGS, default=c.coloring)
    p.add_argument("--policy", choices=POLICIES, default=c.policy)
    p.add_argument("--output", help="a folder for the report of rounds")
    return top


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.program == "similarity":
        docs = readers.text_documents(spark, a.path, a.limit) if a.path else readers.builtin_corpus(spark)
        return SimilarityPipeline(docs, a.k, a.n, a.t, a.bands).report().select("line")
    if a.program == "itemsets":
        trx = readers.exploded(readers.transactions(spark, a.path, comments=True)) if a.path else readers.builtin_transactions(spark)
        miner = BasketMiner(trx, a.min_support, a.support).fit()
        sets = sinks.itemset_lines(miner.itemsets).select(F.lit(0).alias("part"), "k", "rank", "line")
        rules = sinks.rule_lines(miner.rules(a.confidence, a.fractional), a.fractional).select(F.lit(1).alias("part"), F.lit(0).alias("k"), "rank", "line")
        return sets.unionByName(rules).orderBy("part", "k", "rank").select("line")
    if a.program == "triangles":
        out = run_triest(readers.edge_stream(spark, a.path), a.m, a.variant, a.seed)
        return relative_error(out, spark.createDataFrame([(a.truth,)], "triangles long")) if a.truth else out
    if a.program == "spectral":
        return SpectralClustering(a.k, binary=a.binary).fit(readers.edge_csv(spark, a.path)).labels.orderBy("node")
    names = ("rounds", "partitions", "uniform_sample", "neighbor_sample", "seed", "temperature", "delta", "alpha", "coloring", "policy")
    config = PartitionConfig(**{n: getattr(a, n) for n in names})
    ids, arcs = readers.metis_graph(spark, a.path)
    n = ids.agg(F.max("id")).first()[0] or 0
    from oremill.functions.saved import saved
    from oremill.operators.partition import colored

    report = Jabeja(saved(colored(ids, config.coloring, config.partitions, n, config.seed)), saved(arcs), config).run().report
    if a.output:
        sinks.write_partition_report(report, f"{a.output}/{config.file_name(a.path.rsplit('/', 1)[-1])}")
    return report


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"oremill-{a.program}").getOrCreate()
    out = result(spark, a)
    sys.stdout.write("\t".join(out.columns) + "\n")
    for row in out.toLocalIterator():
        sys.stdout.write("\t".join(map(str, row)) + "\n")


if __name__ == "__main__":
    main()
