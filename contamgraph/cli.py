"""Command line over stored graphs: ``python -m contamgraph.cli COMMAND ...``."""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contamgraph import schema
from contamgraph.operators import audit, canonical, similarity
from contamgraph.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contamgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("canonicalise", help="raw graph to canonical graph, checked before it is written")
    c.add_argument("graph")
    c.add_argument("out")
    c.add_argument("--corpus", help="only the examples of this source")
    c.add_argument("--limit", type=int, help="only so many examples, the first by id")
    c.add_argument("--protein-map", help="Parquet table (old_id, new_id) of targets and their proteins")
    a = sub.add_parser("audit", help="run the checks; the exit status is the number that fail")
    a.add_argument("graph")
    a.add_argument("--report", action="store_true", help="print all checks as Markdown, not the failed ones alone")
    a.add_argument("--full", action="store_true", help="the checks of a complete graph, too: all axes, clusters, label types")
    s = sub.add_parser("similarity", help="pairs of fingerprints (id, fp) at a threshold, as a tagged edge table")
    s.add_argument("prints")
    s.add_argument("out")
    s.add_argument("--threshold", type=float, default=schema.SIMILARITY_FLOOR)
    s.add_argument("--block-rows", type=int, default=4096)
    p.add_argument("--log-level", default="WARN")
    t = sub.add_parser("stats", help="counts by type as CSV")
    t.add_argument("graph")
    t.add_argument("out")
    return p


def restricted(nodes: DataFrame, edges: DataFrame, corpus: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph with the examples of one corpus, or with the first ``limit`` by id; other nodes stay."""
    if corpus is None and limit is None:
        return nodes, edges
    example = F.col("node_type") == "Example"
    kept = nodes.where(example if corpus is None else example & F.startswith("node_id", F.lit(f"ex:{corpus}:")))
    kept = kept if limit is None else kept.orderBy("node_id").limit(limit)
    gone = nodes.where(example).join(kept.select("node_id"), "node_id", "left_anti").select(F.col("node_id").alias("src"))
    return nodes.where(~example).unionByName(kept), edges.join(gone, "src", "left_anti").select(*edges.columns)


def audit_report(spark: SparkSession, path: str, full: bool = False):
    nodes, edges = sinks.read_graph(spark, path)
    out = audit.structural(nodes, edges)
    more = [audit.cardinality(nodes, edges), audit.facts(nodes, edges), audit.write_guard(nodes.drop("degree"), edges), audit.degree_recorded(nodes)]
    if full:
        empty = audit.unpopulated(edges).groupBy(F.concat_ws("_", F.lit("unpopulated"), "edge_type").alias("check")).agg(F.count("*").alias("n_bad"))
        more += [audit.semantics(nodes, edges), audit.contract(nodes, edges), empty.withColumn("passed", F.lit(False))]
    for part in more:
        out = out.unionByName(part)
    # a check that two groups share counts once
    return out.groupBy("check").agg(F.max("n_bad").alias("n_bad"), F.min("passed").alias("passed")).orderBy("check")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"contamgraph {args.command}").getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    if args.command == "canonicalise":
        nodes, edges = restricted(*sinks.read_graph(spark, args.graph), args.corpus, args.limit)
        proteins = spark.read.parquet(args.protein_map) if args.protein_map else None
        sinks.write_graph(*canonical.canonicalise(nodes, edges, proteins), args.out)
    elif args.command == "audit":
        report = audit_report(spark, args.graph, args.full).collect()
        for r in report:
            if args.report or not r["passed"]:
                print(f"| {r['check']} | {'passed' if r['passed'] else 'FAILED'} | {r['n_bad']} |")
        return sum(not r["passed"] for r in report)
    elif args.command == "similarity":
        prints = spark.read.parquet(args.prints)
        digest = similarity.entity_set_fingerprint(prints, "id").first()["fingerprint"]
        pairs = similarity.tanimoto_block_pairs(prints, args.threshold, args.block_rows)
        sinks.tagged(similarity.similarity_edges(pairs, "tanimoto", "popcount_blocks"), digest).write.mode("overwrite").parquet(args.out)
    else:
        nodes, edges = sinks.read_graph(spark, args.graph)
        sinks.write_statistics(nodes, edges, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
