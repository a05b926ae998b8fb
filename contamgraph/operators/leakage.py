"""Leakage groups, cluster nesting and sequence identity."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contamgraph.operators.components import connected_components


def within_degree(edges: DataFrame, nodes: DataFrame, cut: int | None) -> DataFrame:
    """Edges whose dst has at most ``cut`` edges; a node that is not listed counts 0."""
    if cut is None:
        return edges
    small = nodes.where(F.coalesce("degree", F.lit(0)) > cut).select(F.col("node_id").alias("dst"))
    return edges.join(small, "dst", "left_anti")


def leakage_groups(links: DataFrame, relation: DataFrame | None = None) -> DataFrame:
    """(node, component) over example-entity links and entity-entity relation edges.

    The bipartite form keeps a hub one vertex instead of a square of examples.
    """
    edges = links.select("src", "dst")
    return connected_components(edges if relation is None else edges.unionByName(relation.select("src", "dst")))


def largest_group(groups: DataFrame, examples: DataFrame) -> DataFrame:
    """(n_examples, n_linked, largest, largest_pct): the largest group, in percent of all examples."""
    ids = examples.select(F.col("node_id").alias("node")).distinct()
    n = ids.agg(F.count("*").alias("n_examples"))
    sizes = groups.join(ids, "node", "left_semi").groupBy("component").agg(F.count("*").alias("size"))
    top = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_linked"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    return n.join(top, F.lit(True)).select("n_examples", "n_linked", "largest", F.round(F.coalesce(F.try_divide(100.0 * F.col("largest"), F.col("n_examples")), F.lit(0.0)), 4).alias("largest_pct"))


def nest_clusters(clusters: DataFrame, levels: tuple[int, ...] = (90, 50, 30)) -> DataFrame:
    """(protein_id, resolution, cluster_id) where every tighter cluster lies in one looser one.

    Each level's components join its own links with those of the tighter levels;
    the representative is the smallest member.
    """
    out, links = None, None
    for level in levels:
        own = clusters.where(F.col("resolution") == level).select(F.col("protein_id").alias("src"), F.col("cluster_id").alias("dst"))
        own = own.groupBy("dst").agg(F.min("src").alias("a")).join(own, "dst").select(F.col("a").alias("dst"), "src")
        links = own if links is None else links.unionByName(own)
        part = connected_components(links).select(F.col("node").alias("protein_id"), F.lit(level).alias("resolution"), F.col("component").alias("cluster_id"))
        out = part if out is None else out.unionByName(part)
    return out


def identical_proteins(hits: DataFrame, identity: float = 98.0, coverage: float = 0.90) -> DataFrame:
    """(src, dst, pident, alnlen) from alignments that cover both sequences.

    ``hits(query, target, pident, alnlen, qlen, tlen)``; of several alignments of a
    pair the largest identity and length are reported.
    """
    good = hits.where("query <> target").where(F.col("pident") >= identity)
    good = good.where((F.try_divide("alnlen", "qlen") >= coverage) & (F.try_divide("alnlen", "tlen") >= coverage))
    return good.groupBy(F.least("query", "target").alias("src"), F.greatest("query", "target").alias("dst")).agg(F.max("pident").alias("pident"), F.max("alnlen").cast("long").alias("alnlen"))
