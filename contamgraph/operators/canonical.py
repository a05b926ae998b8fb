"""Stages of the canonical graph: pure functions over (nodes, edges) DataFrames.

``STAGES`` lists them in the order that their results depend on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph import schema
from contamgraph.functions import keys, props
from contamgraph.operators.relational import rewrite_ids, stable_distinct, value_map

Graph = tuple[DataFrame, DataFrame]


def map_schema(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Canonical type names; types the canonical graph does not know are dropped."""
    n = nodes.withColumn("node_type", value_map(F.col("node_type"), schema.NODE_MAP)).where(F.col("node_type").isin(*schema.NODE_PREFIXES))
    e = edges.withColumn("edge_type", value_map(F.col("edge_type"), schema.EDGE_MAP)).where(F.col("edge_type").isin(*schema.weights()))
    return n, e


def dropped_types(nodes: DataFrame) -> DataFrame:
    """(node_type, n) of what ``map_schema`` drops."""
    mapped = value_map(F.col("node_type"), schema.NODE_MAP)
    return nodes.where(~mapped.isin(*schema.NODE_PREFIXES)).groupBy("node_type").agg(F.count("*").alias("n"))


def normalise_proteins(nodes: DataFrame, edges: DataFrame) -> Graph:
    """``tgt:<source>:<accession>`` becomes ``protein:<accession>``."""
    return apply_id_map(nodes, edges, accession_map(nodes))


def accession_map(nodes: DataFrame) -> DataFrame:
    """(old_id, new_id) of proteins whose id ends in an accession."""
    acc = F.nullif(F.regexp_extract("node_id", r"^tgt:[^:]*:(.*)$", 1), F.lit(""))
    return nodes.where("node_type = 'Protein'").where(keys.is_accession(acc)).select(F.col("node_id").alias("old_id"), F.concat(F.lit("protein:"), acc).alias("new_id"))


def apply_id_map(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, node_type: str | None = None) -> Graph:
    """Rename nodes and both ends of edges; nodes that meet are one.  Renamed nodes become ``node_type``, if given."""
    m = mapping.groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    kind = F.col("node_type") if node_type is None else F.when(F.col("new_id").isNotNull(), node_type).otherwise(F.col("node_type"))
    n = nodes.join(m, nodes["node_id"] == m["old_id"], "left").select(F.coalesce("new_id", "node_id").alias("node_id"), kind.alias("node_type"), "label", "props")
    return stable_distinct(n, ["node_id"]).select("node_id", "node_type", "label", "props"), rewrite_ids(edges, m)


def apply_protein_map(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> Graph:
    """Targets and malformed protein ids to their proteins."""
    return apply_id_map(nodes, edges, mapping, "Protein")


def add_clusters(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> Graph:
    """Cluster nodes and edges from ``(protein_id, cluster_id, resolution)`` for known proteins."""
    c = clusters.join(nodes.where("node_type = 'Protein'").select(F.col("node_id").alias("protein_id")), "protein_id", "left_semi")
    cid = F.concat_ws("::", F.lit("ProteinCluster"), F.col("resolution").cast("string"), F.col("cluster_id"))
    n = c.select(cid.alias("node_id"), F.lit("ProteinCluster").alias("node_type"), F.col("cluster_id").alias("label"), props.props(resolution=F.col("resolution")).alias("props")).distinct()
    e = c.select(F.col("protein_id").alias("src"), cid.alias("dst"), F.concat(F.lit("protein_cluster_"), F.col("resolution").cast("string")).alias("edge_type"), props.props(resolution=F.col("resolution")).alias("props")).distinct()
    return nodes.unionByName(n), edges.unionByName(e)


def add_protein_exact(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> Graph:
    """protein_exact edges from ``(src, dst, pident, alnlen)`` between known proteins."""
    known = nodes.where("node_type = 'Protein'").select("node_id")
    for end in ("src", "dst"):
        pairs = pairs.join(known.withColumnRenamed("node_id", end), end, "left_semi")
    a, b = keys.pair(F.col("src"), F.col("dst"))
    e = pairs.select(a.alias("src"), b.alias("dst"), F.lit("protein_exact").alias("edge_type"), props.props(pident=F.col("pident"), alnlen=F.col("alnlen")).alias("props"))
    return nodes, edges.unionByName(stable_distinct(e, ["src", "dst", "edge_type"]).select(*edges.columns))


def scaffold_map(flat: DataFrame) -> DataFrame:
    """(old_id, new_id): each scaffold of ``flat(node_id, flat)`` and the smallest id with its flat text."""
    keep = flat.groupBy("flat").agg(F.min("node_id").alias("new_id"))
    return flat.join(keep, "flat").select(F.col("node_id").alias("old_id"), "new_id")


def merge_scaffolds(nodes: DataFrame, edges: DataFrame, flat: DataFrame) -> Graph:
    """Scaffolds with equal flat text ``(node_id, flat)`` become the one with the smallest id, labelled by the flat text."""
    group = flat.groupBy("flat").agg(F.min("node_id").alias("keep"), F.count("*").alias("n"))
    n, e = apply_id_map(nodes, edges, scaffold_map(flat))
    label = group.select(F.col("keep").alias("node_id"), F.col("flat").alias("_flat"), (F.col("n") > 1).alias("_merged"))
    n = n.join(label, "node_id", "left").select(
        "node_id", "node_type", F.coalesce("_flat", "label").alias("label"),
        F.when(F.col("_merged"), props.spliced(F.col("props"), {"stereo_merged": F.lit("true")})).otherwise(F.col("props")).alias("props"),
    )
    return n, e


def one_scaffold(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Each ligand keeps the scaffold with the smallest id."""
    own = edges.where("edge_type = 'ligand_scaffold'")
    kept = own.groupBy("src").agg(F.min(F.struct("dst", "edge_type", "props")).alias("r")).select("src", "r.*").select(*edges.columns)
    return nodes, edges.where("edge_type <> 'ligand_scaffold'").unionByName(kept)


def split_exact_similarity(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Similar pairs at the exact floor or above are fingerprint-exact."""
    t = props.number("props", "tanimoto")
    kind = F.when((F.col("edge_type") == "ligand_similar") & (t >= schema.EXACT_FLOOR), "ligand_fingerprint_exact").otherwise(F.col("edge_type"))
    return nodes, edges.withColumn("edge_type", kind)


def sort_pairs(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Unordered pair edges in sorted order, once, without loops."""
    is_pair = F.col("edge_type").isin(*schema.PAIR_EDGES)
    a, b = keys.pair(F.col("src"), F.col("dst"))
    own = edges.where(is_pair).where("src <> dst").select(a.alias("src"), b.alias("dst"), "edge_type", "props")
    return nodes, edges.where(~is_pair).unionByName(stable_distinct(own, ["src", "dst", "edge_type"]).select(*edges.columns))


def drop_without_ligand(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Examples without a ligand go, and their edges with them."""
    linked = edges.where("edge_type = 'example_has_ligand'").select(F.col("src").alias("node_id")).distinct()
    gone = nodes.where("node_type = 'Example'").join(linked, "node_id", "left_anti").select("node_id")
    return nodes.join(gone, "node_id", "left_anti"), edges.join(gone, edges["src"] == gone["node_id"], "left_anti")


def decoy_tiers(nodes: DataFrame, edges: DataFrame, protocols: DataFrame) -> Graph:
    """Two-tier decoy protocol for inactive examples of the corpora in ``(source, method, description)``."""
    ex = nodes.where("node_type = 'Example'").select("node_id", props.text("props", "source").alias("source"), props.text("props", "label").alias("label"))
    own = ex.where("label = '0'").join(F.broadcast(protocols), "source")
    pid, cid = F.concat(F.lit("proto:"), F.col("source")), F.concat(F.lit("protoclass:"), F.col("method"))
    used = own.select("source", "method", "description").distinct()
    n = used.select(pid.alias("node_id"), F.lit("DecoyProtocol").alias("node_type"), F.col("description").alias("label"), props.props(corpus=F.col("source"), method=F.col("method")).alias("props"))
    n = n.unionByName(used.select(cid.alias("node_id"), F.lit("DecoyProtocolClass").alias("node_type"), F.col("method").alias("label"), props.props(kind=F.lit("decoy")).alias("props")).distinct())
    e = own.select(F.col("node_id").alias("src"), pid.alias("dst"), F.lit("source_decoy_protocol").alias("edge_type"), props.empty().alias("props"))
    e = e.unionByName(used.select(pid.alias("src"), cid.alias("dst"), F.lit("decoy_protocol_in_class").alias("edge_type"), props.empty().alias("props")).distinct())
    return nodes.where("node_type not in ('DecoyProtocol', 'DecoyProtocolClass')").unionByName(n), edges.where("edge_type not in ('source_decoy_protocol', 'decoy_protocol_in_class')").unionByName(e)


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return nodes, e.select("src", "dst", "edge_type", "props")


def split_relation(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> Graph:
    """Two relations in example_has_protein come apart: an example's target, and what its ligand was measured on.

    ``mapping(old_id, new_id)`` names the protein of each target.  Of an example whose target it
    holds, edges to other proteins move to ligand_measured_protein of the example's ligand;
    edges of examples whose target it does not hold stay.
    """
    m = mapping.groupBy(F.col("old_id").alias("_target")).agg(F.min("new_id").alias("_protein"))
    is_target = F.col("edge_type") == "example_has_protein"
    part = lambda i: F.split_part("src", F.lit(":"), F.lit(i))
    named = edges.where(is_target).withColumn("_target", keys.target_id(part(2), part(3))).join(m, "_target", "left")
    own = F.col("_protein").isNull() | (F.col("dst") == F.col("_protein"))
    ligand = edges.where("edge_type = 'example_has_ligand'").select("src", F.col("dst").alias("_ligand"))
    moved = named.where(~own).select("src", "dst").join(ligand, "src").select(F.col("_ligand").alias("src"), "dst").distinct()
    moved = moved.select("src", "dst", F.lit("ligand_measured_protein").alias("edge_type"), props.empty().alias("props"))
    return nodes, edges.where(~is_target).unionByName(named.where(own).select(*edges.columns)).unionByName(moved)


def drop_placeholders(nodes: DataFrame, edges: DataFrame, placeholders: DataFrame) -> Graph:
    """Publication edges of examples to the placeholders ``(node_id)`` go; nothing else does."""
    p = placeholders.select(F.col("node_id").alias("dst")).distinct()
    named = F.col("edge_type") == "example_from_publication"
    return nodes, edges.where(~named).unionByName(edges.where(named).join(p, "dst", "left_anti").select(*edges.columns))


def drop_orphans(nodes: DataFrame, edges: DataFrame, pinned: tuple[str, ...] = ("DatasetSource", "DecoyProtocol"), more: DataFrame | None = None) -> Graph:
    """Nodes that no edge names go, unless their type is pinned; ``more(node_id)`` are named by other edges."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    used = (used if more is None else used.unionByName(more.select("node_id"))).distinct()
    keep = nodes.join(used, "node_id", "left_semi").unionByName(nodes.where(F.col("node_type").isin(*pinned)).join(used, "node_id", "left_anti"))
    return keep.select(*nodes.columns), edges


def merge_sources(nodes: DataFrame, edges: DataFrame) -> Graph:
    """ligand_measured_protein once a pair, its sources merged in sorted order with ``+``."""
    own = edges.where("edge_type = 'ligand_measured_protein'").withColumn("s", props.text("props", "source"))
    merged = own.groupBy("src", "dst", "edge_type").agg(F.array_join(F.array_sort(F.collect_set("s")), "+").alias("s"))
    merged = merged.select("src", "dst", "edge_type", props.props(source=F.nullif("s", F.lit(""))).alias("props"))
    return nodes, edges.where("edge_type <> 'ligand_measured_protein'").unionByName(merged)


def enrich_examples(nodes: DataFrame, edges: DataFrame, strict: bool = True) -> Graph:
    """label_type and split of each example into its props; raises unless every example has both."""
    def value(kind: str, prefix: str, name: str) -> DataFrame:
        own = edges.where(F.col("edge_type") == kind)
        return own.groupBy(F.col("src").alias("node_id")).agg(F.min(F.regexp_replace("dst", f"^{prefix}", "")).alias(name))

    ex = nodes.where("node_type = 'Example'").join(value("example_has_label_type", "lt:", "lt"), "node_id", "left").join(value("example_in_split", "split:", "sp"), "node_id", "left")
    if strict:
        bad = ex.agg(F.count_if(F.col("lt").isNull() | F.col("sp").isNull())).first()[0]
        if bad:
            raise ValueError(f"{bad} examples lack a label type or a split")
    done = ex.withColumn("props", F.coalesce(props.spliced(F.col("props"), {"label_type": F.col("lt"), "split": F.col("sp")}), "props"))
    return nodes.where("node_type <> 'Example'").unionByName(done.select(*nodes.columns)), edges


def with_scaffold_size(nodes: DataFrame, edges: DataFrame, size: Column) -> Graph:
    """``n_heavy_atoms`` of each scaffold into its props; ``size`` is computed from its label."""
    body = props.spliced(F.col("props"), {"n_heavy_atoms": size.cast("string")}, quoted=False)
    return nodes.withColumn("props", F.when(F.col("node_type") == "Scaffold", F.coalesce(body, "props")).otherwise(F.col("props"))), edges


def one_example_protein(nodes: DataFrame, edges: DataFrame) -> Graph:
    """example_has_protein once for each pair, whatever its props."""
    own = F.col("edge_type") == "example_has_protein"
    kept = stable_distinct(edges.where(own).select("src", "dst", "edge_type", "props"), ["src", "dst", "edge_type"])
    return nodes, edges.where(~own).unionByName(kept.select(*edges.columns))


def with_degree(nodes: DataFrame, edges: DataFrame, more: DataFrame | None = None) -> Graph:
    """In plus out count of every node; 0 where no edge names it.  ``more(node_id, k)`` are counts of other edges."""
    ends = counted_ends(edges, more).withColumnRenamed("k", "degree")
    n = nodes.join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return n, edges


def counted_ends(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(node_id, k): how many ends of edges name each id, with the counts ``more(node_id, k)`` of other edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    if more is None:
        return ends.groupBy("node_id").agg(F.count("*").alias("k"))
    return ends.withColumn("k", F.lit(1).cast("long")).unionByName(more.select("node_id", "k")).groupBy("node_id").agg(F.sum("k").alias("k"))


#: The stages that need no side tables, in order.
STAGES = (map_schema, normalise_proteins, one_scaffold, split_exact_similarity, sort_pairs, drop_without_ligand, prune_dangling, one_example_protein, drop_orphans, merge_sources, enrich_examples, with_degree)


def canonicalise(nodes: DataFrame, edges: DataFrame, protein_map: DataFrame | None = None) -> Graph:
    """All stages, with lineage cut where the edges are smallest and before the degree count.

    With ``protein_map(old_id, new_id)``, proteins are renamed and example_has_protein is split by it.
    """
    from contamgraph.plans.lineage import cut

    for stage in STAGES:
        nodes, edges = stage(nodes, edges)
        if stage is normalise_proteins and protein_map is not None:
            nodes, edges = apply_protein_map(nodes, edges, protein_map)
        if stage is prune_dangling and protein_map is not None:
            nodes, edges = split_relation(nodes, edges, protein_map)
        if stage in (prune_dangling, merge_sources):
            nodes, edges = cut(nodes), cut(edges)
    return nodes, edges
