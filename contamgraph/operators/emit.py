"""Examples to typed nodes and edges.

``examples`` columns: source, target, row_idx, entity (canonical text or key, may
be null), scaffold (may be null or empty), label, label_type, split, ext_id.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph.functions import keys, props
from contamgraph.operators.relational import sent, stable_distinct
from contamgraph.operators.stars import Stars
from contamgraph.plans.lineage import cut


def with_ids(examples: DataFrame) -> DataFrame:
    """Example, entity and scaffold ids; an example without an entity has neither of the latter."""
    return examples.withColumns(
        {
            "example_id": keys.example_id(F.col("source"), F.col("target"), F.col("row_idx")),
            "ligand_id": keys.ligand_id(F.col("entity")),
            "scaffold_id": F.when(F.col("entity").isNotNull(), keys.scaffold_id(F.col("scaffold"))),
            "target_id": keys.target_id(F.col("source"), F.col("target")),
            "source_id": F.concat(F.lit("src:"), F.col("source")),
            "split_id": keys.split_id(F.col("source"), F.col("split")),
            "label_type_id": F.concat(F.lit("lt:"), F.col("label_type")),
        }
    )


_DIGEST = F.xxhash64


def repeated(examples: DataFrame) -> DataFrame:
    """(digest): digests of the example ids that several rows have, equal digests of other ids included.

    Digests meet, not ids; the result serves ``emit_nodes`` and ``emit_edges`` of the same rows.
    """
    digest = with_ids(examples).select(_DIGEST("example_id").alias("digest")).repartition("digest")  # nothing to combine before
    return cut(digest.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))


def _parted(e: DataFrame, again: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Rows whose example id no other row has (None: not known), and all others."""
    if again is None:
        return None, e
    if again.isEmpty():
        return e, e.where(F.lit(False))
    again = sent(again.withColumnRenamed("digest", "_digest"))
    named = e.withColumn("_digest", _DIGEST("example_id"))
    return tuple(named.join(again, "_digest", how).drop("_digest") for how in ("left_anti", "left_semi"))


def described(examples: DataFrame) -> DataFrame:
    """Few rows of the form of ``examples`` that have all of their values but those of an example's own."""
    groups = (("entity", "scaffold"), ("source", "target"), ("source", "split", "label_type"))
    names = ("source", "target", "entity", "scaffold", "label_type", "split")
    row = lambda own: F.struct(*((F.col(c) if c in own else F.lit(None).cast("string")).alias(c) for c in names))
    return examples.select(F.inline(F.array(*map(row, groups)))).distinct().withColumn("row_idx", F.lit(None).cast("string"))


def _example(rows: DataFrame, *more: Column) -> DataFrame:
    c = F.col
    return rows.select(
        c("example_id").alias("node_id"), F.lit("Example").alias("node_type"), F.coalesce("ext_id", F.lit("")).alias("label"),
        props.props(label=c("label"), target=c("target"), source=c("source")).alias("props"), *more,
    )


def _dimension(e: DataFrame) -> DataFrame:
    """Nodes of all that examples name, one row an id."""
    c = F.col
    scaffold = F.coalesce(c("scaffold"), F.lit(""))
    raw = lambda i, kind, label, v=None: F.struct(c(i).alias("node_id"), F.lit(kind).alias("node_type"), F.coalesce(label, F.lit("")).alias("label"), (F.lit(None).cast("string") if v is None else v).alias("v"))
    shared = F.array(
        raw("ligand_id", "Ligand", c("entity"), scaffold), raw("scaffold_id", "Scaffold", scaffold), raw("target_id", "ProteinTarget", c("target"), c("source")),
        raw("source_id", "DatasetSource", c("source")), raw("split_id", "Split", c("split")), raw("label_type_id", "LabelType", c("label_type")),
    )
    told = (
        F.when(c("node_type") == "Ligand", props.props(scaffold_smiles=c("v"))).when(c("node_type") == "Scaffold", props.props(is_empty=c("label") == ""))
        .when(c("node_type") == "ProteinTarget", props.props(source=c("v"))).otherwise(props.empty())
    )
    dimension = e.select(F.inline(shared)).where("node_id is not null").distinct().select("node_id", "node_type", "label", told.alias("props"))
    return stable_distinct(dimension, ["node_id", "node_type"]).select("node_id", "node_type", "label", "props")


def emit_nodes(examples: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """All nodes, one row an id.

    Dimension nodes (few, repeated on every example) collapse as raw keys in a hash
    aggregation before their properties are written; only example nodes, which
    seldom repeat, go to the ordered dedup in number, and with ``again`` (what
    ``repeated`` found) only those that may repeat.
    """
    e = with_ids(examples)
    once, more = _parted(e.where("example_id is not null"), again)
    nodes = stable_distinct(_example(more), ["node_id", "node_type"]).select("node_id", "node_type", "label", "props").unionByName(_dimension(e))
    return nodes if once is None else nodes.unionByName(_example(once))


#: Edge types of an example and of a ligand: the columns of both ends.
_OF_EXAMPLE = {
    "example_has_ligand": ("example_id", "ligand_id"), "example_has_protein_target": ("example_id", "target_id"), "example_from_source": ("example_id", "source_id"),
    "example_in_split": ("example_id", "split_id"), "example_has_label_type": ("example_id", "label_type_id"),
}
_OF_LIGAND = {"ligand_has_scaffold": ("ligand_id", "scaffold_id")}


def _edges(e: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    edge = lambda a, b, kind: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"))
    return e.select(F.inline(F.array(*(edge(a, b, kind) for kind, (a, b) in types.items())))).where("src is not null and dst is not null")


def emit_edges(examples: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """All edges of the examples, one row a (src, dst, type).

    With ``again`` (what ``repeated`` found), only rows whose example id may repeat are
    deduplicated as edges: the edges of another example differ in type and from all others in source.
    """
    e = with_ids(examples)
    once, more = _parted(e, again)
    if once is None:
        out = _edges(more, _OF_EXAMPLE | _OF_LIGAND).distinct()
    else:
        out = _edges(once, _OF_EXAMPLE).unionByName(_edges(more, _OF_EXAMPLE).distinct()).unionByName(_edges(e, _OF_LIGAND).distinct())
    return out.withColumn("props", props.empty())


def emit_stars(examples: DataFrame) -> tuple[Stars, DataFrame, DataFrame]:
    """The graph of ``emit_nodes`` and ``emit_edges`` with a star for each example whose id does
    not repeat; all other nodes and edges follow as tables of their own."""
    once, more = _parted(with_ids(examples), repeated(examples))
    ends = [F.col(b).alias(kind) for kind, (_, b) in _OF_EXAMPLE.items()]
    stars = Stars(_example(once, *ends).drop("node_type"), tuple(_OF_EXAMPLE))
    few = with_ids(cut(described(examples)))
    nodes = stable_distinct(_example(more), ["node_id", "node_type"]).select("node_id", "node_type", "label", "props").unionByName(_dimension(few))
    edges = _edges(more, _OF_EXAMPLE).distinct().unionByName(_edges(few, _OF_LIGAND).distinct())
    return stars, nodes, edges.withColumn("props", props.empty())


def merge_corpora(parts: dict[str, DataFrame], required: tuple[str, ...], keys_: list[str]) -> DataFrame:
    """Union of the corpora by name, one row a key; raises if one is missing."""
    missing = [c for c in required if c not in parts]
    if missing:
        raise ValueError(f"missing corpora: {', '.join(missing)}")
    return stable_distinct(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values()), keys_)


def identity_star(entities: DataFrame, key: str, node: str = "node_id", full_key: str | None = None) -> DataFrame:
    """Star edges (src = smallest member, dst = another) in each group of equal keys.

    With ``full_key``, members whose full key is the anchor's are left out: they
    are linked by the full key already.
    """
    cols = [node] + ([full_key] if full_key else [])
    known = entities.where(F.col(key).isNotNull()).select(key, *cols).distinct()
    anchor = known.groupBy(key).agg(F.min(F.struct(*cols)).alias("a"))
    pairs = known.join(anchor, key).where(F.col(node) != F.col(f"a.{node}"))
    if full_key:
        pairs = pairs.where(~F.col(full_key).eqNullSafe(F.col(f"a.{full_key}")))
    return pairs.select(F.col(f"a.{node}").alias("src"), F.col(node).alias("dst"), key)


def provenance_level(assay: Column, document: Column, activity: Column) -> Column:
    """How far an activity can be traced back."""
    return (
        F.when(assay.isNotNull() & document.isNotNull(), "full").when(document.isNotNull(), "document").when(activity.isNotNull(), "activity").otherwise("none")
    )
