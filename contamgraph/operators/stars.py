"""Examples with their edges, a row each, and the canonical stages on them.

A graph may keep examples as stars beside its tables of nodes and edges: one row an
example, with the end of its edge of each type (null: none).  The edges have no
properties, no other edge names the example, and its id starts like an example's.
Stages that look at one example then move nothing; only counts of ends meet.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph import schema
from contamgraph.functions import props
from contamgraph.operators import canonical
from contamgraph.operators.relational import sent
from contamgraph.plans.lineage import cut


@dataclass(frozen=True)
class Stars:
    """``rows(node_id, label, props, ...)`` with a column of ends for each of ``types``.

    ``few`` are types that have few ends together; they are counted as one.
    """

    rows: DataFrame
    types: tuple[str, ...]
    few: tuple[str, ...] = ()

    def degree(self) -> Column:
        return reduce(lambda a, b: a + b, (F.col(t).isNotNull().cast("long") for t in self.types), F.lit(0).cast("long"))

    def ends(self) -> DataFrame:
        """(edge_type, node_id, k): how many stars have each end; null ends are counted, too."""
        groups = [g for g in (self.few, *((t,) for t in self.types if t not in self.few)) if g]
        row = lambda i, own: F.struct(F.lit(i).alias("_group"), *((F.col(t) if t in own else F.lit(None).cast("string")).alias(t) for t in self.types))
        met = self.rows.select(F.inline(F.array(*(row(i, g) for i, g in enumerate(groups))))).groupBy("_group", *self.types).agg(F.count("*").alias("k"))
        end = lambda g: F.array(*(F.struct(F.lit(t).alias("edge_type"), F.col(t).alias("node_id")) for t in g))
        ends = reduce(lambda a, i: a.when(F.col("_group") == i, end(groups[i])), range(1, len(groups)), F.when(F.col("_group") == 0, end(groups[0])))
        return met.select("k", F.inline(ends)).groupBy("edge_type", "node_id").agg(F.sum("k").alias("k"))

    def counts(self) -> DataFrame:
        """(node_id, k): the ends of all types."""
        return self.ends().where("node_id is not null").select("node_id", "k")

    def flat(self) -> tuple[DataFrame, DataFrame]:
        """The same examples and edges as tables of nodes and edges."""
        nodes = self.rows.drop(*self.types).withColumn("node_type", F.lit("Example"))
        edge = F.array(*(F.struct(F.col("node_id").alias("src"), F.col(t).alias("dst"), F.lit(t).alias("edge_type"), props.empty().alias("props")) for t in self.types))
        first = ["node_id", "node_type", "label", "props"]
        return nodes.select(*first, *(c for c in nodes.columns if c not in first)), self.rows.select(F.inline(edge)).where("dst is not null")


def map_schema(stars: Stars) -> Stars:
    """Canonical names of edge types; types the canonical graph does not know are dropped."""
    new = {t: schema.EDGE_MAP.get(t, t) for t in stars.types}
    kept = [t for t in stars.types if new[t] in schema.weights()]
    own = [t for t in kept if schema.endpoints().get(new[t], ("",))[0] != "Example"]
    if own or len({new[t] for t in kept}) < len(kept):
        raise ValueError(f"no star can be made of the edge types {', '.join(own or kept)}")
    rows = stars.rows.drop(*(t for t in stars.types if t not in kept))
    return Stars(rows.withColumnsRenamed({t: new[t] for t in kept}), tuple(new[t] for t in kept))


def rename_ends(stars: Stars, mapping: DataFrame) -> Stars:
    """Ends through ``mapping(old_id, new_id)``; unmapped ids stay."""
    one = cut(mapping.groupBy("old_id").agg(F.min("new_id").alias("new_id")))
    if one.isEmpty():
        return stars
    rows, one = stars.rows, sent(one)
    for t in stars.types:
        rows = rows.join(one.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")), F.col(t) == F.col("_old"), "left").withColumn(t, F.coalesce("_new", t)).drop("_old", "_new")
    return replace(stars, rows=rows)


def drop_ends(stars: Stars, gone: DataFrame) -> Stars:
    """Edges that end in ``gone(node_id)`` go."""
    rows, gone = stars.rows, sent(gone)
    for t in stars.types:
        rows = rows.join(gone.select(F.col("node_id").alias("_gone")), F.col(t) == F.col("_gone"), "left").withColumn(t, F.when(F.col("_gone").isNull(), F.col(t))).drop("_gone")
    return replace(stars, rows=rows)


#: Combinations of ends that are counted as one at most.
_TOGETHER = 10_000


def with_few(stars: Stars, nodes: DataFrame) -> Stars:
    """Types whose ends have few nodes, by the contract's node type of their ends, are counted together."""
    n = {r["node_type"]: r["count"] + 1 for r in nodes.groupBy("node_type").count().collect()}
    few, product = [], 1
    for t in sorted(stars.types, key=lambda t: n.get(schema.endpoints()[t][1], 1)):
        product *= n.get(schema.endpoints()[t][1], 1)
        if product <= _TOGETHER:
            few.append(t)
    return replace(stars, few=tuple(few))


def canonicalise(stars: Stars, nodes: DataFrame, edges: DataFrame, strict: bool = True) -> tuple[Stars, DataFrame, DataFrame]:
    """All of ``canonical.STAGES``, with the same result as on the flat graph.

    An example's own stages are expressions on its row.  Ends are counted by id once: an end
    without a node is dropped from the stars and from the counts, so these stay true.
    """
    end = lambda t: F.col(t) if t in stars.types else F.lit(None).cast("string")
    stars, (nodes, edges) = map_schema(stars), canonical.map_schema(nodes, edges)
    mapping = cut(canonical.accession_map(nodes))
    stars, (nodes, edges) = rename_ends(stars, mapping), canonical.apply_id_map(nodes, edges, mapping)
    for stage in (canonical.one_scaffold, canonical.split_exact_similarity, canonical.sort_pairs, canonical.drop_without_ligand, canonical.prune_dangling):
        nodes, edges = stage(nodes, edges)
    nodes, edges = cut(nodes), cut(edges)
    stars = replace(stars, rows=stars.rows.where(end("example_has_ligand").isNotNull()))
    stars = with_few(stars, nodes)
    counts = cut(stars.ends())
    named = counts.where("node_id is not null")
    gone = cut(named.join(nodes, "node_id", "left_anti").select("node_id").distinct())
    whole = gone.isEmpty()
    if not whole:
        stars, named = drop_ends(stars, gone), named.join(gone, "node_id", "left_anti")
        stars = replace(stars, rows=stars.rows.where(stars.degree() > 0))
    nodes, edges = canonical.one_example_protein(nodes, edges)
    nodes, edges = canonical.drop_orphans(nodes, edges, more=named)
    nodes, edges = canonical.merge_sources(nodes, edges)
    nodes, edges = cut(nodes), cut(edges)
    kind, split = end("example_has_label_type"), end("example_in_split")
    told = {"example_has_label_type", "example_in_split"}
    if strict and (not whole or not told <= set(stars.types) or not counts.where("node_id is null").where(F.col("edge_type").isin(*told)).isEmpty()):
        bad = stars.rows.agg(F.count_if(kind.isNull() | split.isNull())).first()[0]
        if bad:
            raise ValueError(f"{bad} examples lack a label type or a split")
    nodes, edges = canonical.enrich_examples(nodes, edges, strict)
    more = {"label_type": F.regexp_replace(kind, "^lt:", ""), "split": F.regexp_replace(split, "^split:", "")}
    rows = stars.rows.withColumn("props", F.coalesce(props.spliced(F.col("props"), more), "props")).withColumn("degree", stars.degree())
    return replace(stars, rows=rows), *canonical.with_degree(nodes, edges, named)
