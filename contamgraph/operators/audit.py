"""Audit checks: each gives a row (check, n_bad, passed)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph import schema
from contamgraph.functions import keys, props
from contamgraph.operators.canonical import counted_ends
from contamgraph.operators.relational import sent
from contamgraph.operators.stars import Stars
from contamgraph.plans.lineage import cut


def _row(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), "n_bad", (F.col("n_bad") == 0).alias("passed"))


def _totals(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check from one global aggregation."""
    total = df.agg(*(F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in checks.items()))
    rows = total.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks))))
    return rows.withColumn("passed", F.col("n_bad") == 0)


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _report(checks: dict[str, DataFrame]) -> DataFrame:
    return _union(*(_row(k, v) for k, v in checks.items()))


def _added(*parts: DataFrame) -> DataFrame:
    """A row for each check, its counts summed over the parts."""
    return _union(*parts).groupBy("check").agg(F.sum("n_bad").alias("n_bad")).withColumn("passed", F.col("n_bad") == 0)


def _of_stars(stars: Stars, ids: DataFrame) -> DataFrame:
    """Which of ``ids(node_id, k)`` are stars: the ids that begin like one are looked for among these, if there are any."""
    begun = cut(ids.where(F.startswith("node_id", F.lit(schema.NODE_PREFIXES["Example"]))).select("node_id", "k"))
    return begun if begun.isEmpty() else cut(stars.rows.select("node_id").join(sent(begun), "node_id").groupBy("node_id").agg(F.min("k").alias("k")))


def _by_id(nodes: DataFrame, edges: DataFrame, of_node: dict[str, Column], of_src: dict[str, Column], of_dst: dict[str, Column]) -> DataFrame:
    """Sums of 0/1 columns over the rows that name an id, as a node, as a source, as a destination."""
    names = [*of_node, *of_src, *of_dst]

    def part(df: DataFrame, i: str, own: dict[str, Column]) -> DataFrame:
        return df.select(F.col(i).alias("id"), *((own[c].cast("int") if c in own else F.lit(0)).alias(c) for c in names))

    rows = part(nodes, "node_id", of_node)
    for i, own in (("src", of_src), ("dst", of_dst)):
        if own:
            rows = rows.unionByName(part(edges, i, own))
    return rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in names))


def structural(nodes: DataFrame, edges: DataFrame, pinned: tuple[str, ...] = ("DatasetSource", "DecoyProtocol")) -> DataFrame:
    """Ids, prefixes, loops, dangling ends, repeated triples and orphans: one aggregation by id, one by triple."""
    one, c = F.lit(1), F.col
    ids = _by_id(nodes, edges, {"n": one, "free": ~c("node_type").isin(*pinned), "bare": ~F.contains("node_id", F.lit(":"))}, {"s": one}, {"d": one})
    triples = edges.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("k"))
    return _union(
        _totals(ids, {
            "duplicate_node_id": F.count_if(c("n") > 1), "id_without_prefix": F.sum("bare"), "dangling_src": F.sum(F.when(c("n") == 0, c("s"))),
            "dangling_dst": F.sum(F.when(c("n") == 0, c("d"))), "orphan": F.sum(F.when((c("s") == 0) & (c("d") == 0), c("free"))),
        }),
        _totals(triples, {"duplicate_triple": F.count_if(c("k") > 1), "self_loop": F.sum(F.when(c("src") == c("dst"), c("k")))}),
    )


def degree_recorded(nodes: DataFrame) -> DataFrame:
    """Nodes record their degree, a fact, and not whether they are hubs, a policy."""
    bad = int("degree" not in nodes.columns or "is_hub" in nodes.columns)
    return nodes.sparkSession.createDataFrame([("degree_not_hub", bad, not bad)], "check string, n_bad long, passed boolean")


def endpoint_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by type and endpoint types, with whether the contract allows them."""
    kind = nodes.select("node_id", "node_type")
    named = edges.select("src", "dst", "edge_type")
    e = named.join(kind.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), "src").join(kind.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type")), "dst")
    allowed = reduce(
        lambda a, b: a | b,
        ((F.col("edge_type") == k) & (F.col("src_type") == a) & (F.col("dst_type") == b) for k, (a, b) in schema.endpoints().items()),
    )
    return e.groupBy("edge_type", "src_type", "dst_type").agg(F.count("*").alias("n")).withColumn("allowed", allowed)


def cardinality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One ligand, source and protein an example; at most one scaffold a ligand; pairs sorted; known weights.

    One aggregation by source id, one pass over the edges.
    """
    c = F.col
    kinds = {"one_ligand": "example_has_ligand", "one_source": "example_from_source", "one_protein": "example_has_protein", "one_scaffold": "ligand_scaffold"}
    own = edges.where(c("edge_type").isin(*kinds.values()))
    ids = _by_id(nodes.where("node_type = 'Example'"), own, {"ex": F.lit(1)}, {k: c("edge_type") == v for k, v in kinds.items()}, {})
    checks = {k: F.sum(F.when(c(k) != 1, c("ex"))) for k in kinds if k != "one_scaffold"}
    return _union(
        _totals(ids, checks | {"one_scaffold": F.count_if(c("one_scaffold") > 1)}),
        _totals(edges, {
            "pairs_sorted": F.count_if(c("edge_type").isin(*schema.PAIR_EDGES) & (c("src") >= c("dst"))), "weight_declared": F.count_if(~c("edge_type").isin(*schema.weights())),
        }),
    )


def semantics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Clustered proteins reach every example, scaffolds are unique without stereo marks, decoy
    protocols link inactives alone, and a protocol class spans corpora (n_bad 1 if none does)."""
    c = F.col
    relation = lambda t: edges.where(c("edge_type") == t)
    clustered = edges.where(F.startswith("edge_type", F.lit("protein_cluster_"))).select(c("src").alias("dst"), F.lit(1).alias("seen")).distinct()
    seen = relation("example_has_protein").select("src", "dst").join(clustered, "dst", "left").groupBy("src").agg(F.max("seen").alias("seen"))
    flat = nodes.where("node_type = 'Scaffold'").groupBy(keys.stereo_free_text(c("label")).alias("flat")).agg(F.count("*").alias("k"))
    active = nodes.where("node_type = 'Example'").where(props.text("props", "label") == "1").select(c("node_id").alias("src"))
    decoy = relation("source_decoy_protocol").select("src", c("dst").alias("protocol"))
    source = relation("example_from_source").select("src", c("dst").alias("corpus"))
    cls = relation("decoy_protocol_in_class").select(c("src").alias("protocol"), c("dst").alias("class"))
    span = decoy.join(source, "src").select("protocol", "corpus").distinct().join(cls, "protocol").groupBy("class").agg(F.count_distinct("corpus").alias("k"))
    return _union(
        _totals(seen, {"protein_family_visible": F.count_if(c("seen").isNull())}), _totals(flat, {"scaffold_stereo_duplicate": F.sum(F.greatest(c("k") - 1, F.lit(0)))}),
        _row("decoy_links_active", decoy.join(active, "src", "left_semi")), _totals(span, {"class_spans_corpora": F.when(F.count_if(c("k") > 1) == 0, 1).otherwise(0)}),
    )


def facts(nodes: DataFrame, edges: DataFrame, stars: Stars | None = None) -> DataFrame:
    """Degree recount, similarity range, disjoint pair types, labels, label types and splits.

    ``stars`` are examples kept apart: their own checks are one pass, and only the ends of their
    edges are counted by id.  They have no edge of a pair type.
    """
    c = F.col
    t, kind = props.number("props", "tanimoto"), c("edge_type")
    n = nodes.select("node_id", F.col("degree").alias("told"))
    ids = counted_ends(edges, None if stars is None else stars.counts())
    pairs = edges.where(kind.isin("ligand_parent_exact", "ligand_exact")).groupBy("src", "dst").agg(F.count_if(kind == "ligand_parent_exact").alias("parent"), F.count_if(kind == "ligand_exact").alias("same"))
    of_example = lambda label, known, split: {
        "label_binary": F.count_if(label.isNull() | ~label.isin("0", "1")), "label_type_known": F.count_if(known.isNull() | ~known.isin(*schema.LABEL_TYPES)),
        "split_present": F.count_if(split.isNull()),
    }
    examples = _totals(nodes.where("node_type = 'Example'"), of_example(*(props.text("props", x) for x in ("label", "label_type", "split"))))
    own = _union(_row("degree_recount", n.join(ids, "node_id", "left").where("told <> coalesce(k, 0)")), examples)
    if stars is not None:
        rows, degree, more = stars.rows, stars.degree(), _of_stars(stars, counted_ends(edges))
        if not more.isEmpty():
            rows, degree = rows.join(sent(more), "node_id", "left"), degree + F.coalesce(c("k"), F.lit(0))
        told = rows.select((c("degree") != degree).alias("_wrong"), F.json_tuple("props", "label", "label_type", "split").alias("y", "t", "s"))  # read once
        own = _added(own, _totals(told, {"degree_recount": F.count_if("_wrong")} | of_example(c("y"), c("t"), c("s"))))
    return _union(
        own,
        _totals(edges, {
            "similarity_range": F.count_if((kind == "ligand_similar") & (t.isNull() | (t < schema.SIMILARITY_FLOOR) | (t >= schema.EXACT_FLOOR))),
            "fingerprint_floor": F.count_if((kind == "ligand_fingerprint_exact") & (t.isNull() | (t < schema.EXACT_FLOOR))),
        }),
        _totals(pairs, {"parent_disjoint_from_exact": F.sum(F.when(c("same") > 0, c("parent")))}),
    )


def contract(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totality of the contract: endpoints declared for every edge type present, one similarity
    method, exactly one scaffold a ligand, both labels and all label types present and no other,
    target edges of the corpora alone, domains of a polyprotein not merged into it, axes disjoint
    from the attributes."""
    c = F.col
    kind, method = c("edge_type"), props.text("props", "method")
    similar = kind == "ligand_similar"
    used = edges.select("edge_type").distinct()
    own = edges.where("edge_type = 'ligand_scaffold'")
    ids = _by_id(nodes.where("node_type = 'Ligand'"), own, {"n": F.lit(1)}, {"k": F.lit(1)}, {})
    domain = F.contains("src", F.lit("HIV1:")) | F.contains("dst", F.lit("HIV1:"))
    ex = nodes.where("node_type = 'Example'").select(props.text("props", "label").alias("y"), props.text("props", "label_type").alias("t"))
    wrong = lambda column, want: F.size(F.array_except(F.collect_set(column), F.lit(list(want)))) + F.size(F.array_except(F.lit(list(want)), F.collect_set(column)))
    in_axis = sorted({e for es in schema.axes().values() for e in es} & set(schema.non_axis()))
    return _union(
        _row("endpoints_declared", used.where(~kind.isin(*schema.endpoints()))),
        _totals(edges, {
            "similarity_method_missing": F.count_if(similar & method.isNull()), "similarity_methods": F.greatest(F.count_distinct(F.when(similar, method)) - 1, F.lit(0)),
            "target_from_reference": F.count_if((kind == "example_has_protein") & F.contains("props", F.lit("BindingDB"))),
            "domain_merged": F.count_if((kind == "protein_exact") & domain & (props.number("props", "alnlen") > 700)),
        }),
        _totals(ids, {"scaffold_missing": F.sum(F.when(c("k") == 0, c("n")))}),
        _totals(ex, {"label_values": wrong("y", ("0", "1")), "label_type_values": wrong("t", schema.LABEL_TYPES)}),
        _totals(used.limit(1), {"attribute_in_axis": F.lit(len(in_axis))}),
    )


def completeness(nodes: DataFrame, edges: DataFrame, examples: DataFrame, links: DataFrame) -> DataFrame:
    """Exact counts against what went in: (check, want, got, passed).

    ``examples`` are the emitted rows of all corpora (one row an example), ``links(canonical_smiles,
    molregno)`` the match of corpus ligands to compounds.  Edges of examples cannot meet across
    corpora, so any difference is lost data.
    """
    from contamgraph.operators.emit import with_ids

    c = F.col
    scoped = {"example_has_ligand": "ligand_id", "example_has_protein_target": "target_id", "example_from_source": "source_id", "example_in_split": "split_id", "example_has_label_type": "label_type_id"}
    e = with_ids(examples)
    pair = F.array(*(F.struct(F.lit(k).alias("check"), F.when(c("example_id").isNotNull(), c(v)).alias("dst")) for k, v in scoped.items()))
    want = e.select("example_id", F.inline(pair)).where("dst is not null").distinct().groupBy("check").agg(F.count("*").alias("want"))
    want = want.unionByName(e.agg(F.count_distinct("example_id").alias("want")).select(F.lit("examples").alias("check"), "want"))
    want = want.unionByName(links.where("molregno is not null").agg(F.count_distinct("canonical_smiles").alias("want")).select(F.lit("linked_ligands").alias("check"), "want"))
    got = edges.where(c("edge_type").isin(*scoped)).groupBy(c("edge_type").alias("check")).agg(F.count("*").alias("got"))
    got = got.unionByName(nodes.where("node_type = 'Example'").agg(F.count("*").alias("got")).select(F.lit("examples").alias("check"), "got"))
    linked = edges.where("edge_type = 'benchmark_ligand_same_inchikey_as_chembl_ligand'")
    got = got.unionByName(linked.agg(F.count_distinct("src").alias("got")).select(F.lit("linked_ligands").alias("check"), "got"))
    out = want.join(got, "check", "full").select("check", F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("got", F.lit(0)).alias("got"))
    return out.withColumn("passed", c("want") == c("got"))


def kept_apart(edges: DataFrame, proteins: list[str]) -> DataFrame:
    """(edge_type, n_clusters, passed): do the given proteins stay in clusters of their own at every resolution?"""
    own = edges.where(F.startswith("edge_type", F.lit("protein_cluster_")) & F.col("src").isin(*proteins))
    by = own.groupBy("edge_type").agg(F.count_distinct("dst").alias("n_clusters"))
    levels = edges.sparkSession.createDataFrame([(e,) for e in schema.weights() if e.startswith("protein_cluster_")], "edge_type string")
    out = levels.join(by, "edge_type", "left").select("edge_type", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))
    return out.withColumn("passed", F.col("n_clusters") >= len(proteins))


def similarity_curve(edges: DataFrame, thresholds: tuple[float, ...] = (0.80, 0.85, 0.90, 0.95, 1.01)) -> DataFrame:
    """(threshold, n_examples, n_linked, largest, largest_pct): the largest leakage group of the ligand
    axis, with similar pairs from each threshold on; above 1, the identities alone."""
    from contamgraph.operators.leakage import largest_group, leakage_groups

    kind, t = F.col("edge_type"), props.number("props", "tanimoto")
    links = edges.where("edge_type = 'example_has_ligand'").select("src", "dst")
    examples = links.select(F.col("src").alias("node_id"))
    out = None
    for least in thresholds:
        related = edges.where(kind.isin("ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact") | ((kind == "ligand_similar") & (t >= least)))
        row = largest_group(leakage_groups(links, related), examples).select(F.lit(least).alias("threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def unpopulated(edges: DataFrame) -> DataFrame:
    """(edge_type, axis) of declared axis relations without an edge; reported apart from failures."""
    spark = edges.sparkSession
    declared = spark.createDataFrame([(e, a) for a, es in schema.axes().items() for e in es], "edge_type string, axis string")
    return declared.join(edges.select("edge_type").distinct(), "edge_type", "left_anti")


def nul_rows(df: DataFrame) -> DataFrame:
    """(column, n_bad): rows of each string column that hold a NUL character."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_bad long")
    agg = df.agg(*(F.count_if(props.has_nul(F.col(c))).alias(c) for c in names))
    return agg.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in names))).alias("r")).select("r.*")


def bad_json(df: DataFrame, column: str = "props") -> DataFrame:
    """(n_rows, n_bad): rows whose text is no JSON object."""
    kind = F.coalesce(F.json_object_keys(column).isNotNull(), F.lit(False))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~kind).alias("n_bad"))


def write_guard(nodes: DataFrame, edges: DataFrame, stars: Stars | None = None) -> DataFrame:
    """What must hold before a graph is written; ``stars`` are examples kept apart."""
    c = F.col
    any_nul = lambda columns: reduce(lambda a, b: a | b, (props.has_nul(F.col(x)) for x in columns))
    text = lambda df: any_nul(f.name for f in df.schema if f.dataType.simpleString() == "string")
    kind, bare = F.col("node_type"), F.count_if(~F.contains("node_id", F.lit(":")))
    rows = _union(
        _totals(nodes, {
            "nul_in_nodes": F.count_if(text(nodes)), "unknown_node_type": F.count_if(~kind.isin(*schema.NODE_PREFIXES)), "empty_type": F.count_if(F.coalesce(kind, F.lit("")) == ""),
            "id_without_prefix": bare,
        }),
        _totals(edges, {"nul_in_edges": F.count_if(text(edges)), "unknown_edge_type": F.count_if(~c("edge_type").isin(*schema.weights()))}),
    )
    if stars is None:
        ids = _by_id(nodes, edges, {"n": F.lit(1)}, {"s": F.lit(1)}, {"d": F.lit(1)})
        return _union(rows, _totals(ids, {"duplicate_node_id": F.count_if(c("n") > 1), "dangling": F.sum(F.when(c("n") == 0, c("s") + c("d")))}))
    total = lambda of: reduce(lambda a, b: a + b, (of(x) for x in stars.types), F.lit(0))
    own = _totals(stars.rows, {
        "nul_in_nodes": F.count_if(any_nul(("node_id", "label", "props"))), "id_without_prefix": bare,
        "nul_in_edges": F.sum(F.when(props.has_nul(c("node_id")), stars.degree()).otherwise(total(lambda x: F.coalesce(props.has_nul(c(x)).cast("long"), F.lit(0))))),
        "unknown_edge_type": F.sum(total(lambda x: F.lit(0) if x in schema.weights() else c(x).isNotNull().cast("long"))),
    })
    return _union(_added(rows, own), _row("duplicate_node_id", _repeated_ids(nodes, stars)), _totals(_dangling(nodes, edges, stars), {"dangling": F.sum("k")}))


def _repeated_ids(nodes: DataFrame, stars: Stars) -> DataFrame:
    """Ids of several nodes: digests meet first, then the ids of those that several rows have."""
    ids = [nodes.select("node_id", F.lit(0).alias("s")), stars.rows.select("node_id", F.lit(1).alias("s"))]
    met = _union(*(x.select(F.xxhash64("node_id").alias("_digest"), "s") for x in ids)).repartition("_digest")  # nothing to combine before
    met = cut(met.groupBy("_digest").agg(F.count("*").alias("n"), F.sum("s").alias("s")).where("n > 1").select("_digest", "s"))
    again = ids[0].withColumn("_digest", F.xxhash64("node_id")).join(sent(met.select("_digest")), "_digest", "left_semi").select("node_id")
    of_stars = met.where("s > 0").select("_digest")
    if not of_stars.isEmpty():
        again = again.unionByName(ids[1].withColumn("_digest", F.xxhash64("node_id")).join(sent(of_stars), "_digest", "left_semi").select("node_id"))
    return again.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1")


def _dangling(nodes: DataFrame, edges: DataFrame, stars: Stars) -> DataFrame:
    """(node_id, k): ends of edges that no node has, and how many there are."""
    lost = cut(counted_ends(edges, stars.counts()).join(nodes, "node_id", "left_anti"))
    found = _of_stars(stars, lost)
    return lost if found.isEmpty() else lost.join(found, "node_id", "left_anti")


def foreign_prefixes(nodes: DataFrame) -> DataFrame:
    """(node_type, prefix, n): nodes whose id does not start as the contract's table says."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in schema.NODE_PREFIXES.items() for x in kv]), F.col("node_type"))
    odd = nodes.where(~F.coalesce(F.startswith("node_id", want), F.lit(False)))
    return odd.groupBy("node_type", F.split_part("node_id", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


def assert_writable(nodes: DataFrame, edges: DataFrame) -> None:
    bad = [r["check"] for r in write_guard(nodes, edges).where("not passed").collect()]
    if bad:
        raise ValueError(f"graph fails: {', '.join(sorted(bad))}")


def shared_across(examples: DataFrame, entity: str, corpus: str = "source", least: int = 2) -> DataFrame:
    """(entity, n_corpora) of entities that occur in at least ``least`` corpora."""
    known = examples.where(F.col(entity).isNotNull())
    return known.groupBy(entity).agg(F.count_distinct(corpus).alias("n_corpora")).where(F.col("n_corpora") >= least)


def label_conflicts(examples: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    """Repeated (corpus, target, entity) triples and whether their labels disagree."""
    return examples.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_labels")).where("n > 1").withColumn("conflict", F.col("n_labels") > 1)


def axis_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(axis, n_covered, pct): examples with at least one edge on an axis, in percent of all."""
    total = nodes.where("node_type = 'Example'").agg(F.count("*").alias("n_examples"))
    own: dict[str, list[str]] = {}
    for axis, types in schema.axes().items():
        for e in types:
            if schema.endpoints().get(e, ("",))[0] == "Example":
                own.setdefault(e, []).append(axis)
    table = F.create_map(*[x for e, a in own.items() for x in (F.lit(e), F.array(*map(F.lit, a)))])
    direct = edges.where(F.col("edge_type").isin(*own) & F.startswith("src", F.lit("ex:"))).select("src", F.explode(F.try_element_at(table, F.col("edge_type"))).alias("axis"))
    covered = direct.groupBy("axis").agg(F.count_distinct("src").alias("n_covered"))
    return covered.join(total, F.lit(True)).select("axis", "n_covered", F.round(F.try_divide(100.0 * F.col("n_covered"), F.col("n_examples")), 4).alias("pct"))


def label_confound(examples: DataFrame, covered: str, label: str = "label", corpus: str = "source") -> DataFrame:
    """(corpus, pct_pos, pct_neg, gap): does being covered predict the label?"""
    def rate(v: int):
        own = F.col(label) == v
        return F.coalesce(F.try_divide(100.0 * F.count_if(own & F.col(covered)), F.count_if(own)), F.lit(0.0))

    out = examples.groupBy(corpus).agg(F.round(rate(1), 4).alias("pct_pos"), F.round(rate(0), 4).alias("pct_neg"))
    return out.withColumn("gap", F.round(F.col("pct_pos") - F.col("pct_neg"), 4))


def cluster_nesting(clusters: DataFrame, tight: int, loose: int) -> DataFrame:
    """Tight clusters whose members lie in several loose ones: (cluster_id, n_loose)."""
    t = clusters.where(F.col("resolution") == tight).select("protein_id", "cluster_id")
    o = clusters.where(F.col("resolution") == loose).select("protein_id", F.col("cluster_id").alias("loose_id"))
    return t.join(o, "protein_id").groupBy("cluster_id").agg(F.count_distinct("loose_id").alias("n_loose")).where("n_loose > 1")


def truth(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(corpus, target, want, got, passed): proteins of known targets, read from the graph.

    The example id carries corpus and target; a target without an example fails.
    """
    part = lambda i: F.split_part("src", F.lit(":"), F.lit(i))
    own = edges.where("edge_type = 'example_has_protein'").select(part(2).alias("corpus"), part(3).alias("target"), F.col("dst").alias("got")).distinct()
    want = known.select("corpus", "target", F.concat(F.lit("protein:"), "uniprot").alias("want"))
    return want.join(own, ["corpus", "target"], "left").withColumn("passed", F.coalesce(F.col("want") == F.col("got"), F.lit(False)))


def rates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_scaffolds, n_empty, n_ligands, n_without): how much could be parsed."""
    is_ = lambda k: F.col("node_type") == k
    have = nodes.agg(
        F.count_if(is_("Scaffold")).alias("n_scaffolds"), F.count_if(is_("Scaffold") & (props.text("props", "is_empty") == "true")).alias("n_empty"), F.count_if(is_("Ligand")).alias("n_ligands")
    )
    linked = edges.where("edge_type = 'example_has_ligand'").select(F.col("src").alias("node_id"))
    alone = nodes.where(is_("Example")).join(linked, "node_id", "left_anti").agg(F.count("*").alias("n_without"))
    return have.join(alone, F.lit(True))
