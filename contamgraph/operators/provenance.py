"""Multi-hop provenance: paths are composed right to left, distinct after each hop."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contamgraph.functions import keys, props
from contamgraph.operators.emit import provenance_level
from contamgraph.operators.relational import compose, stable_distinct


def relation(edges: DataFrame, edge_type: str, backwards: bool = False) -> DataFrame:
    own = edges.where(F.col("edge_type") == edge_type)
    return own.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else own.select("src", "dst")


def wire(hops: list[DataFrame], edge_type: str, source: str) -> DataFrame:
    """Edges along a path of (src, dst) relations, tagged with their source."""
    path = hops[-1]
    for hop in reversed(hops[:-1]):
        path = compose(hop, path)
    return path.distinct().select("src", "dst", F.lit(edge_type).alias("edge_type"), props.props(source=F.lit(source)).alias("props"))


def wired_counts(links: DataFrame) -> DataFrame:
    """(dst, n): how many sources ``wire`` would link to each destination; the paths are not listed.

    ``links(src, mid, dst)`` has a row for each source and destination of a mid, and a source has
    one mid alone: paths grow with the square of a mid's rows, counts of its sources do not.
    Nothing but the counts moves where ``links`` is laid out by mid.
    """
    end = lambda c, is_src: F.struct(F.lit(is_src).alias("is_src"), F.col(c).cast("string").alias("end"))
    ends = links.where("mid is not null").select("mid", F.inline(F.array(end("src", True), end("dst", False)))).distinct()
    ends = ends.withColumn("n", F.count_if(F.col("is_src")).over(Window.partitionBy("mid")))
    return ends.where(~F.col("is_src")).groupBy(F.col("end").alias("dst")).agg(F.sum("n").alias("n"))


def provenance_table(activities: DataFrame, assays: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Star chain activity, assay, document, target with the provenance level of each activity."""
    a = activities.join(assays, "assay_id", "left").join(documents, "doc_id", "left").join(targets, "target_id", "left")
    return a.withColumn("provenance_level", provenance_level(F.col("assay_type"), F.col("doc_name"), F.col("activity_id")))


def publication_key(pmid, doi):
    """Publication node id: the first identifier that is present, else null."""
    p, d = F.nullif(F.trim(pmid), F.lit("")), F.nullif(F.trim(doi), F.lit(""))
    return F.coalesce(F.concat(F.lit("pub:pmid:"), p), F.concat(F.lit("pub:doi:"), d))


def record_layer(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a record table ``(record_id, ligand_key, accession, pmid, doi)``."""
    r = records.withColumns(
        {
            "ligand": F.concat(F.lit("bdb_lig:"), F.col("ligand_key")), "record": F.concat(F.lit("bdb_rec:"), F.col("record_id")),
            "protein": F.concat(F.lit("protein:"), F.nullif(F.trim("accession"), F.lit(""))), "pub": publication_key(F.col("pmid"), F.col("doi")),
        }
    )
    kinds = (("ligand", "BindingDBLigand", "ligand_key"), ("record", "Assay", "record_id"), ("protein", "Protein", "accession"), ("pub", "Publication", "pub"))
    nodes = None
    for column, kind, label in kinds:
        part = r.where(F.col(column).isNotNull()).select(F.col(column).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), props.empty().alias("props"))
        nodes = part if nodes is None else nodes.unionByName(part)
    links = (("ligand", "pub", "bindingdb_ligand_in_publication"), ("ligand", "protein", "bindingdb_ligand_targets_protein"), ("record", "ligand", "bindingdb_record_has_ligand"), ("record", "protein", "bindingdb_record_has_protein"))
    edges = None
    for a, b, kind in links:
        part = r.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("edge_type"), props.empty().alias("props"))
        edges = part if edges is None else edges.unionByName(part)
    return stable_distinct(nodes, ["node_id"]), edges.distinct()


def chembl_layer(links: DataFrame, ligands: DataFrame, activities: DataFrame, source: str = "ChEMBL35", release: str = "ChEMBL_35") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the reference database around the corpus ligands.

    ``links(canonical_smiles, molregno, match_method)`` match corpus ligands to compounds;
    the link edges belong to the pair, so corpus ligands that share a compound keep theirs.
    ``ligands(molregno, molecule_chembl_id, canonical_smiles, standard_inchi_key)`` names the
    compounds; ``activities`` has one row an activity with its compound, assay, document and
    target ids, of which the latter three may be null.
    """
    node = lambda i, kind, label, body: F.struct(i.alias("node_id"), F.lit(kind).alias("node_type"), label.cast("string").alias("label"), body.alias("props"))
    edge = lambda a, b, kind, body=None: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"), (props.empty() if body is None else body).alias("props"))
    c = F.col
    src = F.lit(f"src:{source}")

    known = ligands.select("molregno", "molecule_chembl_id", c("canonical_smiles").alias("_own"), "standard_inchi_key").where("molecule_chembl_id is not null")
    pair = stable_distinct(links.where("molregno is not null").select("molregno", "canonical_smiles", "match_method"), ["molregno", "canonical_smiles"]).join(known, "molregno")
    cid, lig = F.concat(F.lit("chembl_lig:"), c("molecule_chembl_id")), keys.ligand_id(F.nullif(c("canonical_smiles"), F.lit("")))
    body = props.props(molregno=c("molregno"), canonical_smiles_chembl=c("_own"), canonical_smiles_benchmark=c("canonical_smiles"), inchikey=c("standard_inchi_key"))
    compounds = pair.select(node(cid, "ChEMBLLigand", c("molecule_chembl_id"), body).alias("x"))
    linked = pair.select(F.explode(F.array(
        edge(cid, src, "chembl_ligand_from_source"), edge(lig, cid, "benchmark_ligand_same_inchikey_as_chembl_ligand", props.props(match_method=c("match_method"))),
        edge(lig, cid, "ligand_also_in_chembl"),
    )).alias("x"))

    names = ["activity_id", "molecule_chembl_id", "standard_type", "standard_value", "standard_units", "pchembl_value", "assay_chembl_id", "assay_type", "document_chembl_id", "year", "target_chembl_id"]
    act = stable_distinct(activities.where("activity_id is not null").select(*names), ["activity_id"])
    of = lambda prefix, column: F.concat(F.lit(prefix), F.nullif(c(column), F.lit("")))
    aid, asy, doc, tgt = F.concat(F.lit("chembl_act:"), c("activity_id").cast("string")), of("chembl_asy:", "assay_chembl_id"), of("chembl_doc:", "document_chembl_id"), of("chembl_tgt:", "target_chembl_id")
    value = props.props(standard_type=c("standard_type"), standard_value=c("standard_value"), standard_units=c("standard_units"), pchembl_value=c("pchembl_value"))
    measured = act.select(node(aid, "ChEMBLActivity", c("activity_id"), value).alias("x"))
    # dimension nodes repeat on every activity: distinct raw keys first
    around = act.select(F.explode(F.array(
        F.struct(asy.alias("node_id"), F.lit("ChEMBLAssay").alias("node_type"), c("assay_chembl_id").alias("label"), c("assay_type").alias("v")),
        F.struct(doc.alias("node_id"), F.lit("ChEMBLDocument").alias("node_type"), c("document_chembl_id").alias("label"), c("year").cast("string").alias("v")),
        F.struct(tgt.alias("node_id"), F.lit("ChEMBLTarget").alias("node_type"), c("target_chembl_id").alias("label"), F.lit(None).cast("string").alias("v")),
    )).alias("x")).select("x.*").where("node_id is not null").distinct()
    told = F.when(c("node_type") == "ChEMBLAssay", props.props(assay_type=c("v"))).when(c("node_type") == "ChEMBLDocument", props.props(year=c("v").cast("int"))).otherwise(props.empty())
    around = around.select(F.struct("node_id", "node_type", "label", told.alias("props")).alias("x"))
    hops = act.select(F.explode(F.array(
        edge(aid, F.concat(F.lit("chembl_lig:"), c("molecule_chembl_id")), "chembl_activity_has_ligand"), edge(aid, asy, "chembl_activity_has_assay"), edge(asy, doc, "chembl_assay_from_document"),
        edge(aid, doc, "chembl_activity_has_document"), edge(doc, src, "chembl_document_from_source"), edge(aid, tgt, "chembl_activity_has_target"),
    )).alias("x"))
    fixed = links.sparkSession.createDataFrame([(f"src:{source}", "DatasetSource", source, "{}"), (f"dbrel:{release}", "DatabaseRelease", release, "{}")], "node_id string, node_type string, label string, props string")
    nodes = compounds.unionByName(around).select("x.*").unionByName(measured.select("x.*")).unionByName(fixed)
    edges = linked.unionByName(hops).select("x.*").where("src is not null and dst is not null")
    return stable_distinct(nodes, ["node_id"]), edges.distinct()


#: Least identity and coverage of a sequence hit, and the identity from which a hit on
#: another accession is taken for an ortholog's structure (or names a target by itself).
SAME_IDENTITY, SAME_COVERAGE, ORTHOLOG_IDENTITY = 0.80, 0.5, 0.85


def _best_hits(hits: DataFrame) -> DataFrame:
    """One hit a target: the highest identity, then coverage, then the smaller accession."""
    order = F.struct(-F.col("identity"), -F.col("coverage"), F.col("accession"))
    best = hits.where("accession is not null").groupBy("target").agg(F.min_by(F.struct("accession", "identity", "coverage"), order).alias("h"))
    return best.select("target", F.col("h.accession").alias("hit"), "h.identity", "h.coverage")


def _figures(*names: str):
    return F.concat_ws(" ", *(F.concat(F.lit(f"{n}="), F.format_number(F.coalesce(n, F.lit(0.0)), 2)) for n in names))


def resolve_targets(targets: DataFrame, named: DataFrame, hits: DataFrame) -> DataFrame:
    """Accession of each target by two independent routes, with a confidence ladder.

    ``named(target, accession)`` comes from the target's entry name, ``hits(target,
    accession, identity, coverage)`` from its structure's sequence.  Every target has a
    row (target, accession, confidence, method, evidence), conflicts and unresolved ones too.
    """
    c = F.col
    name = named.where("accession is not null").groupBy("target").agg(F.min("accession").alias("name"))
    t = targets.select("target").distinct().join(name, "target", "left").join(_best_hits(hits), "target", "left")
    same = F.coalesce((c("identity") >= SAME_IDENTITY) & (c("coverage") >= SAME_COVERAGE), F.lit(False))
    has, agree = c("name").isNotNull(), F.coalesce(c("name") == c("hit"), F.lit(False))
    step = lambda method, confidence, accession: F.struct(accession.cast("string").alias("accession"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    ladder = (
        F.when(has & ~same, step("entry_name_only", 0.85, c("name")))
        .when(has & agree, step("entry_name+sequence", 1.0, c("name")))
        .when(has & (c("identity") >= ORTHOLOG_IDENTITY), step("entry_name(ortholog_structure)", 0.95, c("name")))
        .when(has, step("CONFLICT", 0.5, c("name")))
        .when(same, step("sequence_only", 0.9, c("hit")))
        .otherwise(step("UNRESOLVED", 0.0, F.lit(None)))
    )
    evidence = F.concat_ws(" ", F.concat(F.lit("hit="), F.coalesce("hit", F.lit("none"))), _figures("identity", "coverage"))
    return t.select("target", ladder.alias("r"), evidence.alias("evidence")).select("target", "r.*", "evidence")


def resolve_by_sequence(targets: DataFrame, hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Accession from a close sequence hit (confidence: its identity), else from the gene name (0.85)."""
    c = F.col
    gene = genes.where("accession is not null").groupBy("target").agg(F.min("accession").alias("gene"))
    t = targets.select("target").distinct().join(_best_hits(hits), "target", "left").join(gene, "target", "left")
    close = F.coalesce((c("identity") >= ORTHOLOG_IDENTITY) & (c("coverage") >= SAME_COVERAGE), F.lit(False))
    return t.select(
        "target", F.when(close, c("hit")).otherwise(c("gene")).alias("accession"),
        F.when(close, F.round("identity", 3)).when(c("gene").isNotNull(), 0.85).otherwise(0.0).alias("confidence"),
        F.when(close, "sequence").when(c("gene").isNotNull(), "gene_name").otherwise("UNRESOLVED").alias("method"), _figures("identity", "coverage").alias("evidence"),
    )


def resolve_by_structures(targets: DataFrame, genes: DataFrame, structures: DataFrame) -> DataFrame:
    """Accession of the gene, confirmed where one of the target's ``structures(target, place, accession)`` holds it."""
    c = F.col
    gene = genes.where("accession is not null").groupBy("target").agg(F.min("accession").alias("gene"))
    held = structures.where("accession is not null").groupBy("target").agg(F.collect_set("accession").alias("held"), F.min_by("accession", "place").alias("first"))
    t = targets.select("target").distinct().join(gene, "target", "left").join(held, "target", "left")
    sure = F.coalesce(F.array_contains("held", c("gene")), F.lit(False))
    return t.select(
        "target", F.coalesce("gene", "first").alias("accession"),
        F.when(sure, 1.0).when(c("gene").isNotNull(), 0.85).when(c("first").isNotNull(), 0.4).otherwise(0.0).alias("confidence"),
        F.when(sure, "gene+pdb").when(c("gene").isNotNull(), "gene_only").when(c("first").isNotNull(), "pdb_only").otherwise("UNRESOLVED").alias("method"),
        F.concat(F.lit("pdb="), F.array_join(F.array_sort(F.coalesce("held", F.array().cast("array<string>"))), "+")).alias("evidence"),
    )
