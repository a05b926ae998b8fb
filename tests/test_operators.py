import random

import pytest
from pyspark.sql import functions as F

from contamgraph import schema
from contamgraph.functions import bits, keys, props
from contamgraph.functions.chemistry import BackendMissing, featurize
from contamgraph.operators import audit, canonical, emit, leakage, provenance, relational, similarity
from contamgraph.operators.components import connected_components

NODE, EDGE = "node_id string, node_type string, label string, props string", "src string, dst string, edge_type string, props string"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_stable_distinct_does_not_depend_on_layout(spark):
    data = [(i % 5, random.Random(i).random(), None if i % 3 else "x") for i in range(60)]
    df = spark.createDataFrame(data, "k int, a double, b string")
    want = rows(relational.stable_distinct(df, ["k"]))
    assert want == rows(relational.stable_distinct(df.repartition(7).orderBy(F.desc("a")), ["k"])) and len(want) == 5


def test_prioritised_match(spark):
    left = spark.createDataFrame([(1, "a", "p"), (2, "z", "q"), (3, None, None), (4, "zz", "none")], "i int, full string, part string")
    right = spark.createDataFrame([("a", "q", 10), ("a", "q", 9), ("y", "q", 8), (None, "none", None)], "full string, part string, v int")
    got = rows(relational.prioritised_match(left, right, "full", "part", "v"), "i", "v", "match_method")
    assert got == [(1, 9, "full"), (2, 8, "part"), (3, None, "unmatched"), (4, None, "unmatched")]


def test_semantic_traps(spark):
    df = spark.createDataFrame([("5", None, '{"a": null, "b": 1.5}'), ("x", "y", "{}")], "n string, s string, j string")
    got = rows(df.select(F.col("n").try_cast("int"), F.concat("n", "s"), props.text("j", "b"), props.number("j", "a"), F.nullif(F.regexp_extract("n", "z(.)", 1), F.lit(""))))
    assert got == [(5, None, "1.5", None, None), (None, "xy", None, None, None)]
    sib = df.withColumns({"n": F.lit("new"), "old": F.col("n")})
    assert sorted(r["old"] for r in sib.collect()) == ["5", "x"]


def test_keys(spark):
    df = spark.createDataFrame([(" A\t b\n", "Q9Y6K9"), ("", "A0A022YWF9"), (None, "no")], "t string, a string")
    got = df.select(keys.collapsed(F.col("t")).alias("c"), keys.letters_only(F.col("t")).alias("l"), keys.is_accession(F.col("a")).alias("a"), keys.scaffold_id(F.col("t")).alias("s")).collect()
    assert [r["c"] for r in got] == ["A b", "", None] and [r["l"] for r in got] == ["ab", "", None] and [r["a"] for r in got] == [True, True, False]
    assert got[1]["s"] == got[2]["s"]
    p = spark.createDataFrame([("AB1_HUMAN_10_200_0",), ("AB1_HUMAN_10_200",), ("P12345",)], "p string").select(keys.pocket_entry(F.col("p")).alias("e"))
    assert [r["e"] for r in p.collect()] == ["AB1_HUMAN", "AB1_HUMAN", "P12345"]


def test_splice(spark):
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "p string").select(props.spliced(F.col("p"), {"x": F.lit("1"), "y": F.lit("2")}).alias("p"))
    assert [r["p"] for r in df.collect()] == ['{"x":"1","y":"2"}', '{"a":1,"x":"1","y":"2"}']


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95])
def test_similarity_equals_all_pairs(spark, threshold):
    rng = random.Random(3)
    base = rng.sample(range(2048), 60)
    sets = {i: sorted({*rng.sample(base, rng.randint(20, 60)), *rng.sample(range(2048), rng.randint(0, 6))}) for i in range(50)}
    sets[50] = []
    want = sorted(((i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= threshold), key=str)
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "id int, tokens array<int>")
    assert rows(similarity.jaccard_pairs(df, threshold), "src", "dst") == want
    prints = df.select("id", bits.packed(F.col("tokens")).alias("fp"))
    assert rows(similarity.tanimoto_pairs(prints, threshold), "src", "dst") == want
    assert rows(similarity.tanimoto_block_pairs(prints, threshold, block_rows=7), "src", "dst") == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000)] + [(9000, 9001 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = rows(connected_components(spark.createDataFrame(edges, "src int, dst int")))
    assert got == sorted(((x, find(x)) for x in parent), key=str)
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_identity_stars(spark):
    e = spark.createDataFrame([("b", "k", "f1"), ("a", "k", "f2"), ("c", "k", "f2"), ("d", "m", "f3"), ("e", None, "f4")], "node_id string, key string, full string")
    assert rows(emit.identity_star(e, "key")) == [("a", "b", "k"), ("a", "c", "k")]
    assert rows(emit.identity_star(e, "key", full_key="full")) == [("a", "b", "k")]


def test_merge_needs_every_corpus(spark):
    df = spark.createDataFrame([("a", "x")], "node_id string, label string")
    assert emit.merge_corpora({"A": df, "B": df}, ("A", "B"), ["node_id"]).count() == 1
    with pytest.raises(ValueError, match="missing corpora: C"):
        emit.merge_corpora({"A": df}, ("A", "C"), ["node_id"])


def tiny(spark, label="1"):
    nodes = [("ex:S:T:0", "Example", "", f'{{"label":{label},"source":"S"}}'), ("lig:a", "Ligand", "", "{}"), ("tgt:S:Q9Y6K9", "Protein", "", "{}"), ("src:S", "DatasetSource", "S", "{}"), ("lt:active", "LabelType", "active", "{}"), ("split:S:train", "Split", "train", "{}")]
    edges = [("ex:S:T:0", d, t, "{}") for d, t in (("lig:a", "example_has_ligand"), ("tgt:S:Q9Y6K9", "example_has_protein"), ("src:S", "example_from_source"), ("lt:active", "example_has_label_type"), ("split:S:train", "example_in_split"))]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_protein_ids(spark):
    n, e = canonical.normalise_proteins(*tiny(spark))
    again = canonical.normalise_proteins(n, e)
    for nodes, edges in ((n, e), again):
        assert nodes.where("node_id = 'protein:Q9Y6K9'").count() == 1 and edges.where("dst = 'protein:Q9Y6K9'").count() == 1


def test_enrichment_is_total(spark):
    n, e = canonical.enrich_examples(*tiny(spark))
    assert n.where("node_type = 'Example'").first()["props"] == '{"label":1,"source":"S","label_type":"active","split":"S:train"}'
    with pytest.raises(ValueError, match="1 examples"):
        canonical.enrich_examples(n, e.where("edge_type <> 'example_in_split'"))


def test_scaffold_merge_relabels_and_keeps_props(spark):
    n = spark.createDataFrame([("sca:1", "Scaffold", "C@A", '{"is_empty":false}'), ("sca:2", "Scaffold", "CA", '{"is_empty":false}'), ("sca:3", "Scaffold", "N@", '{"is_empty":false}')], NODE)
    e = spark.createDataFrame([("lig:a", "sca:2", "ligand_scaffold", "{}"), ("lig:b", "sca:3", "ligand_scaffold", "{}")], EDGE)
    flat = n.select("node_id", F.regexp_replace("label", "@", "").alias("flat"))
    n2, e2 = canonical.merge_scaffolds(n, e, flat)
    assert rows(n2, "node_id", "label", "props") == [("sca:1", "CA", '{"is_empty":false,"stereo_merged":"true"}'), ("sca:3", "N", '{"is_empty":false}')]
    assert rows(e2, "src", "dst") == [("lig:a", "sca:1"), ("lig:b", "sca:3")]


def test_small_stages(spark):
    n, e = tiny(spark)
    pairs = spark.createDataFrame([("lig:b", "lig:a", "ligand_similar", '{"tanimoto":0.9}'), ("lig:a", "lig:b", "ligand_similar", '{"tanimoto":0.9}'), ("lig:c", "lig:d", "ligand_similar", '{"tanimoto":1.0}'), ("lig:e", "lig:e", "ligand_similar", "{}")], EDGE)
    assert rows(canonical.sort_pairs(n, pairs)[1], "src", "dst") == [("lig:a", "lig:b"), ("lig:c", "lig:d")]
    assert rows(canonical.split_exact_similarity(n, pairs)[1].groupBy("edge_type").count()) == [("ligand_fingerprint_exact", 1), ("ligand_similar", 3)]
    m = spark.createDataFrame([("lig:a", "protein:x", "ligand_measured_protein", p) for p in ('{"source":"B"}', '{"source":"A"}', "{}")], EDGE)
    assert canonical.merge_sources(n, m)[1].first()["props"] == '{"source":"A+B"}'
    none = spark.createDataFrame([("lig:a", "protein:x", "ligand_measured_protein", "{}")], EDGE)
    assert canonical.merge_sources(n, none)[1].first()["props"] == '{"source":null}'
    extra = n.unionByName(spark.createDataFrame([("ex:S:T:9", "Example", "", "{}"), ("lig:z", "Ligand", "", "{}")], NODE))
    assert canonical.drop_without_ligand(extra, e)[0].where("node_id = 'ex:S:T:9'").count() == 0
    assert canonical.drop_orphans(extra, e)[0].where("node_id = 'lig:z'").count() == 0
    pub = spark.createDataFrame([("chembl_doc:9",)], "node_id string")
    cited = e.unionByName(spark.createDataFrame([("ex:S:T:0", f"chembl_doc:{i}", t, "{}") for i, t in ((9, "example_from_publication"), (8, "example_from_publication"), (9, "other"))], EDGE))
    kept_n, kept_e = canonical.drop_placeholders(n, cited, pub)
    assert rows(kept_e.where("dst like 'chembl_doc:%'"), "dst", "edge_type") == [("chembl_doc:8", "example_from_publication"), ("chembl_doc:9", "other")] and kept_n.count() == n.count()
    px = spark.createDataFrame([("tgt:S:Q9Y6K9", "tgt:none", 99.0, 10)], "src string, dst string, pident double, alnlen long")
    assert canonical.add_protein_exact(n, e, px)[1].count() == e.count()


def test_canonical_graph_passes_its_audits(spark):
    n, e = canonical.canonicalise(*tiny(spark))
    for report in (audit.write_guard(n.drop("degree"), e), audit.structural(n, e), audit.cardinality(n, e), audit.facts(n, e)):
        assert report.where("not passed").count() == 0, report.collect()
    assert rows(n.where("node_type = 'Example'"), "degree") == [(5,)]
    assert canonical.dropped_types(n).count() == 0


BROKEN = {
    "duplicate_node_id": lambda n, e: (n.unionByName(n.limit(1)), e),
    "id_without_prefix": lambda n, e: (n.withColumn("node_id", F.regexp_replace("node_id", ":", "_")), e),
    "self_loop": lambda n, e: (n, e.withColumn("dst", F.col("src"))),
    "dangling_src": lambda n, e: (n.where("node_type <> 'Example'"), e),
    "dangling_dst": lambda n, e: (n.where("node_type <> 'Ligand'"), e),
    "duplicate_triple": lambda n, e: (n, e.unionByName(e)),
    "orphan": lambda n, e: (n, e.where("dst <> 'lig:a'")),
}


@pytest.mark.parametrize("check", BROKEN)
def test_each_structural_check_can_fail(spark, check):
    report = {r["check"]: r["passed"] for r in audit.structural(*BROKEN[check](*tiny(spark))).collect()}
    assert not report[check]


def test_facts_and_guard_can_fail(spark):
    n, e = canonical.canonicalise(*tiny(spark))
    bad_n = n.withColumn("degree", F.col("degree") + 1).withColumn("props", F.lit('{"label":7}'))
    bad_e = e.unionByName(spark.createDataFrame([("lig:a", "lig:b", "ligand_similar", '{"tanimoto":0.2}'), ("lig:a", "lig:b", "ligand_fingerprint_exact", "{}"), ("lig:a", "lig:b", "ligand_exact", "{}"), ("lig:a", "lig:b", "ligand_parent_exact", "{}")], EDGE))
    assert not any(r["passed"] for r in audit.facts(bad_n, bad_e).collect())
    nul = n.drop("degree").withColumn("label", F.char(F.lit(0))).withColumn("node_type", F.lit("Odd"))
    report = {r["check"]: r["passed"] for r in audit.write_guard(nul, bad_e.withColumn("edge_type", F.lit("odd"))).collect()}
    assert not any(report[c] for c in ("nul_in_nodes", "unknown_node_type", "unknown_edge_type", "dangling"))
    with pytest.raises(ValueError):
        audit.assert_writable(nul, e)
    assert ("label", nul.count()) in rows(audit.nul_rows(nul))


def test_contract_is_consistent():
    assert set(schema.weights()) - set(schema.endpoints()) == {"example_has_timebin", "time_overlap", "example_in_trainset"}
    assert not set(schema.non_axis()) & {e for es in schema.axes().values() for e in es}


def test_unpopulated_axes(spark):
    _, e = tiny(spark)
    assert ("protein_exact", "protein") in rows(audit.unpopulated(e)) and ("example_has_ligand", "ligand") not in rows(audit.unpopulated(e))


def test_provenance(spark):
    a, b, c = (spark.createDataFrame(x, "src string, dst string") for x in ([("e1", "l1"), ("e2", "l1")], [("l1", "a1"), ("l1", "a2")], [("a1", "d1"), ("a2", "d1")]))
    assert rows(provenance.wire([a, b, c], "t", "S"), "src", "dst") == [("e1", "d1"), ("e2", "d1")]


def test_target_ladders(spark):
    targets = spark.createDataFrame([(f"t{i}",) for i in range(8)], "target string")
    named = spark.createDataFrame([("t0", "P1"), ("t1", "P1"), ("t2", "P1"), ("t3", "P1"), ("t4", "P1"), ("t6", None)], "target string, accession string")
    hits = [("t0", "P1", 0.9, 0.6), ("t0", "P9", 0.5, 1.0), ("t1", "P1", 0.7, 0.9), ("t2", "P2", 0.86, 0.9), ("t3", "P2", 0.82, 0.9), ("t5", "P2", 0.95, 0.5), ("t6", "P2", 0.95, 0.4), ("t7", None, 1.0, 1.0)]
    hits = spark.createDataFrame(hits, "target string, accession string, identity double, coverage double")
    got = {r["target"]: (r["accession"], r["confidence"], r["method"]) for r in provenance.resolve_targets(targets, named, hits).collect()}
    assert got == {
        "t0": ("P1", 1.0, "entry_name+sequence"), "t1": ("P1", 0.85, "entry_name_only"), "t2": ("P1", 0.95, "entry_name(ortholog_structure)"), "t3": ("P1", 0.5, "CONFLICT"),
        "t4": ("P1", 0.85, "entry_name_only"), "t5": ("P2", 0.9, "sequence_only"), "t6": (None, 0.0, "UNRESOLVED"), "t7": (None, 0.0, "UNRESOLVED"),
    }
    by = {r["target"]: (r["accession"], r["confidence"]) for r in provenance.resolve_by_sequence(targets, hits, named).collect()}
    assert by["t0"] == ("P1", 0.9) and by["t1"] == ("P1", 0.85) and by["t5"] == ("P2", 0.95) and by["t7"] == (None, 0.0)
    held = hits.withColumn("place", F.col("identity"))
    by = {r["target"]: (r["accession"], r["confidence"], r["method"]) for r in provenance.resolve_by_structures(targets, named, held).collect()}
    assert by["t1"] == ("P1", 1.0, "gene+pdb") and by["t2"] == ("P1", 0.85, "gene_only") and by["t6"] == ("P2", 0.4, "pdb_only") and by["t7"] == (None, 0.0, "UNRESOLVED")


def test_target_edges_are_kept_and_measured_ones_move(spark):
    n, e = tiny(spark)
    more = [("ex:S:T:0", "protein:P9", "example_has_protein", "{}"), ("ex:S:U:1", "lig:b", "example_has_ligand", "{}"), ("ex:S:U:1", "protein:P8", "example_has_protein", "{}")]
    e = e.unionByName(spark.createDataFrame(more, EDGE))
    mapping = spark.createDataFrame([("tgt:S:T", "tgt:S:Q9Y6K9")], "old_id string, new_id string")
    _, out = canonical.split_relation(n, e, mapping)
    assert rows(out.where("edge_type = 'example_has_protein'"), "src", "dst") == [("ex:S:T:0", "tgt:S:Q9Y6K9"), ("ex:S:U:1", "protein:P8")]
    assert rows(out.where("edge_type = 'ligand_measured_protein'"), "src", "dst", "props") == [("lig:a", "protein:P9", "{}")] and out.count() == e.count()
    _, whole = canonical.canonicalise(*tiny(spark))
    assert whole.where("edge_type = 'ligand_measured_protein'").count() == 0


def test_protein_map_retypes(spark):
    n = spark.createDataFrame([("x:1", "Odd", "", "{}"), ("protein:A B", "Protein", "", "{}")], NODE)
    e = spark.createDataFrame([("x:1", "protein:A B", "t", "{}")], EDGE)
    m = spark.createDataFrame([("x:1", "protein:X"), ("protein:A B", "protein:A")], "old_id string, new_id string")
    n2, e2 = canonical.apply_protein_map(n, e, m)
    assert rows(n2, "node_id", "node_type") == [("protein:A", "Protein"), ("protein:X", "Protein")] and rows(e2, "src", "dst") == [("protein:X", "protein:A")]


def test_scaffold_size_and_names(spark):
    n = spark.createDataFrame([("sca:1", "Scaffold", "CCO", '{"is_empty":false}'), ("lig:1", "Ligand", "CCO", "{}")], NODE)
    out = canonical.with_scaffold_size(n, n, F.length("label"))[0]
    assert rows(out, "node_id", "props") == [("lig:1", "{}"), ("sca:1", '{"is_empty":false,"n_heavy_atoms":3}')]
    p = spark.createDataFrame([("AL1A1_HUMAN_4_501_0", "C[C@@H]/N"), ("AB1_HUMAN_10_200", "C\\C"), ("P12345", None)], "p string, s string")
    assert [tuple(r) for r in p.select(keys.pocket_name(F.col("p")), keys.stereo_free_text(F.col("s"))).collect()] == [("AL1A1_HUMAN", "C[CH]N"), (None, "CC"), (None, None)]


def test_one_target_edge_for_each_pair(spark):
    n, e = tiny(spark)
    again = e.unionByName(spark.createDataFrame([("ex:S:T:0", "tgt:S:Q9Y6K9", "example_has_protein", '{"source":"B"}')], EDGE))
    assert canonical.one_example_protein(n, again)[1].count() == e.count()


def test_degree_is_recorded(spark):
    n, e = canonical.canonicalise(*tiny(spark))
    assert audit.degree_recorded(n).first()["passed"] and not audit.degree_recorded(n.withColumn("is_hub", F.lit(False))).first()["passed"]


def test_leakage(spark):
    links = spark.createDataFrame([("ex:1", "l:a"), ("ex:2", "l:a"), ("ex:3", "l:b"), ("ex:4", "l:c")], "src string, dst string")
    rel = spark.createDataFrame([("l:a", "l:b")], "src string, dst string")
    ex = links.select(F.col("src").alias("node_id")).unionByName(spark.createDataFrame([("ex:5",)], "node_id string"))
    assert rows(leakage.largest_group(leakage.leakage_groups(links, rel), ex)) == [(5, 4, 3, 60.0)]
    nodes = links.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    assert leakage.within_degree(links, nodes, 1).count() == 2
    hits = spark.createDataFrame([("a", "b", 99.0, 95, 100, 100), ("b", "a", 98.5, 97, 100, 100), ("a", "c", 99.0, 95, 100, 300), ("a", "d", 97.0, 99, 100, 100), ("a", "e", 99.0, 9, 0, 10)], "query string, target string, pident double, alnlen int, qlen int, tlen int")
    assert rows(leakage.identical_proteins(hits)) == [("a", "b", 99.0, 97)]
    cl = spark.createDataFrame([("p1", "x", 90), ("p2", "x", 90), ("p1", "y", 50), ("p2", "z", 50), ("p3", "z", 50), ("p3", "w", 30)], "protein_id string, cluster_id string, resolution int")
    assert rows(audit.cluster_nesting(cl, 90, 50)) == [("x", 2)]
    nested = leakage.nest_clusters(cl)
    assert audit.cluster_nesting(nested, 90, 50).count() == 0 and rows(nested.where("resolution = 50"), "protein_id", "cluster_id") == [("p1", "p1"), ("p2", "p1"), ("p3", "p1")]


def test_entity_fingerprint_is_order_free(spark):
    df = spark.createDataFrame([(f"n{i % 20}",) for i in range(60)], "node_id string")
    a, b = (rows(similarity.entity_set_fingerprint(x)) for x in (df, df.repartition(5).orderBy(F.desc("node_id"))))
    assert a == b and a != rows(similarity.entity_set_fingerprint(df.where("node_id <> 'n3'")))


def test_chemistry_needs_its_backend(spark):
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(BackendMissing):
            featurize(F.col("x"))
    else:
        pytest.skip("backend installed")
