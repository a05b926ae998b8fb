import sqlite3

import pytest

from contamgraph.sources import sinks, sqlite, structures, text


def put(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_tokens(spark, tmp_path):
    put(tmp_path / "a.ism", b"  CCO   id1 id2 rest\n\n# note\nC1\n\xff\xfe x\r\nN id\n")
    got = [tuple(r)[:3] + (r["line_no"],) for r in text.tokens(spark, str(tmp_path / "a.ism")).orderBy("line_no").collect()]
    assert got[0] == ("CCO", "id1", "id2", 0) and got[1] == ("C1", None, None, 1) and got[2][1] == "x" and got[3] == ("N", "id", None, 3)


def test_directory_loaders(spark, tmp_path):
    put(tmp_path / "d/akt1/actives_final.ism", "C a\nCC b\n")
    put(tmp_path / "d/akt1/decoys_final.ism", "N c\n")
    put(tmp_path / "d/_skip/actives_final.ism", "N c\n")
    rows = text.target_directories(spark, str(tmp_path / "d")).collect()
    assert sorted((r["target"], r["smiles_input"], r["label"], r["label_type"]) for r in rows) == [("akt1", "C", 1, "active"), ("akt1", "CC", 1, "active"), ("akt1", "N", 0, "decoy")]
    put(tmp_path / "v/TP53/active_T.smi", "C 1\n")
    put(tmp_path / "v/TP53/inactive_V.smi", "N 2\n")
    put(tmp_path / "v/OTHER/active_T.smi", "N 2\n")
    rows = text.ave_splits(spark, str(tmp_path / "v")).collect()
    assert sorted((r["target"], r["label"], r["split"]) for r in rows) == [("TP53", 0, "validation"), ("TP53", 1, "train")]
    put(tmp_path / "m/x/all.smi", "C BDB12\nN zinc3\nO foo\nS\n")
    rows = text.mixed_files(spark, str(tmp_path / "m")).orderBy("line_no").collect()
    assert [(r["label"], r["label_type"]) for r in rows] == [(1, "active"), (0, "decoy"), (-1, "unknown"), (-1, "unknown")]


@pytest.mark.parametrize("case", ["whole", "missing", "overlap", "extra", "none"])
def test_published_split(spark, tmp_path, case):
    head = "lig_smiles,uniprot,active,pchembl_value\n"
    rows = ["C,P1,True,\n", "C,P2,False,5.5\n", "N,P1,True,6\n", "O,P3,False,\n"]
    put(tmp_path / "all.csv", head + "".join(rows))
    put(tmp_path / "train.csv", head + rows[0] + rows[2] + (rows[1] if case == "overlap" else ""))
    put(tmp_path / "test.csv", head + rows[1] + ("" if case == "missing" else rows[3]) + ("Q,P4,True,1\n" if case == "extra" else ""))
    cols = ["lig_smiles", "uniprot", "active", "pchembl_value"]
    read = lambda n: text.key_rows(text.csv_rows(spark, str(tmp_path / n), cols)).drop("row_key")
    parts = {} if case == "none" else {"train": read("train.csv"), "test": read("test.csv")}
    if case in ("missing", "overlap", "extra"):
        say = {"missing": "1 rows are in no part", "overlap": "1 rows are in more than one part", "extra": "1 rows of the parts are in no input"}
        with pytest.raises(ValueError, match=say[case]):
            text.published_split(read("all.csv"), parts, cols)
        return
    out = text.published_split(read("all.csv"), parts, cols)
    want = ["train", "test", "train", "test"] if case == "whole" else ["unknown"] * 4
    assert out.columns == [*cols, "split"]
    assert sorted((r["lig_smiles"], r["uniprot"], r["split"]) for r in out.collect()) == sorted(zip("CCNO", ("P1", "P2", "P1", "P3"), want, strict=True))
    m = text.measured_csv(spark, str(tmp_path / "all.csv")).collect()
    assert sorted((r["target"], r["label"], r["pchembl_value"]) for r in m if r["pchembl_value"]) == [("P1", 1, 6.0), ("P2", 0, 5.5)]


def test_measured_and_random(spark, tmp_path):
    put(tmp_path / "test/AKT1/actives.csv", "lig_smiles,uniprot,pchembl_value\nCCO,P1,7.5\nCC,P1,\n")
    put(tmp_path / "test/AKT1/random.csv", "LIG_SMILES,pocket\nN,x\n")
    put(tmp_path / "val/GBA/actives.csv", "")
    put(tmp_path / "val/GBA/random.csv", "name,pocket\nN,x\n")
    rows = text.measured_and_random(spark, str(tmp_path)).collect()
    key = ("split", "target", "smiles_input", "label", "label_type", "uniprot", "pocket", "source_file")
    assert sorted((tuple(r[k] for k in key) for r in rows), key=str) == [
        ("test", "AKT1", "CC", 1, "active", "P1", None, "actives.csv"), ("test", "AKT1", "CCO", 1, "active", "P1", None, "actives.csv"), ("test", "AKT1", "N", 0, "random", None, "x", "random.csv"),
    ]


def test_full_sets_and_archives(spark, tmp_path):
    import tarfile

    put(tmp_path / "raw/TP53/actives.smi", "C 1\nCC 2\n")
    put(tmp_path / "raw/TP53/inactives.smi", "N 3\n")
    put(tmp_path / "raw/TP53/1abc_ligand.mol2", "x")
    with tarfile.open(tmp_path / "full.tgz", "w:gz") as t:
        t.add(tmp_path / "raw/TP53", "TP53")
    root = text.unpack(str(tmp_path / "full.tgz"), str(tmp_path / "out"))
    assert root == text.unpack(str(tmp_path / "gone.tgz"), root)
    with pytest.raises(FileNotFoundError):
        text.unpack(str(tmp_path / "gone.tgz"), str(tmp_path / "other"))
    assert sorted((r["smiles_input"], r["label"], r["split"]) for r in text.full_sets(spark, root).collect()) == [("C", 1, "unknown"), ("CC", 1, "unknown"), ("N", 0, "unknown")]
    assert [tuple(r) for r in text.query_structures(spark, root).collect()] == [("TP53", "1abc")]


def test_line_numbers_over_splits(spark, tmp_path):
    put(tmp_path / "a.smi", "".join(f"C{i} id{i}\n" if i % 7 else "# note\n" for i in range(3000)))
    put(tmp_path / "b.smi", "N x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r["line_no"], r["smiles_input"]) for r in text.tokens(spark, [str(tmp_path / "a.smi"), str(tmp_path / "b.smi")]).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted([(0, "N"), *enumerate(f"C{i}" for i in range(3000) if i % 7)])


def test_affinity_records(spark, tmp_path):
    names = list(text.RECORD_COLUMNS)
    put(tmp_path / "r.tsv", "\t".join(names) + "\n" + "\t".join(f"v{i}" for i in range(len(names))) + "\nshort\trow\n")
    rows = text.affinity_records(spark, str(tmp_path / "r.tsv")).collect()
    assert rows[0]["record_id"] == "v0" and rows[0]["accession"] == f"v{len(names) - 1}" and len(rows[0]) == 17


def test_structure_and_fasta(spark, tmp_path):
    atom = lambda no, name, res, chain, kind="ATOM": f"{kind:<6}{no:>5}  {name:<3} {res} {chain}{no:>4}      0.0 0.0 0.0\n"
    put(tmp_path / "p.pdb", "HEADER\n" + atom(2, "CA", "MSE", "A", "HETATM") + atom(1, "CA", "ALA", "A") + atom(1, "N", "ALA", "A") + atom(4, "CA", "XXX", "A") + atom(3, "CA", "SEC", "A") + atom(5, "CA", "GLY", "A") + atom(1, "CA", "TRP", "B"))
    assert [tuple(r)[1:] for r in structures.ca_sequences(spark, str(tmp_path / "p.pdb")).collect()] == [("A", "AMUG")]
    put(tmp_path / "s.fasta", ">sp|P12345|NAME_X text\nMK\nLV\n>plain other\nAAA\n")
    got = sorted((r["accession"], r["sequence"]) for r in structures.fasta(spark, str(tmp_path / "s.fasta")).collect())
    assert got == [("P12345", "MKLV"), ("plain", "AAA")]
    put(tmp_path / "h.tsv", "q\tt1\t99\t90\t100\t100\t0\t50\nq\tt0\t98\t90\t100\t100\t0\t50\n")
    assert structures.best_hit(structures.alignment_hits(spark, str(tmp_path / "h.tsv"))).first()["target"] == "t0"


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table molecule_dictionary (molregno integer, chembl_id text)")
        con.execute("create table compound_structures (molregno integer, canonical_smiles text)")
        con.executemany("insert into molecule_dictionary values (?, ?)", [(i, f"C{i}") for i in range(10)])
        con.executemany("insert into compound_structures values (?, ?)", [(i, "C" * i) for i in range(0, 10, 2)])
    return path


def test_sqlite(spark, database):
    assert sqlite.list_tables(database) == ["compound_structures", "molecule_dictionary"]
    m = sqlite.table(spark, database, "molecule_dictionary", key="molregno", partitions=3)
    assert m.schema["molregno"].dataType.simpleString() == "bigint" and m.count() == 10 and m.rdd.getNumPartitions() == 3
    assert sqlite.molecules(spark, database).where("canonical_smiles is null").count() == 5
    q = spark.read.format("sqlite").option("path", database).option("query", "select chembl_id from molecule_dictionary where molregno > 7").load()
    assert sorted(r[0] for r in q.collect()) == ["C8", "C9"]
    keys = spark.createDataFrame([], "molregno long")
    assert sqlite.activities_of(m, keys).count() == 0
    with sqlite3.connect(database) as con:
        con.execute("create table docs (doc_id integer, chembl_id text, year integer)")
        con.execute("create table assays (assay_id integer, chembl_id text, assay_type text, doc_id integer, tid integer)")
        con.execute("create table target_dictionary (tid integer, chembl_id text, pref_name text)")
        con.execute("create table activities (activity_id integer, molregno integer, assay_id integer, standard_value real)")
        con.execute("insert into docs values (1, 'D1', 1999)")
        con.execute("insert into assays values (5, 'A5', 'B', 1, 2)")
        con.execute("insert into target_dictionary values (2, 'T2', 'name')")
        con.executemany("insert into activities values (?, ?, 5, 1.5)", [(i, i) for i in range(20)])
    assert [sqlite.documents(spark, database).first()[c] for c in ("document_chembl_id", "year", "title")] == ["D1", 1999, None]
    assert sqlite.assays(spark, database).first()["assay_type"] == "B" and sqlite.targets(spark, database).first()["target_chembl_id"] == "T2"
    assert sqlite.activities(spark, database, 3).agg({"molregno": "sum"}).first()[0] == 190


def graph(spark, extra=()):
    nodes = spark.createDataFrame([("ex:s:t:0", "Example", "", "{}"), ("lig:a", "Ligand", "", "{}")], "node_id string, node_type string, label string, props string")
    edges = spark.createDataFrame([("ex:s:t:0", "lig:a", "example_has_ligand", "{}"), *extra], "src string, dst string, edge_type string, props string")
    return nodes, edges


def test_guarded_write(spark, tmp_path):
    path = str(tmp_path / "kg")
    n, e = graph(spark)
    sinks.write_graph(n, e, path)
    sinks.write_graph(n, e, path)
    assert [df.count() for df in sinks.read_graph(spark, path)] == [2, 1]
    with pytest.raises(ValueError, match="dangling"):
        sinks.write_graph(*graph(spark, [("ex:s:t:0", "lig:b", "example_has_ligand", "{}")]), path)
    assert sinks.read_graph(spark, path)[1].count() == 1
    assert not [p for p in tmp_path.iterdir() if "_tmp_" in p.name]


def test_replace_edge_types(spark, tmp_path):
    path = str(tmp_path / "edges")
    ddl = "src string, dst string, edge_type string, props string"
    spark.createDataFrame([("a", "b", "x", "{}"), ("a", "c", "y", "{}")], ddl).write.partitionBy("edge_type").parquet(path)
    sinks.replace_edge_types(spark, path, spark.createDataFrame([("q", "r", "y", "{}"), ("q", "r", "y", "{}")], ddl), ["y"])
    assert sorted((r["src"], r["edge_type"]) for r in spark.read.parquet(path).collect()) == [("a", "x"), ("q", "y")]


def test_reattach(spark):
    _, e = graph(spark)
    kept = sinks.tagged(e, "d1")
    assert sinks.reattach(e, kept, "d1", ["example_has_ligand"]).count() == 1
    for digest, frame in (("d2", kept), ("d1", kept.limit(0))):
        with pytest.raises(ValueError):
            sinks.reattach(e, frame, digest, [])


def test_statistics_and_report(spark, tmp_path):
    n, e = graph(spark)
    sinks.write_statistics(n, e, str(tmp_path / "stats"))
    got = {r["key"]: r["value"] for r in spark.read.option("header", True).csv(str(tmp_path / "stats")).collect()}
    assert got == {"node": "2", "edge": "1", "node::Example": "1", "node::Ligand": "1", "edge::example_has_ligand": "1"}
    assert "| edge | 1 |" in sinks.markdown(sinks.statistics(n, e), "Counts")


def test_id_map(spark, tmp_path):
    sinks.write_id_map(spark.createDataFrame([("b", "a"), ("a", "a"), ("b", "a")], "old_id string, new_id string"), str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("b", "a")]
