"""Delimited text sources, each to the example contract."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contamgraph.functions.keys import row_key
from contamgraph.operators.relational import partition_proof

#: The fifteen targets of the AVE-unbiased screening corpus.
AVE_TARGETS = ("ADRB2", "ALDH1", "ESR1_ago", "ESR1_ant", "FEN1", "GBA", "IDH1", "KAT2A", "MAPK1", "MTORC1", "OPRK1", "PKM2", "PPARG", "TP53", "VDR")


def tokens(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace molecule files: (smiles_input, ext_id_1, ext_id_2, file, line_no).

    Lines are trimmed; blank and ``#`` lines are skipped; missing tokens are null.
    ``line_no`` numbers the kept lines of a file from 0.  Files are read by line, in
    splits: a split's lines are numbered in its task, after the lines of the splits
    before it, whose counts are one small table.
    """
    line = F.trim(F.regexp_replace("value", "\r$", ""))
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"))
    kept = read.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("at", F.monotonically_increasing_id())
    blocks = kept.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offset = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    part = F.split("line", r"\s+")
    return kept.join(offset, ["file", "block"]).select(
        *(F.try_element_at(part, F.lit(i + 1)).alias(c) for i, c in enumerate(("smiles_input", "ext_id_1", "ext_id_2"))), "file",
        (F.col("at") + F.col("offset")).cast("int").alias("line_no"),
    )


def examples(df: DataFrame, source: str, label: Column | int, label_type: Column | str, target: Column | str, split: Column | str = "unknown") -> DataFrame:
    """Attach the contract's columns to token rows."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "smiles_input", "ext_id_1", "ext_id_2", F.lit(source).alias("source"), lit(target).alias("target"), lit(label).cast("tinyint").alias("label"),
        lit(label_type).alias("label_type"), lit(split).alias("split"), F.col("file").alias("source_file"), "line_no",
    )


def _part(depth: int) -> Column:
    """Path part of the file name, counted from its end."""
    return F.try_element_at(F.split("file", "/"), F.lit(-depth))


def target_directories(spark: SparkSession, root: str, source: str = "DUD-E") -> DataFrame:
    """``<root>/<target>/{actives,decoys}*.ism``; targets whose name starts with ``_`` or ``.`` are left out."""
    t = tokens(spark, f"{root}/*/*.ism")
    name = F.lower(_part(1))
    t = t.where(~F.col("file").rlike(r"/[._][^/]*/[^/]*$")).where(name.rlike("^(actives|decoys)"))
    active = name.startswith("actives")
    return examples(t, source, F.when(active, 1).otherwise(0), F.when(active, "active").otherwise("decoy"), _part(2))


def ave_splits(spark: SparkSession, root: str, source: str = "LIT-PCBA") -> DataFrame:
    """``<root>/<target>/{active,inactive}_{T,V}.smi``: T trains, V validates."""
    t = tokens(spark, f"{root}/*/*.smi").where(_part(2).isin(*AVE_TARGETS)).where(_part(1).rlike(r"^(active|inactive)_[TV]\.smi$"))
    active = _part(1).startswith("active")
    return examples(t, source, F.when(active, 1).otherwise(0), F.when(active, "active").otherwise("inactive"), _part(2), F.when(F.contains(_part(1), F.lit("_T.")), "train").otherwise("validation"))


def full_sets(spark: SparkSession, root: str, source: str = "LIT-PCBA") -> DataFrame:
    """``<root>/<target>/{actives,inactives}.smi``: the whole sets before they were split."""
    t = tokens(spark, f"{root}/*/*.smi").where(_part(2).isin(*AVE_TARGETS)).where(_part(1).isin("actives.smi", "inactives.smi"))
    active = _part(1) == "actives.smi"
    return examples(t, source, F.when(active, 1).otherwise(0), F.when(active, "active").otherwise("inactive"), _part(2))


def query_structures(spark: SparkSession, root: str) -> DataFrame:
    """(target, structure) of the ``<root>/<target>/<structure>_ligand.mol2`` files."""
    found = spark.read.format("binaryFile").load(f"{root}/*/*_ligand.mol2").select(F.col("path").alias("file"))
    return found.select(_part(2).alias("target"), F.regexp_replace(_part(1), r"_ligand\.mol2$", "").alias("structure")).distinct()


def unpack(archive: str, out: str) -> str:
    """Unpack a tar archive into a shared folder, once; returns the folder."""
    import tarfile
    from pathlib import Path

    done = Path(out) / "_UNPACKED"
    if not done.exists():
        if not Path(archive).exists():
            raise FileNotFoundError(archive)
        Path(out).mkdir(parents=True, exist_ok=True)
        with tarfile.open(archive) as t:
            t.extractall(out, filter="data")
        done.touch()
    return out


def mixed_files(spark: SparkSession, root: str, source: str = "DEKOIS") -> DataFrame:
    """One mixed file a target: id prefix BDB is active, ZINC a decoy, others unknown (-1)."""
    t = tokens(spark, f"{root}/*/*.smi")
    name = F.coalesce("ext_id_1", F.lit(""))
    bdb, zinc = name.rlike(r"(?i)^BDB\d+"), name.rlike(r"(?i)^ZINC\d+")
    return examples(t, source, F.when(bdb, 1).when(zinc, 0).otherwise(-1), F.when(bdb, "active").when(zinc, "decoy").otherwise("unknown"), _part(2))


def csv_rows(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = ",", quote: str | None = '"') -> DataFrame:
    """CSV as text; empty fields stay empty where a key needs them (nulls become empty)."""
    r = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("inferSchema", False)
    df = r.option("quote", quote or "").csv(path)
    if columns is not None:
        have = {c.lower(): c for c in df.columns}
        df = df.select(*(F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns))
    return df


def key_rows(df: DataFrame) -> DataFrame:
    """Whole-row keys with null and empty alike."""
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in df.columns)).withColumn("row_key", row_key(df.columns))


def published_split(rows: DataFrame, parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """``rows`` with the name of the part that holds each whole row.

    Raises unless the parts partition the rows: no row in two parts, none in no part,
    and no row in a part alone.  Without parts, every row is ``unknown``.
    """
    if not parts:
        return rows.withColumn("split", F.lit("unknown"))
    keyed = rows.withColumn("row_key", row_key(columns))
    own = {name: key_rows(part.select(*columns)).select("row_key") for name, part in parts.items()}
    bad = {r["check"]: r["n_bad"] for r in partition_proof(keyed, list(own.values()), ["row_key"]).collect() if r["n_bad"]}
    if bad:
        say = {"overlap": "rows are in more than one part", "missing": "rows are in no part", "extra": "rows of the parts are in no input"}
        raise ValueError("the parts are not a partition: " + ", ".join(f"{n} {say[k]}" for k, n in sorted(bad.items())))
    named = None
    for name, part in own.items():
        piece = part.withColumn("split", F.lit(name))
        named = piece if named is None else named.unionByName(piece)
    return keyed.join(named, "row_key").drop("row_key")


#: Optional columns of the measured-and-random corpus.
MEASURED_COLUMNS = ("uniprot", "pocket", "standard_type", "standard_value", "standard_units", "pchembl_value", "ex_rec_pdb", "lig_cluster", "rec_cluster", "num_pocket_residues")


def measured_and_random(spark: SparkSession, root: str, source: str = "BayesBind") -> DataFrame:
    """``<root>/<split>/<target>/{actives,random}.csv``: measured actives against random molecules.

    Files may have different columns: those with the same header line are read
    together, by name; optional columns that no file of a header has are null.
    Files without a ligand column, and empty ones, give no rows.
    """
    glob = f"{root}/*/*/{{actives,random}}.csv"
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    first = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), "value", at.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    headers: dict[str, list[str]] = {}
    for r in first.collect():  # one row a file
        headers.setdefault(r["header"].strip(), []).append(r["file"])
    out = None
    for header, files in sorted(headers.items()):
        if "lig_smiles" not in [c.strip('"').lower() for c in header.split(",")]:
            continue
        df = spark.read.option("header", True).option("inferSchema", False).csv(sorted(files)).withColumn("file", F.col("_metadata.file_path"))
        have = {c.lower(): c for c in df.columns}
        column = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")  # noqa: E731, B023
        active = _part(1) == "actives.csv"
        rows = df.select(
            column("lig_smiles").alias("smiles_input"), F.lit(source).alias("source"), _part(2).alias("target"), F.when(active, 1).otherwise(0).cast("tinyint").alias("label"),
            F.when(active, "active").otherwise("random").alias("label_type"), _part(3).alias("split"), _part(1).alias("source_file"), *(column(c).alias(c) for c in MEASURED_COLUMNS),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        text = ("smiles_input", "source", "target", "label", "label_type", "split", "source_file", *MEASURED_COLUMNS)
        return spark.createDataFrame([], ", ".join(f"{c} {'tinyint' if c == 'label' else 'string'}" for c in text))
    return out


def measured_csv(spark: SparkSession, path: str | list[str], source: str = "BigBind") -> DataFrame:
    """CSV of measured pairs: ligand text, accession, active flag and optional value."""
    df = csv_rows(spark, path, ["lig_smiles", "uniprot", "active", "standard_type", "standard_value", "standard_units", "pchembl_value", "ex_rec_pdb"])
    active = F.lower("active").isin("true", "1")
    return df.select(
        F.col("lig_smiles").alias("smiles_input"), F.lit(None).cast("string").alias("ext_id_1"), F.col("ex_rec_pdb").alias("ext_id_2"), F.lit(source).alias("source"),
        F.col("uniprot").alias("target"), F.when(active, 1).otherwise(0).cast("tinyint").alias("label"), F.when(active, "active").otherwise("inactive").alias("label_type"),
        F.col("pchembl_value").try_cast("double").alias("pchembl_value"),
    )


#: Record columns of the affinity table and their names here.
RECORD_COLUMNS = {
    "BindingDB Reactant_set_id": "record_id", "Ligand SMILES": "smiles", "Ligand InChI Key": "ligand_key", "BindingDB MonomerID": "monomer_id",
    "Target Name": "target_name", "Target Source Organism According to Curator or DataSource": "organism", "Ki (nM)": "ki", "IC50 (nM)": "ic50",
    "Kd (nM)": "kd", "EC50 (nM)": "ec50", "Article DOI": "doi", "PMID": "pmid", "ChEMBL ID of Ligand": "chembl_id_ligand",
    "ZINC ID of Ligand": "zinc_id_ligand", "PDB ID(s) for Ligand-Target Complex": "pdb_ids", "Number of Protein Chains in Target (>1 implies a multichain complex)": "n_chains",
    "UniProt (SwissProt) Primary ID of Target Chain": "accession",
}


def affinity_records(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated affinity records: 17 columns by header, all text; short rows are dropped."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path)
    have = set(df.columns)
    return df.select(*(F.col(f"`{a}`").alias(b) if a in have else F.lit(None).cast("string").alias(b) for a, b in RECORD_COLUMNS.items()))
