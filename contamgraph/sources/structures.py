"""Sequence sources: structure files, FASTA and alignment tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Residue names and letters.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L",
    "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "SEC": "U", "PYL": "O", "MSE": "M",
}


def ca_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, sequence) of the longest chain of each structure file, from the C-alpha
    atoms of its polymer and hetero records.

    Residues in order of number; names that stand for no residue are skipped, the last
    record of a number counts; of equally long chains the first in the file.
    """
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    field = lambda at, n: F.trim(F.substring("value", at, n))
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    atom = line.where(F.rtrim(F.substring("value", 1, 6)).isin("ATOM", "HETATM") & (field(13, 4) == "CA")).select(
        "file", "place", F.substring("value", 22, 1).alias("chain"), field(23, 4).try_cast("int").alias("no"), F.try_element_at(letters, F.upper(field(18, 3))).alias("aa"),
    ).where("no is not null and aa is not null")
    residue = atom.groupBy("file", "chain", "no").agg(F.max_by("aa", "place").alias("aa"), F.min("place").alias("place"))
    chain = residue.groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("no", "aa"))).alias("r"), F.min("place").alias("place"))
    chain = chain.select("file", "chain", "place", F.array_join(F.transform("r", lambda x: x["aa"]), "").alias("sequence"))
    best = F.min_by(F.struct("chain", "sequence"), F.struct(-F.length("sequence"), F.col("place")))
    return chain.groupBy("file").agg(best.alias("c")).select("file", "c.*")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, header, sequence); ``db|ACC|NAME`` headers give ACC."""
    rec = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.trim(F.regexp_extract("value", r"^[^\r\n]*", 0))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    word = F.element_at(F.split(head, r"\s+"), 1)
    acc = F.when(word.rlike(r"^[^|]*\|[^|]+\|"), F.split_part(word, F.lit("|"), F.lit(2))).otherwise(word)
    return rec.select(acc.alias("accession"), head.alias("header"), body.alias("sequence"))


def write_fasta(df: DataFrame, path: str) -> None:
    """One record a line pair, ordered by id."""
    df.orderBy("accession").select(F.concat(F.lit(">"), "accession", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)


HITS = "query string, target string, pident double, alnlen long, qlen long, tlen long, evalue double, bits double"


def alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS).option("sep", "\t").csv(path)


def best_hit(hits: DataFrame) -> DataFrame:
    """The highest-scoring target of each query (ties: smaller target)."""
    return hits.groupBy("query").agg(F.min_by(F.struct("target", "bits"), F.struct(-F.col("bits"), F.col("target"))).alias("h")).select("query", "h.*")


def cluster_members(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """Two-column cluster table (representative, member)."""
    df = spark.read.schema("cluster_id string, protein_id string").option("sep", "\t").csv(path)
    return df.select("protein_id", "cluster_id", F.lit(resolution).alias("resolution"))
