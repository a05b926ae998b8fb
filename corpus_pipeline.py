"""Training-corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Each stage works on all that its predecessor kept and returns the columns of
``documents``; only the last returns packed pieces.  Ids need not name documents:
they may be null or shared, and a row leaves at the near-duplicate stage only if
another row of its group stays.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contamgraph.llm.decontaminate import without_leaks
from contamgraph.llm.jaccard_join import near_duplicate_components
from contamgraph.llm.language_id import keep_identified
from contamgraph.llm.packing import pack
from contamgraph.llm.queries import held_out
from contamgraph.llm.secret_scan import redact
from contamgraph.plans.lineage import cut, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, which ``lang`` then names; those in none go."""
    return keep_identified(docs, held_out(4), write_lang=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (null last, ties by row key)."""
    # rows are told apart by all their columns, so equal rows are one
    every = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.withColumn("_row_key", F.xxhash64(*every))
    found = near_duplicate_components(keyed, id_col="_row_key").select("_row_key", "component_id").distinct()
    ids = keyed.select("_row_key", F.col("doc_id").isNull().alias("no_id"), "doc_id").distinct()
    first = found.join(ids, "_row_key").groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "_row_key")).alias("row"))
    kept = first.select(F.col("row._row_key").alias("_row_key"))
    return keyed.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers, names or units."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` is that of the new text."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL cannot express mixture inference, prefix filtering or tokenisation; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = cut(docs)
    return docs
