"""Sinks: ordered graph tables, statistics, reports, guarded writes."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contamgraph.operators.audit import assert_writable


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Globally ordered Parquet: ranges are dealt once, then sorted inside partitions."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write to a temporary sibling, check what was written, then rename.

    A failed check or a lost run leaves the graph at ``path`` as it was.
    """
    spark = nodes.sparkSession
    tmp = f"{path.rstrip('/')}_tmp_{uuid.uuid4().hex}"
    write_ordered(nodes, f"{tmp}/nodes", ["node_id"])
    edges.repartitionByRange("edge_type", "src", "dst").sortWithinPartitions("edge_type", "src", "dst").write.partitionBy("edge_type").parquet(f"{tmp}/edges")
    fs, tmp_path = _fs(spark, tmp)
    try:
        n, e = spark.read.parquet(f"{tmp}/nodes"), spark.read.parquet(f"{tmp}/edges")
        assert_writable(n.drop("degree"), e)
    except ValueError:
        fs.delete(tmp_path, True)
        raise
    _, final = _fs(spark, path)
    old = None
    if fs.exists(final):
        old = _fs(spark, f"{path.rstrip('/')}_old_{uuid.uuid4().hex}")[1]
        fs.rename(final, old)
    fs.rename(tmp_path, final)
    if old is not None:
        fs.delete(old, True)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def replace_edge_types(spark: SparkSession, path: str, fresh: DataFrame, types: list[str]) -> None:
    """Replace whole edge types in a table partitioned by type; other partitions are not touched."""
    own = fresh.where(F.col("edge_type").isin(*types)).distinct()
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edge_type").parquet(path)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, value): counts of nodes and edges, in total and by type."""
    def part(df: DataFrame, kind: str, column: str) -> DataFrame:
        by = df.groupBy(F.concat(F.lit(f"{kind}::"), F.col(column)).alias("key")).agg(F.count("*").alias("value"))
        return by.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(kind).alias("key"), "value"))

    return part(nodes, "node", "node_type").unionByName(part(edges, "edge", "edge_type"))


def write_statistics(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    statistics(nodes, edges).orderBy("key").write.mode("overwrite").option("header", True).csv(path)


def markdown(table: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table."""
    rows = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(rows + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in table.collect()]) + "\n"


def tagged(edges: DataFrame, digest: str) -> DataFrame:
    """Edges that carry the digest of the entities they were made from."""
    return edges.withColumn("entity_set", F.lit(digest))


def reattach(graph_edges: DataFrame, kept: DataFrame, digest: str, types: list[str]) -> DataFrame:
    """Graph edges with saved ones put back, if those were made from the same entities."""
    other = kept.where(~F.col("entity_set").eqNullSafe(F.lit(digest))).limit(1).collect()
    if other or not kept.limit(1).collect():
        raise ValueError("saved edges belong to another set of entities" if other else "no saved edges")
    return graph_edges.where(~F.col("edge_type").isin(*types)).unionByName(kept.drop("entity_set"))


def write_id_map(mapping: DataFrame, path: str) -> None:
    """The trace of a merge: one row for each id that another replaced, ordered."""
    write_ordered(mapping.where("old_id <> new_id").select("old_id", "new_id").distinct(), path, ["old_id"])


def stamp(text: dict) -> str:
    return json.dumps(text, sort_keys=True)
