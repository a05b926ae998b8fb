"""Lineage cuts that survive lost executors.

Every cut goes to the folder named by ``spark.checkpoint.dir`` (shared storage on
a cluster).  Only where that setting is absent and Spark runs on one machine alone,
as in tests, a temporary folder is created for the session; on a cluster its
absence is an error.  Cuts stay until ``drop_cuts``: results are lazy and read them.
"""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_tables: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts; read from the session, set only where unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="contamgraph-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


@contextmanager
def _exchanges_removed(spark: SparkSession):
    """What is written meanwhile leaves no exchange behind: nothing else can read it, and the table replaces it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table replaces the plan that made it, so a lost executor costs a re-read
    and not a re-computation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    with _exchanges_removed(spark):
        df.write.option("compression", codec).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_bucketed(df: DataFrame, key: str, codec: str = "zstd") -> DataFrame:
    """Like ``cut``, in the warehouse and bucketed by ``key``: later joins on the key
    leave this table where it is and move only their other side."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", codec).bucketBy(buckets, key).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all cuts made by this process; call it when their results have been read."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    while _made:
        path = path_of(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
