"""SQLite as a Spark data source, read-only.

``spark.read.format("sqlite").option("path", file).option("query", sql)`` or
``.option("table", name)``.  With ``key`` (an integer column) and ``partitions`` the
rows are read in parallel by key range; each task opens the file itself, so the
file must be reachable from every executor.
"""
from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUM", "double"), ("DEC", "double"))


def _connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, key: str | None, partitions: int, names: list[str]):
        self.path, self.table, self.key, self.n, self.names = path, table, key, partitions, names

    def partitions(self) -> list[InputPartition]:
        if not self.key or self.n < 2:
            return [_Range(None, None)]
        with _connect(self.path) as con:
            low, high = con.execute(f"select min({_quote(self.key)}), max({_quote(self.key)}) from {self.table}").fetchone()
        if low is None:
            return [_Range(None, None)]
        step = (high - low) // self.n + 1
        return [_Range(low + i * step, low + (i + 1) * step) for i in range(self.n)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        sql = f"select {', '.join(map(_quote, self.names))} from {self.table}"
        args: tuple = ()
        if partition.low is not None:
            sql, args = f"{sql} where {_quote(self.key)} >= ? and {_quote(self.key)} < ?", (partition.low, partition.high)
        with _connect(self.path) as con:
            yield from con.execute(sql, args)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        o = self.options
        return f"({o['query']})" if "query" in o else _quote(o["table"])

    def schema(self) -> str:
        with _connect(self.options["path"]) as con:
            if "query" in self.options:
                cur = con.execute(f"select * from {self._table()} limit 0")
                return ", ".join(f"`{d[0]}` string" for d in cur.description)
            info = con.execute(f"pragma table_info({_quote(self.options['table'])})").fetchall()
        kind = lambda t: next((k for p, k in _TYPES if p in (t or "").upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in info)

    def reader(self, schema) -> SqliteReader:
        o = self.options
        return SqliteReader(o["path"], self._table(), o.get("key"), int(o.get("partitions", 1)), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def table(spark: SparkSession, path: str, name: str, key: str | None = None, partitions: int = 1) -> DataFrame:
    register(spark)
    r = spark.read.format("sqlite").option("path", path).option("table", name)
    return (r.option("key", key).option("partitions", partitions) if key else r).load()


def list_tables(path: str) -> list[str]:
    with _connect(path) as con:
        return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]


def _columns(df: DataFrame, **names: str) -> DataFrame:
    """Columns by their names here; null where the file has no such column."""
    have = set(df.columns)
    return df.select(*(F.col(c).alias(n) if c in have else F.lit(None).cast("string").alias(n) for n, c in names.items()))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Publications: keys, identifiers, year, journal and title."""
    return _columns(table(spark, path, "docs"), doc_id="doc_id", document_chembl_id="chembl_id", pubmed_id="pubmed_id", doi="doi", year="year", journal="journal", title="title")


def assays(spark: SparkSession, path: str) -> DataFrame:
    """Assays with their type, publication and target."""
    return _columns(table(spark, path, "assays"), assay_id="assay_id", assay_chembl_id="chembl_id", assay_type="assay_type", description="description", doc_id="doc_id", tid="tid")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets: name, kind and organism."""
    return _columns(table(spark, path, "target_dictionary"), tid="tid", target_chembl_id="chembl_id", pref_name="pref_name", target_type="target_type", organism="organism")


def activities(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """Measured activities, read in parallel by activity id."""
    names = ("activity_id", "molregno", "assay_id", "standard_type", "standard_relation", "standard_value", "standard_units", "pchembl_value", "doc_id")
    return _columns(table(spark, path, "activities", key="activity_id", partitions=partitions), **{c: c for c in names})


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """Molecules with their structures, where they have one."""
    return table(spark, path, "molecule_dictionary").join(table(spark, path, "compound_structures"), "molregno", "left")


def target_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Protein targets with a sequence."""
    t, c, s = (table(spark, path, n) for n in ("target_dictionary", "target_components", "component_sequences"))
    return t.join(c, "tid").join(s, "component_id").where("sequence is not null and component_type = 'PROTEIN'")


def activities_of(activities: DataFrame, keys: DataFrame, key: str = "molregno") -> DataFrame:
    """Activities of the listed molecules; none for an empty list."""
    return activities.join(keys.select(F.col(key)).distinct(), key, "left_semi")
