"""Examples kept as stars give what the flat graph gives."""
from dataclasses import replace

from pyspark.sql import functions as F

from contamgraph.operators import audit, canonical, emit, stars
from contamgraph.plans.lineage import cut

COLUMNS = "source string, target string, row_idx string, entity string, scaffold string, label int, label_type string, split string, ext_id string"
ROWS = [
    ("a", "P12345", "1", "x", "s", 1, "active", "train", ""), ("a", "P12345", "2", "x", "s", 0, "decoy", "test", "e"), ("b", "7", "1", "y", None, 0, "inactive", "train", None),
    ("b", None, "2", "y", "t", 1, "active", "train", ""), ("b", "7", "3", None, "t", 1, "active", "test", ""),
    ("c", "P12345", "1", "x", "s", 1, "active", "train", ""), ("c", "P12345", "1", "z", "", 0, "decoy", "test", ""), ("c", "P12345", "1", "z", "", 0, "decoy", "test", ""),
]


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def joined(x, nodes, edges):
    n, e = x.flat()
    return nodes.unionByName(n), edges.unionByName(e)


def test_canonical_stars_equal_the_flat_graph(spark):
    x = spark.createDataFrame(ROWS, COLUMNS)
    told = emit.emit_stars(x)
    assert told[0].rows.count() == 5  # the repeated id is no star
    want = emit.emit_nodes(x), emit.emit_edges(x)
    assert [rows(t) for t in joined(*told)] == [rows(t) for t in want]
    want = [rows(t) for t in canonical.canonicalise(*want)]
    assert [rows(t) for t in joined(*stars.canonicalise(*told))] == want


def test_audits_of_stars_count_what_the_flat_audits_count(spark):
    x, nodes, edges = emit.emit_stars(spark.createDataFrame(ROWS, COLUMNS))
    nodes, edges = cut(nodes), cut(edges)
    star = x.rows.first()["node_id"]
    props = F.when(F.col("node_id") == star, F.concat(F.lit('{"label":7}'), F.char(F.lit(0)))).otherwise(F.regexp_replace("props", "}", ',"split":"a","label_type":"decoy"}'))
    x = replace(x, rows=cut(x.rows.withColumns({"props": props, "degree": F.when(F.col("node_id") == star, 9).otherwise(x.degree())})))
    more = spark.createDataFrame([(star, "gone", "odd", "{}"), ("lost", star, "ligand_similar", "{}")], edges.schema)
    n = nodes.where("node_type <> 'Split'").unionByName(nodes.where("node_type = 'LabelType'")).unionByName(nodes.limit(1).withColumn("node_id", F.lit(star)))
    flat = joined(replace(x, rows=x.rows.drop("degree")), n, edges.unionByName(more))
    assert rows(audit.write_guard(n, edges.unionByName(more), x)) == rows(audit.write_guard(*flat))
    flat = joined(x, nodes.withColumn("degree", F.lit(1)), edges.unionByName(more))
    assert rows(audit.facts(nodes.withColumn("degree", F.lit(1)), edges.unionByName(more), x)) == rows(audit.facts(*flat))


def test_a_cut_leaves_no_exchange(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    left = blocks.shuffleStatuses().size()
    assert cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert blocks.shuffleStatuses().size() <= left + 1  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
