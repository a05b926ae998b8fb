"""Queries over whole tables: every row counts, against brute force."""
import os

import duckdb
import pytest

from contamgraph.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def brute(pairs):
    """The smallest node of each node's component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_all_lines(spark):
    pairs = duckdb.sql(f"SELECT DISTINCT l_partkey, -l_suppkey - 1 FROM '{DATA}/lineitem.parquet'").fetchall()
    f, sql = QUERIES["cc_components"]
    assert sql is None and {r["node"]: r["component"] for r in f(spark, DATA).collect()} == brute(pairs)


@pytest.mark.parametrize("name, n_rows", [("cc_leakage_groups", "SELECT count(DISTINCT o_orderkey) FROM '{}/orders.parquet'"), ("au_truth", "SELECT count(*) FROM '{}/supplier.parquet'")])
def test_no_row_is_left_out(spark, name, n_rows):
    assert QUERIES[name][0](spark, DATA).count() == duckdb.sql(n_rows.format(DATA)).fetchall()[0][0]


def test_whole_sql_has_no_row_filter():
    whole = ("gr_wire_assay", "gr_wire_publication", "gr_wire_measured", "cc_leakage_groups", "cc_degree_curve", "au_truth", "top_assays")
    assert not [n for n in whole if "orderkey %" in QUERIES[n][1] or "suppkey % 5" in QUERIES[n][1]]


def test_cuts_are_dropped(spark):
    from contamgraph.plans import lineage

    df = spark.range(5).selectExpr("id", "id % 2 as k")
    one, two = lineage.cut(df), lineage.cut_bucketed(df, "k")
    path, name = lineage._made[-1], lineage._tables[-1]
    assert one.count() == two.count() == 5 and os.path.isdir(path)
    lineage.drop_cuts(spark)
    assert not os.path.exists(path) and not spark.catalog.tableExists(name)
