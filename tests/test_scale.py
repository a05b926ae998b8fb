"""Plans that must not grow faster than their tables, and their results against plainer forms."""
import random

import pytest
from pyspark.sql import functions as F

from contamgraph.operators import provenance
from contamgraph.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wired_counts_equal_the_listed_paths(spark):
    rng = random.Random(3)
    mids = [*range(20)] + [0] * 60
    rows = [(f"e{i}", rng.choice(mids), d) for i in range(300) for d in rng.sample([*range(40), None], 2)]
    rows = [(s, {s: m for s, m, _ in rows}[s], d) for s, _, d in rows] * 2 + [("e9999", None, 1)]
    links = spark.createDataFrame(rows, "src string, mid int, dst int")
    has, reach = links.select("src", F.col("mid").cast("string").alias("dst")), links.select(F.col("mid").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    listed = provenance.wire([has, reach], "t", "S").groupBy("dst").agg(F.count("*").alias("n"))
    want = {r["dst"]: r["n"] for r in listed.collect()}
    assert {r["dst"]: r["n"] for r in provenance.wired_counts(links).collect()} == want and None in want


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Order lines with repeats, nulls in the example id, orders without a part and one hub part."""
    d = str(tmp_path_factory.mktemp("star"))
    rng = random.Random(5)
    lines = [(rng.randrange(60), 0 if rng.random() < 0.4 else rng.randrange(25), rng.choice([*range(12), None]), rng.choice([1, 2, 3, None]), rng.choice("RNA"), rng.choice("OF")) for _ in range(400)]
    spark.createDataFrame(lines + lines[:50] + [(1, None, 1, 1, "R", "O")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    orders = [(o, rng.choice([*range(9), None]), rng.choice(["1-URGENT", "3-MEDIUM", "5-LOW"]), f"199{o % 5}-03-01") for o in [*range(55), 7, 7, 8]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, day string").withColumn("o_orderdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(p, f"T{p % 4}", p % 50) for p in range(22)], "p_partkey long, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(12)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{d}/region.parquet")
    return d


def same_as_listed(spark, star, name, key, prefix):
    from contamgraph import adapters
    from contamgraph.operators import emit

    e = emit.with_ids(adapters.star_examples(spark, star))
    has, reach = e.select(F.col("example_id").alias("src"), F.col("ligand_id").alias("dst")), e.select(F.col("ligand_id").alias("src"), F.concat(F.lit(prefix), key).alias("dst"))
    want = sorted((r["dst"] or "", r["count"]) for r in provenance.wire([has, reach], "t", "S").groupBy("dst").count().collect())
    df = QUERIES[name][0](spark, star)
    assert len(want) > 5 and plan(df).count("Join ") == 2, "the paths are listed"
    return sorted((r[0] or "", r[1]) for r in df.collect()), want


def test_gr_wire_assay_lists_no_paths(spark, star):
    got, want = same_as_listed(spark, star, "gr_wire_assay", "o_orderkey", "chembl_asy:")
    assert got == want


def test_gr_wire_publication_lists_no_paths(spark, star):
    got, want = same_as_listed(spark, star, "gr_wire_publication", "o_custkey", "chembl_doc:")
    assert got == want


def test_top_assays_lists_no_paths(spark, star):
    got, want = same_as_listed(spark, star, "top_assays", "o_orderkey", "chembl_asy:")
    assert got == want  # fewer than 100 assays


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_jaccard_pairs_move_hashes_of_prefixes(spark, threshold):
    from contamgraph.operators import similarity
    from contamgraph.plans import lineage

    rng = random.Random(9)
    sets = {i: {f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.choice([1, 3, 8, 30]))} for i in range(150)}
    sets |= {200 + i: sets[i] ^ {f"w{rng.randrange(60)}" for _ in range(rng.randrange(3))} for i in range(100)} | {400: set()}
    made = len(lineage._made)
    got = similarity.jaccard_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>"), threshold)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] | sets[b]}
    assert {(r["src"], r["dst"]): r["similarity"] for r in got.collect()} == {k: v for k, v in want.items() if v >= threshold}
    assert not [p for p in lineage._made[made:] if "tokens" in spark.read.parquet(p).columns]


def test_equal_texts_meet_by_digest(spark):
    from contamgraph.operators import relational

    df = spark.createDataFrame([(5, "a"), (2, "a"), (2, "a"), (9, "b"), (1, None), (3, ""), (4, "")], "k long, text string")
    one = relational.smallest_of_equal(df.groupBy("k", "text").count().drop("count").localCheckpoint(), "k", "text")
    assert sorted((r["k"], r["text"]) for r in one.collect()) == [(2, "a"), (3, ""), (9, "b")]
    assert "Aggregate" not in plan(one), "texts are grouped"


def test_components_tell_rounds_apart_beyond_the_range_of_a_sum(spark):
    from contamgraph.operators import components

    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (-F.col("id")).alias("v"))
    n, h = components._state(edges)
    assert n == 20_000_000
    assert (n, h) == components._state(edges.repartition(3)) != components._state(edges.withColumn("v", F.col("v") - (F.col("u") == 7).cast("int")))


def test_known_repeats_emit_the_same_graph(spark, star):
    from contamgraph import adapters
    from contamgraph.operators import emit
    from contamgraph.plans.lineage import cut

    x = cut(adapters.star_examples(spark, star))
    x = cut(x.unionByName(x.limit(20).withColumn("label_type", F.lit("odd"))).unionByName(x.limit(3).withColumn("entity", F.lit(None).cast("string"))))
    again = emit.repeated(x)
    ids = [r["n"] for r in emit.with_ids(x).groupBy("example_id").agg(F.count("*").alias("n")).collect()]
    assert again.count() == sum(n > 1 for n in ids) and 1 in ids
    for plain, known in ((emit.emit_nodes(x), emit.emit_nodes(x, again)), (emit.emit_edges(x), emit.emit_edges(x, again))):
        assert sorted(map(str, known.collect())) == sorted(map(str, plain.collect()))
    few = plan(emit.emit_edges(x.where("target = '1'"), emit.repeated(x.where("target = '1'"))))
    assert "LeftAnti" in few and "LeftSemi" in few, "edges of examples that do not repeat are dealt anew"
    alone = x.where("false")
    assert emit.emit_edges(alone, emit.repeated(alone)).count() == emit.emit_nodes(alone, emit.repeated(alone)).count() == 0


def test_a_small_id_map_goes_to_the_edges(spark):
    from contamgraph.operators import relational

    edges = spark.createDataFrame([("a", "b", "t", "{}"), ("c", "b", "t", "{}"), ("a", "d", "t", "x"), ("z", "d", "t", "{}"), ("q", "q", "t", "{}")], "src string, dst string, edge_type string, props string")
    mapping = spark.createDataFrame([("a", "A2"), ("a", "A1"), ("b", "B"), ("z", "A1"), (None, "N")], "old_id string, new_id string")
    out = relational.rewrite_ids(edges, mapping)
    assert sorted(map(tuple, out.collect())) == [("A1", "B", "t", "{}"), ("A1", "d", "t", "x" if "x" < "{}" else "{}"), ("c", "B", "t", "{}"), ("q", "q", "t", "{}")]
    assert plan(out).count("rightHint=(strategy=broadcast)") == 2, "the edges are dealt anew by each end"
