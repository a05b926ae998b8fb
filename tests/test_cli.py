from contamgraph import cli
from contamgraph.operators import emit
from contamgraph.sources import sinks

NODE, EDGE = "node_id string, node_type string, label string, props string", "src string, dst string, edge_type string, props string"


def test_commands(spark, tmp_path, capsys, monkeypatch):
    x = spark.createDataFrame(
        [("S", str(i % 2), i, f"e{i % 3}", "s", i % 2, "active" if i % 2 else "inactive", "train", "") for i in range(8)],
        "source string, target string, row_idx int, entity string, scaffold string, label int, label_type string, split string, ext_id string",
    )
    emit.emit_nodes(x).write.parquet(f"{tmp_path}/raw/nodes")
    emit.emit_edges(x).write.parquet(f"{tmp_path}/raw/edges")
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main(["canonicalise", f"{tmp_path}/raw", f"{tmp_path}/kg"]) == 0
    assert cli.main(["audit", f"{tmp_path}/kg", "--report"]) == 0
    assert "| dangling | passed | 0 |" in capsys.readouterr().out
    failed = cli.main(["audit", f"{tmp_path}/kg", "--full"])
    told = capsys.readouterr().out
    assert failed > 5 and "| unpopulated_protein_exact | FAILED | 1 |" in told and "| label_type_values | FAILED | 2 |" in told
    spark.createDataFrame([("tgt:S:0", "protein:P0")], "old_id string, new_id string").write.parquet(f"{tmp_path}/map")
    assert cli.main(["canonicalise", f"{tmp_path}/raw", f"{tmp_path}/some", "--corpus", "S", "--limit", "3", "--protein-map", f"{tmp_path}/map"]) == 0
    some, some_edges = sinks.read_graph(spark, f"{tmp_path}/some")
    assert some.where("node_type = 'Example'").count() == 3 and {r["dst"] for r in some_edges.where("edge_type = 'example_has_protein' and src like 'ex:S:0:%'").collect()} == {"protein:P0"}
    assert cli.restricted(some, some_edges, "other")[1].where("src like 'ex:%'").count() == 0
    assert cli.main(["stats", f"{tmp_path}/kg", f"{tmp_path}/stats"]) == 0
    nodes, edges = sinks.read_graph(spark, f"{tmp_path}/kg")
    nodes.where("node_type <> 'Split'").write.parquet(f"{tmp_path}/bad/nodes")
    edges.write.parquet(f"{tmp_path}/bad/edges")
    assert cli.main(["audit", f"{tmp_path}/bad"]) >= 2
    prints = spark.createDataFrame([("a", [7] + [0] * 31), ("b", [7] + [0] * 31), ("c", [8] + [0] * 31)], "id string, fp array<long>")
    prints.write.parquet(f"{tmp_path}/fp")
    assert cli.main(["similarity", f"{tmp_path}/fp", f"{tmp_path}/sim", "--threshold", "0.9"]) == 0
    row = spark.read.parquet(f"{tmp_path}/sim").collect()
    assert [(r["src"], r["dst"], r["edge_type"]) for r in row] == [("a", "b", "ligand_fingerprint_exact")] and row[0]["entity_set"]
