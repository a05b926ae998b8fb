from collections import Counter

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ONE = "the river runs under the old stone bridge and past the silent market garden every winter"
TWO = "a yellow window opens above the copper island where nobody has counted simple letters before"
THREE = "seven orange clouds over a forest wait until the summer ends and the silver rain begins"


def test_clean_rows_without_an_id_or_with_a_shared_id_stay(spark):
    row = lambda i, t: (i, t, "en", "s", len(t))
    rows = [row(None, ONE), row(5, TWO), row(5, THREE), row(5, THREE), row(1, TWO), row(None, TWO), row(None, ""), row(7, "")]
    for parts in (1, 4):
        out = P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), "")
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(None, ONE), (1, TWO), (5, THREE), (None, ""), (7, "")])


def test_empty_table_and_extra_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA + ", node long, fp long, component_id string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    row = lambda i, t: (i, t, None, None, None)
    rows = [row(None, ONE), row(3, TWO), row(3, THREE), row(4, TWO + " again"), row(None, None), row(9, ""), row(8, "my password = hunter2hunter2 " + ONE[::-1]), (1, THREE.upper() + " x", "en", "s", 4)]
    rows += [(20 + i, " ".join(f"{w}{i}" for w in ONE.split()), "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x")).withColumn("span", F.lit(1))
    spark.createDataFrame([(1, "nothing that occurs anywhere in these few rows at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {None, 3, 8} and all(r["length"] > 0 for r in out)
