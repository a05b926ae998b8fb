import re

import corpus_pipeline as P
from contamgraph.llm.secret_scan import spans_of, default_vocabulary
from test_jaccard_join import brute

BENCH = "why does the silver bridge over the yellow river sing in winter when nobody walks on its copper planks"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path, prose):
    rows = [r for r in prose if r[0] is not None]
    n = len(rows)
    rows += [(n, "before it all " + BENCH + " and after", "en", "s", 9), (n + 1, "my token = abcdef123456 stays between many other words of the text", "en", "s", 3), (n + 2, "12 34 56", "en", "s", 8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == before.columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    letters = {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    assert set(kept["language_id"]) == letters
    first = [r for r in rows if r[0] in letters]
    assert set(kept["near_duplicates"]) == {i for i, _, c in brute(first) if i == c}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {n}
    assert set(kept["secret_scan"]) == set(kept["decontamination"])
    assert "[SECRET]" in kept["secret_scan"][n + 1] and not any(spans_of(t, default_vocabulary()) for t in kept["secret_scan"].values())
    assert {r["doc_id"] for r in docs.collect()} == set(kept["secret_scan"])
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]
