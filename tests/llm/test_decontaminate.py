from pyspark.sql import functions as F

from contamgraph.llm.decontaminate import leaks, without_leaks

ITEMS = [
    (1, "A train travels 120 miles in 3 hours and then stops for 15 minutes before it goes on to Boston at the same speed."),
    (2, "How many apples does Maria have if she buys 5 kg of apples and gives 2 kg of them to her neighbour on Sunday?"),
    (3, "short one here now"),
    (4, None),
    (5, ""),
    (6, "tiny"),
]


def run(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("coverage", F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    return {(r["doc_id"], r["item_id"]): r for r in leaks(docs, bench, **kw).collect()}


def test_verbatim_and_reparameterised(spark):
    other = ITEMS[0][1].replace("120", "4,500").replace("3 hours", "7 days").replace("15", "20").replace("Boston", "Chicago")
    filler = "some words that stand around the passage and mean nothing at all. " * 5
    got = run(spark, [filler + ITEMS[0][1] + filler, filler + other, filler, ITEMS[1][1].upper(), None, "", ITEMS[0][1][:40]])
    assert set(got) == {(0, 1), (1, 1), (3, 2)}
    assert got[0, 1]["verbatim"] and not got[1, 1]["verbatim"]
    assert got[1, 1]["n_slots"] >= 4 and got[1, 1]["slot_consistency"] == 1.0


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 stones and put 5 stones on the pile then add 5 more stones until 5 piles hold 5 stones and 5 bags"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    values = iter("1 2 3 4 6 7".split())
    mixed = " ".join(next(values) if w == "5" else w for w in item.split())
    docs = spark.createDataFrame([(0, item.replace("5", "9")), (1, mixed)], "doc_id long, text string")
    assert [r["doc_id"] for r in leaks(docs, bench).collect()] == [0]


def test_short_items(spark):
    got = run(spark, ["well, short one here now", "tiny", "short one"])
    assert set(got) == {(0, 3)}


def test_placeholders_alone_match_nothing(spark):
    bench = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "9 8 7 6 5 4 3 2 1 0")], "doc_id long, text string")
    assert leaks(docs, bench).count() == 0


def test_chunks_give_the_same_rows(spark):
    texts = [ITEMS[0][1], ITEMS[1][1], "nothing to see"]
    assert set(run(spark, texts)) == set(run(spark, texts, chunk_tokens=20))


def test_filter_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(0, ITEMS[0][1], "a"), (1, "clean text", "b"), (2, None, "c"), (1, "clean text", "b")], "doc_id long, text string, source string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = without_leaks(docs, bench)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 1, 2]


def test_empty_tables(spark, no_docs, docs, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, none).count() == 0 and without_leaks(docs, none).count() == len(prose)
    assert leaks(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
