from contamgraph.llm.decontaminate import leaks, without_leaks

NAMES = "{0} has 3 apples. {0} eats 2 of them. {0} buys 7 more today. {0} gives 4 to a friend. {0} counts the rest."
ITEMS = [(1, NAMES.format("Tom")), (2, "What is the capital of France?")]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]) for r in leaks(docs, bench).collect()}
    assert {d for d, _ in out} == {*range(len(texts))} - {r["doc_id"] for r in without_leaks(docs, bench).collect()}
    return out


def test_names_that_begin_every_sentence(spark):
    assert found(spark, [NAMES.format("Anna"), NAMES.format("Anna").replace("3", "12"), "Tom walks home. Anna sings a song."]) == {(0, 1), (1, 1)}


def test_words_before_do_not_hide_a_copy(spark):
    texts = ["some filler words What is the capital of France?", "and then What is the capital of Spain?", "Paris is the capital of France", "what of the capital in France"]
    assert found(spark, texts) == {(0, 2), (1, 2)}
