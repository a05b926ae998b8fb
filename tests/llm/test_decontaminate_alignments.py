import random

from contamgraph.llm.decontaminate import leaks, without_leaks

PILES = "take 5 stones and put 5 stones on the pile then add 5 more stones until 5 piles hold 5 stones and 5 bags"


def found(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in leaks(docs, bench).collect()}
    assert {d for d, _ in out} == {*range(len(texts))} - {r["doc_id"] for r in without_leaks(docs, bench).collect()}
    return out


def test_a_long_quotation_is_a_leak_whatever_its_share(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    quote = lambda n: "before it " + " ".join(words[30 : 30 + n]) + " after it"
    got = found(spark, [" ".join(words)], [quote(40), quote(13), quote(12)])
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0]["coverage"] == 0.4 and got[0, 0]["verbatim"]


def test_a_variant_before_a_copy_does_not_hide_it(spark):
    part = " ".join(PILES.split()[:12]).replace("5", "9")
    for copy in (PILES, PILES.replace("5", "7")):
        got = found(spark, [PILES], [f"{part} whatever else. {copy}"])
        assert set(got) == {(0, 0)} and got[0, 0]["coverage"] == 1.0


def test_words_put_into_a_copy_do_not_hide_it(spark):
    words = PILES.split()
    assert set(found(spark, [PILES], [" ".join([*words[:11], "very", "slowly", *words[11:]])])) == {(0, 0)}
