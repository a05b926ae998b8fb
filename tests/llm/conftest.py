import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone cloud window garden market simple orange letter silver forest bridge yellow copper winter summer island".split()


@pytest.fixture(scope="session")
def prose():
    """Random texts, their copies and near copies, odd rows."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [say(rng.randint(6, 80)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1] + " extra", texts[2].replace("the", "THE", 1)]
    long = say(300)
    texts += [long, long.replace("river", "lake", 2), "intro " + long, long + " outro"]
    texts += ["", " \n\t ", "one", "one two", "one two", "a b c d e", "ÉTÉ été ñandú straße", "x" * 3000, "ab " * 900]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None), (None, texts[3], None, "s", 5)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, prose):
    return spark.createDataFrame(prose, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
