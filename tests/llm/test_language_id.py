import random

from pyspark.sql import functions as F

from contamgraph.llm.language_id import identify, keep_identified

VOCAB = {
    "en": "the and with this river house from which would there people water night".split(),
    "de": "der und mit dieser fluss haus nicht wasser straße über schön können".split(),
    "fr": "les avec cette rivière maison pas vous très être où leçon façon".split(),
}


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, " ".join(rng.choice(VOCAB[lang]) for _ in range(rng.randint(3, 60))), lang))
    return out


SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["doc_id"]: r for r in identify(df, F.col("doc_id") % 4 == 2).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[2]["held_out"] and not got[1]["held_out"]


def test_mixtures(spark):
    data = rows()
    rng = random.Random(5)
    en, de = (" ".join(rng.choice(VOCAB[x]) for _ in range(60)) for x in ("en", "de"))
    df = spark.createDataFrame([*data, (100, en + " " + de[: len(de) // 2], None)], SCHEMA)
    r = identify(df, F.lit(False)).where("doc_id = 100").first()
    assert r["lang_pred"] == "en" and set(r["langs"]) == {"en", "de"} and 0.5 < r["score"] < 0.85


def test_undetermined(spark):
    odd = [(200, None, "en"), (201, "", "en"), (202, "12 34 !? ...", None), (203, "—…", None), (None, "the and", "en"), (1, "the and", None)]
    got = identify(spark.createDataFrame([*rows(), *odd], SCHEMA), F.col("doc_id") % 4 == 2)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.where("doc_id >= 200").collect()}
    assert set(by.values()) == {("und", 0.0)} and len(by) == 4
    assert got.count() == 66 and got.where("doc_id is null").first()["lang_pred"] == "en"


def test_prediction_does_not_see_labels(spark):
    data = rows()
    a = identify(spark.createDataFrame(data, SCHEMA), F.col("doc_id") % 4 == 2)
    wrong = [(i, t, "zz" if i % 4 == 2 else lang) for i, t, lang in data]
    b = identify(spark.createDataFrame(wrong, SCHEMA).withColumn("score", F.lit("x")), F.col("doc_id") % 4 == 2)
    assert sorted(map(tuple, a.select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, b.select("doc_id", "lang_pred", "score").collect()))


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "the and", None)], SCHEMA)
    assert identify(df, F.lit(False)).first()["lang_pred"] == "und"
    none = spark.createDataFrame([], SCHEMA)
    assert identify(none, F.lit(False)).count() == 0 and keep_identified(none, F.lit(False)).count() == 0


def test_filter_keeps_rows_as_they_are(spark):
    df = spark.createDataFrame([*rows(), (300, "123", "en"), (301, None, None)], SCHEMA).withColumn("score", F.lit(3))
    out = keep_identified(df, F.lit(False))
    assert out.columns == df.columns and out.count() == 60
    assert keep_identified(df, F.lit(False), languages=("de",)).count() == 20


def plain_mixture(words, table, penalty):
    """The rule for one document, word by word in plain Python."""
    import math

    langs = range(table.shape[1])
    like = [[sum(float(table[c, j]) for c in w) for j in langs] for w in words]
    top = [max(x) for x in like]
    like = [[math.exp(v - t) for v in x] for x, t in zip(like, top, strict=True)]

    def em(share):
        while True:
            new, log = [0.0] * len(share), 0.0
            for x in like:
                joint = [a * b for a, b in zip(x, share, strict=True)]
                total = max(sum(joint), 1e-30)
                log += math.log(total)
                new = [n + v / total / len(like) for n, v in zip(new, joint, strict=True)]
            if max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-3:
                return new, log
            share = new

    full, _ = em([1 / len(langs)] * len(langs))
    rank = sorted(langs, key=lambda j: -full[j])
    best = None
    for m in range(1, len(langs) + 1):
        part = [full[j] + 1e-6 if j in rank[:m] else 0.0 for j in langs]
        part = [x / sum(part) for x in part]
        part, log = em(part)
        value = log - penalty * m * math.log(len(words) + 1)
        if best is not None and value <= best[0]:
            break
        best = (value, part, (log + sum(top)) / sum(map(len, words)))
    return best[1:]


def test_equals_plain_expectation_maximisation():
    import numpy as np
    from contamgraph.llm.language_id import CELLS, mixtures

    rng = np.random.default_rng(4)
    n_langs, docs = 6, []
    raw = rng.dirichlet(np.full(40, 0.2), n_langs)
    table = np.full((CELLS, n_langs), np.log(1e-6), np.float32)
    table[:40] = np.log(raw.T * (1 - 1e-3) + 1e-5)
    for kinds in ([0], [1, 2], [0, 1, 2, 3], [5, 4, 3, 2, 1, 0], [2], [3, 3, 0]):
        docs.append([rng.choice(40, rng.integers(1, 9), p=raw[kinds[i % len(kinds)]]).tolist() for i in range(int(rng.integers(12, 90)))])
    docs.append([[7]])
    cell = np.array([c for d in docs for w in d for c in w])
    flat = [w for d in docs for w in d]
    word = np.repeat(np.arange(len(flat)), [len(w) for w in flat])
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    share, level = mixtures(cell, word, doc, len(docs), table, 2.0)
    most = 0
    for i, d in enumerate(docs):
        want, want_level = plain_mixture(d, table, 2.0)
        assert np.allclose(share[i], want, atol=0.01) and abs(level[i] - want_level) < 0.01
        most = max(most, sum(x > 0 for x in want))
    assert most > 3


def test_background_rejects_what_is_in_no_language(spark):
    rng = random.Random(9)
    data = [(i, t + " " + t, lang) for i, t, lang in rows(n=900)]
    noise = " ".join("".join(rng.choice("bcfgjkpqvxyz") for _ in range(rng.randint(4, 9))) for _ in range(80))
    many = " ".join(rng.choice(VOCAB[x]) for x in ("en", "de", "fr") * 40)
    df = spark.createDataFrame([*data, (2000, noise, "en"), (2001, many, None), (2002, "the night", "zz")], SCHEMA)
    out = {r["doc_id"]: r["lang"] for r in keep_identified(df, F.col("doc_id") >= 2000, write_lang=True).collect()}
    assert 2000 not in out and 2001 in out and out[2002] == "en" and len(out) == len(data) + 2
    assert all(out[i] == lang for i, _, lang in data)


def test_ties_and_repeated_rows(spark):
    data = [(1, "same words here", "b"), (2, "same words here", "a")] * 2
    got = identify(spark.createDataFrame(data, SCHEMA), F.lit(False)).collect()
    assert len(got) == 4 and {r["lang_pred"] for r in got} == {"a"}
