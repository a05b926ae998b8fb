import random

import numpy as np
from pyspark.sql import functions as F

from contamgraph.llm.cotrain import Logistic, classify, text_features

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def corpus(n=400):
    rng = random.Random(2)
    words = "the river and stone of cloud window garden market".split()
    out, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        t = " ".join(rng.choice(words) + ("" if good else rng.choice(["!!", " |", "###"])) for _ in range(rng.randint(20, 80)))
        out.append((i, t, rng.choice(["s0", "s1"]) if good else rng.choice(["s1", "s2"]), "en", len(t)))
        labels.append((i, int(good)))
    return out, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("keep", F.lit(1)).withColumn("score", F.lit(0))
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify(df, known, exchange=20).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["keep"], bool(y)) for i, y in labels if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("score", "p_text", "p_meta"))


def test_odd_rows(spark):
    rows, labels = corpus(80)
    rows += [(500, None, None, None, None), (None, "the river", "s0", "en", 9), (501, "", "s0", None, 0), (0, rows[0][1], "s0", "en", 3)]
    known = spark.createDataFrame([*labels, (0, 1), (1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    out = classify(spark.createDataFrame(rows, SCHEMA), known)
    assert out.count() == len(rows) and out.where("score is null").count() == 0


def test_one_class_or_no_labels(spark):
    rows, labels = corpus(20)
    df = spark.createDataFrame(rows, SCHEMA)
    ones = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int")
    assert {r["score"] for r in classify(df, ones).collect()} == {1.0}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classify(df, none).collect()} == {0.5}
    assert classify(spark.createDataFrame([], SCHEMA), ones).count() == 0


def test_logistic_recovers_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    assert ((Logistic(x, y).logit(x) > 0) == (y > 0)).mean() > 0.97


def test_features_do_not_depend_on_the_block():
    texts = ["The cat sat.\nThe cat sat.\n", "", "A!! B!! C!!", "é ß 12 | 34", "x"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    whole = text_features(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, r in enumerate(raw):
        assert np.allclose(whole[i], text_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])


def plain_rounds(rows, labels, rounds, confident):
    """The same method row by row: models of both views after some rounds of exchange."""
    import math
    from contamgraph.llm import blocks as B
    from contamgraph.llm.cotrain import LEAST_Z, WORD_CELLS, text_cells

    distinct = {r["key"]: r for r in rows}
    data, stats = [], {}
    for key in sorted(distinct):
        r = distinct[key]
        raw = (r["text"] or "").encode()
        x = text_cells(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1].tolist()
        stats[key] = text_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype(float)
        assert {int(w >> np.uint64(48)) for w in B.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]} == {c for c in x if c < WORD_CELLS}
        z = [r["m0"], 32 + r["m1"], 64 + int(math.log2((r["n_chars"] or 0) + 1))]
        own = [labels[q["doc_id"]] for q in rows if q["key"] == key and labels.get(q["doc_id"]) in (0, 1)]
        data.append((key, (x, z), min(own) if own else None, r["fold"] == 4))
    held = [d for d in data if d[3] and d[2] is not None]
    learned = [{d[0]: d[2] for d in data if d[2] is not None and not d[3]} for _ in range(2)]
    pool = {d[0] for d in data if d[2] is None}

    def fit(view):
        own = [(d[1][view], learned[view][d[0]]) for d in data if d[0] in learned[view]]
        n = [sum(y == c for _, y in own) for c in (0, 1)]

        def odds_of(k):
            odds = math.log((k[1] + 0.5) / (n[1] + 1) * (n[0] + 1) / (k[0] + 0.5))
            error = math.sqrt(sum(1 / (k[c] + 0.5) - 1 / (n[c] + 1) for c in (0, 1)))
            return odds if abs(odds) >= LEAST_Z * error else 0.0

        weight = {c: odds_of([sum(c in cells for cells, y in own if y == v) for v in (0, 1)]) for c in {c for cells, _ in own for c in cells}}

        def evidence(d):
            out = list(stats[d[0]]) if view == 0 else []
            for block in (0, 1) if view == 0 else (0,):
                w = [weight.get(c, odds_of([0, 0])) for c in d[1][view] if view or c // WORD_CELLS == block]
                out += [sum(w) / math.sqrt(max(len(w), 1)), math.log1p(sum(x for x in w if x >= 2)), math.log1p(sum(-x for x in w if x <= -2))]
            return out

        platt = Logistic(np.array([evidence(d) for d in held]), np.array([d[2] for d in held], float))
        return lambda d: 1 / (1 + math.exp(-max(-40, min(40, float(platt.logit(np.array([evidence(d)]))[0])))))

    for _ in range(rounds):
        views = fit(0), fit(1)
        gone = set()
        for d in data:
            if d[0] in pool:
                for view in (0, 1):
                    p = views[view](d)
                    if p >= confident or p <= 1 - confident:
                        learned[1 - view][d[0]] = int(p >= confident)
                        gone.add(d[0])
        pool -= gone
    views = fit(0), fit(1)
    return {d[0]: (views[0](d), views[1](d)) for d in data}


def test_equals_plain_co_training(spark):
    from contamgraph.llm.cotrain import cotrain

    rows, labels = corpus(150)
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 60, 3)]
    labels = {i: y for i, y in labels if i % 2}
    df = spark.createDataFrame(rows, SCHEMA)
    text, size = F.coalesce("text", F.lit("")), F.coalesce("n_chars", F.lit(-1))
    meta = [F.pmod(F.xxhash64(F.lit(j), F.col(c)), F.lit(32)) for j, c in enumerate(("source", "lang"))]
    key = F.xxhash64(text, size, *meta)
    seen = df.select("*", key.alias("key"), meta[0].alias("m0"), meta[1].alias("m1"), F.pmod(F.xxhash64(F.lit(1), key), F.lit(5)).alias("fold")).collect()
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for rounds in (0, 1, 2):
        want = plain_rounds(seen, labels, rounds, 0.8)
        by = {r["doc_id"]: want[r["key"]] for r in seen}
        got = cotrain(df, known, ("quality",), rounds=rounds, confident=0.8).collect()
        assert len(got) == len(rows)
        assert all(abs(r["p"][v] - by[r["doc_id"]][v]) < 1e-4 for r in got for v in (0, 1))


def test_a_second_label(spark):
    rng = random.Random(4)
    rows, labels = corpus(400)
    toxic = {i: int(rng.random() < 0.3) for i, *_ in rows}
    rows = [(i, t + (" you idiot" if toxic[i] else ""), *r) for i, t, *r in rows]
    known = spark.createDataFrame([(i, y, toxic[i]) for i, y in labels if i % 3], "doc_id long, quality int, toxic int")
    out = classify(spark.createDataFrame(rows, SCHEMA), known, flag_col="toxic").collect()
    assert np.mean([r["toxic"] == bool(toxic[r["doc_id"]]) for r in out]) > 0.97
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "p_text", "p_meta", "score", "keep", "toxic_score", "toxic"}


def test_calibration_rows_are_bounded(spark):
    rows, labels = corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = classify(spark.createDataFrame(rows, SCHEMA), known, max_labelled=20)
    assert out.count() == 300 and out.where("score is null").count() == 0
