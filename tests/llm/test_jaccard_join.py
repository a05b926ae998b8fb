import re

import numpy as np
from pyspark.sql import functions as F

from contamgraph.llm import jaccard_join as J


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    out = []
    for i, r in enumerate(rows):
        ids = [q[0] for q, v in zip(rows, label, strict=True) if v == label[i] and q[0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return sorted(out, key=str)


def test_equals_brute_force(docs, prose):
    got = J.near_duplicate_components(docs.withColumn("component", F.lit(1)).withColumn("n", F.lit("x")))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(prose)


def test_empty_table(no_docs):
    assert J.near_duplicate_components(no_docs).count() == 0


def test_threshold_is_inclusive(spark):
    # 7 shared of 8 and 9: ratio 7/10; 6 shared of 8 in all: exactly 75 %
    base = [f"w{i}" for i in range(11)]  # 7 shingles
    rows = [(0, " ".join(base)), (1, " ".join(base[:10])), (2, " ".join(base + ["z"]))]
    got = {r[0]: r[2] for r in J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    rows = [(5, " ".join(f"w{i}" for i in range(12))), (6, " ".join(f"w{i}" for i in range(10)))]  # 6 of 8
    got = {r[0]: r[2] for r in J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5}
    rows = [(5, " ".join(f"w{i}" for i in range(12))), (6, " ".join(f"w{i}" for i in range(9)))]  # 5 of 8
    assert {r[2] for r in J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {5, 6}


def test_large_family_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ENTRIES", 60)
    words = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(30):
        w = list(words)
        w[39] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows.append((99, " ".join(f"q{i}" for i in range(40))))
    got = {r[0]: r[2] for r in J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(30)} | {99: 99}


def test_forest_matches_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.choice(400, 60, replace=False)
    rows = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 400, 60), base)) for _ in range(80)] + [rng.choice(400, 50, replace=False) for _ in range(40)]
    n = np.array([len(r) for r in rows])
    forest = J.link_forest(np.arange(len(rows), dtype=np.uint64), n, n, np.concatenate(rows).astype(np.uint64), 75)
    label = list(range(len(rows)))

    def merge(a, b):
        x, y = label[a], label[b]
        label[:] = [min(x, y) if v in (x, y) else v for v in label]

    for a, b in forest:
        merge(a, b)
    got, label = list(label), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(np.intersect1d(rows[i], rows[j]))
            if 100 * o >= 75 * (n[i] + n[j] - o):
                merge(i, j)
    assert got == label


def test_prefix_columns_find_the_same_links():
    rng = np.random.default_rng(8)
    common = rng.integers(0, 2**40, 30).astype(np.uint64)  # a passage that every row has
    base = [np.unique(rng.integers(0, 2**40, 200).astype(np.uint64)) for _ in range(12)]
    rows = [np.unique(np.concatenate((common, b[: len(b) - k * 7], rng.integers(0, 2**40, k * 4).astype(np.uint64)))) for b in base for k in range(5)]
    flat = np.concatenate(rows)
    value, df = np.unique(flat, return_counts=True)
    order = [r[np.lexsort((r, df[np.searchsorted(value, r)]))] for r in rows]
    n = np.array([len(r) for r in rows])
    lead = n - (75 * n + 99) // 100 + 1
    fps = np.arange(len(rows)).astype(np.uint64)

    def groups(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    every = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(np.intersect1d(rows[i], rows[j])) >= 75 * len(np.union1d(rows[i], rows[j]))]
    assert every and groups(J.link_forest(fps, n, n, np.concatenate(order), 75, lead)) == groups(every) == groups(J.link_forest(fps, n, n, np.concatenate(order), 75))
