import hashlib
from collections import Counter

import numpy as np

from contamgraph.llm.substring_dedup import anchors_of, refine, repeated_spans
from contamgraph.llm import blocks as B


def brute(rows, length):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, length, q):
    got = repeated_spans(df, length=length, q=q).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_equals_brute_force(docs, prose):
    check(docs, prose, 400, 100)


def test_shorter_strings(docs, prose):
    check(docs, prose, 64, 32)


def test_passages_and_periods(spark):
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    rows = [(1, "start " + p + " end"), (2, p[:420]), (3, "é" * 5 + p[30:]), (4, "a" * 1000), (5, "xyz" * 300), (6, p[:399]), (7, None), (7, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 400, 100)


def test_empty_table(no_docs):
    assert repeated_spans(no_docs).count() == 0


def test_spans_are_ranges(spark):
    p = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(500))
    df = spark.createDataFrame([(1, "AAAA" + p), (2, p + "BBBB")], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeated_spans(df).collect()}
    assert spans == {1: [(4, 504)], 2: [(0, 500)]}


def test_refinement_finds_equal_windows():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[300:420] = text[20:140]
    n, q, length = len(text), 8, 50
    prefix = B.rolling(text)
    at = np.arange(n)
    h0 = B.range_hash(prefix, at, np.minimum(at + q, n))
    hit = refine(h0, np.zeros(n, np.int64), np.array([0, n]), at + length <= n, q, length)
    raw = text.tobytes()
    seen = Counter(raw[i : i + length] for i in range(n - length + 1))
    assert hit.tolist() == [i + length <= n and seen[raw[i : i + length]] > 1 for i in range(n)]


def test_each_window_has_one_anchor():
    raw = np.frombuffer(("the quick brown fox " * 40 + "a" * 300).encode(), np.uint8)
    offs = np.array([0, 500, len(raw)])
    d, a, h, lo, hi = anchors_of(raw, offs, 100, 32)
    assert (hi - lo + 1).sum() == sum(max(0, n - 100 + 1) for n in np.diff(offs))
    assert ((a >= lo) & (a <= hi + 100 - 32)).all()


def passages(rows, words=51, least=240, length=400):
    """Brute force: bytes under repeated 400-byte strings or repeated runs of 51 whole words."""
    import re

    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    windows = []
    for _, b in raw:
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        windows.append([(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)])
    told = Counter(b[s:e] for (_, b), own in zip(raw, windows, strict=True) for s, e in own)
    out = []
    for (i, b), own in zip(raw, windows, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        for s, e in own:
            if least <= e - s < length and told[b[s:e]] > 1:
                gone[s:e] = True
        out.append((i, int(gone.sum())))
    return sorted(out, key=str)


def passage_rows():
    import random

    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 52, 60, 66, 90)]
    rows = [(i, say(rng.randint(0, 40)) + " " + p + "\n" + say(rng.randint(0, 40))) for i, p in enumerate(shared * 3)]
    rows += [(100, shared[3]), (101, shared[3]), (102, "x" + shared[4] + "y"), (103, say(300)), (104, None), (105, "ab " * 300), (106, say(55)), (107, "")]
    return rows


def test_passages_of_words(spark):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_spans(df).select("doc_id", "n_passage").collect()
    want = passages(rows)
    assert any(n for _, n in want) and sorted(map(tuple, got), key=str) == want
    check(df, rows, 400, 120)


def test_hot_anchors_are_split(spark, monkeypatch):
    from contamgraph.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_PLACES", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(i, "the " * 100 + t) for i, t in enumerate(["left of it"] * 2 + ["right"])] + passage_rows()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        check(df, rows, 400, 120)
        assert sorted(map(tuple, repeated_spans(df).select("doc_id", "n_passage").collect()), key=str) == passages(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_text_longer_than_a_block(spark):
    import random

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(B.BLOCK_BYTES + 5000))
    rows = [(1, long), (2, "start " + long[-3000:-1000]), (3, long[7:900] + "end")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 400, 120)


def test_leftmost_minimum_of_any_length():
    from contamgraph.llm.substring_dedup import _leftmost_minimum_long

    key = np.random.default_rng(2).integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    assert _leftmost_minimum_long(key, 37).tolist() == [i + int(np.argmin(key[i : i + 37])) for i in range(500 - 36)]
