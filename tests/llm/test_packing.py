import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contamgraph.llm import packing as P
from contamgraph.llm.packing import WordTable, best_plan, default_vocabulary, make_plan, pack


def occupied(plan, capacity):
    """Every place as (sequence, offset, length); checks ranks and overlaps."""
    places, rank = [], {}
    for length, first, count, seq, offset in zip(plan.length, plan.first, plan.count, plan.sequence, plan.offset, strict=True):
        assert first == rank.get(length, 0)
        rank[length] = first + count
        places += [(seq + i, offset, length) for i in range(count)]
    end = {}
    for s, o, n in sorted(places):
        assert o == end.get(s, 0)
        end[s] = o + n
    assert not end or max(end.values()) <= capacity
    assert sorted(end) == list(range(plan.n_sequences))
    return rank


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([2, 8, 48]), st.sampled_from([0.05, 0.25, 0.5]))
def test_plans_place_every_piece(lengths, groups, small):
    counts = np.bincount(lengths, minlength=65)
    rank = occupied(make_plan(counts, 64, groups, small), 64)
    assert rank == {x: c for x, c in enumerate(counts.tolist()) if c}


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(5, 1, 200_000).astype(int), 1, 2048), minlength=2049)
    plan = best_plan(counts, 2048)
    assert plan.n_sequences <= 1.002 * -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert len(plan.length) < 60_000


TEXTS = ["", "Foo's it's, don't. I'LL", "É. éa, ﬁ, Á, b c, d. ", "x,\x1cy. 12. 3a, $5.,", "ΑΣ, ΣΑΣ. İstanbul, ", "a.\n", "a..", "ſs, K. K,", "á. b", ".", ", .", "a,", "THE the The", "🙂. x🙂,"]


@pytest.mark.parametrize("kept", [0, 5, 1_000])
def test_words_encode_as_the_whole_text(monkeypatch, kept):
    monkeypatch.setattr(P, "CACHE_WORDS", kept)
    monkeypatch.setattr(P, "RECENT_WORDS", 3)
    t = WordTable(default_vocabulary())
    raw = [x.encode() for x in TEXTS]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for _ in range(3):
        ids, lens = t.encode(buf, offs, 0)
        got = [x[:-1].tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
        assert got == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in TEXTS]
        assert (ids[np.cumsum(lens) - 1] == 0).all()
        assert sum(len(x[0]) for x in t.levels) <= kept


def test_round_trip(docs, prose):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    cap = 64
    odd = [(900, "<|endoftext|> x <|ENDOFTEXT|>."), (901, "plain"), (902, "a <|startoftext|>b")]
    prose = [*prose, *odd]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    rows = pack(docs.withColumn("piece", F.lit("x")).withColumn("offset", F.lit(1)), capacity=cap).collect()
    want = []
    for i, text, *_ in prose:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // cap, k, len(ids[k : k + cap]), zlib.crc32(ids[k : k + cap].tobytes())) for k in range(0, len(ids), cap)]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= cap
    assert len(end) <= 1.1 * -(-sum(r["length"] for r in rows) // cap) + 1


def test_empty_table(no_docs):
    assert pack(no_docs).count() == 0


def test_other_vocabularies_encode_whole_texts(tmp_path):
    import json

    from contamgraph.llm.packing import WordTable, default_vocabulary, splits_at_words

    spec = json.load(open(default_vocabulary()))
    assert splits_at_words(default_vocabulary())
    spec["normalizer"]["normalizers"] = [x for x in spec["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    assert not splits_at_words(path)
    table, raw = WordTable(path), ["The Cat, sat. 12", "", "Été été"]
    data = [x.encode() for x in raw]
    ids, lens = table.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 0)
    assert lens.tolist() == [len(table.tokenizer.encode(x, add_special_tokens=False).ids) + 1 for x in raw]
    assert ids.tolist() == [i for x in raw for i in [*table.tokenizer.encode(x, add_special_tokens=False).ids, 0]]
