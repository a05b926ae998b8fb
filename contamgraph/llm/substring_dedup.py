"""Removal of repeated byte strings by bucket-pointer refinement.

A full suffix array of the corpus would sort every byte position.  Only positions
that can start a repeated string are sorted here:

1. *Anchors.*  In each ``least``-byte window the gram with the smallest hash (the
   leftmost, on ties) is the window's anchor.  Equal windows have equal anchors at
   equal offsets, so only windows whose anchor gram occurs at another place can
   repeat.  A text has about ``2 / least`` anchors a byte, and each window start
   belongs to exactly one anchor.
2. *Bucket-pointer refinement.*  Segments around repeated anchors are gathered by
   anchor.  Their positions start in buckets of equal q-grams; a round sorts the
   positions of each bucket by the bucket identifiers found h bytes later, which
   doubles the depth, and the new identifiers are the pointers of the next round.
   Positions alone in their bucket leave the sort.  At depth ``length``, a bucket
   with two positions or more is a repeated string.  Strings of ``words`` whole
   words between ``least`` and ``length`` bytes are told apart by two pointers of
   depth ``least``: that of their start and that of their last ``least`` bytes.
3. *Removal.*  Runs of repeated ``length``-byte windows go back to their text, are
   merged, and the rest is hashed.  Repeated passages of ``words`` words are
   reported, not removed (those under ``least`` bytes are not looked for).

Equal texts are one text from the first pass on (each of ``length`` bytes or more
is removed whole, as the other copy repeats it); equal segments of a task travel
once, with the list of their places.  An anchor with more than its share of all
places (at most ``8 * partitions`` of them can be) is met without a shuffle, and its
segments are split in two by what stands left and right of the gram: a window
starts before or after a fixed point, and so contains one of the two contexts whole.

q-gram and bucket identifiers are 64 bits wide.  Null text is empty; short texts
keep all bytes; ids are integers, may repeat or be null, rows are matched by text.
An empty table gives an empty result, columns beside id and text are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.plans.lineage import cut, cut_bucketed

U64 = np.uint64
GRAM = 32
#: Segment bytes that one refinement holds, unless one anchor has more.
REFINE_BYTES = 2 << 20
_POS_BITS = U64(26)
#: Places up to which an anchor is never taken for a hot one.
HOT_PLACES = 10_000


def anchors_of(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all ``length``-byte windows inside documents.

    Returns (document, anchor position, anchor hash, first window start, last
    window start), in order of position; positions are those of the block.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(U64), none, none
    prefix = B.rolling(buf)
    start = np.arange(n - gram + 1)
    full = B.range_hash(prefix, start, start + gram)
    if n >= 1 << int(_POS_BITS):  # a single very long document: rank ties by position with two keys
        window = _leftmost_minimum_long(full, length - gram + 1)
    else:
        key = (full & ~((U64(1) << _POS_BITS) - U64(1))) | start.astype(U64)
        width, step, low = length - gram + 1, 1, key
        while step * 2 <= width:
            low = np.minimum(low[: len(low) - step], low[step:])
            step *= 2
        rest = width - step
        if rest:
            low = np.minimum(low[: len(low) - rest], low[rest:])
        window = (low & ((U64(1) << _POS_BITS) - U64(1))).astype(np.int64)
    doc = np.searchsorted(offs, np.arange(len(window)), "right") - 1
    inside = np.arange(len(window)) + length <= offs[doc + 1]
    p = np.flatnonzero(inside)
    if not len(p):
        return none, none, none.astype(U64), none, none
    a, d = window[p], doc[p]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return d[at], a[at], full[a[at]], p[at], p[last]


def _leftmost_minimum_long(full: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window, for any length of text."""
    key = full & ~((U64(1) << _POS_BITS) - U64(1))
    low, at, step = key, np.arange(len(key)), 1

    def merge(low, at, by):
        left = low[: len(low) - by] <= low[by:]
        return np.where(left, low[: len(low) - by], low[by:]), np.where(left, at[: len(at) - by], at[by:])

    while step * 2 <= width:
        low, at = merge(low, at, step)
        step *= 2
    if width - step:
        low, at = merge(low, at, width - step)
    return at


def refine(h0: np.ndarray, segment: np.ndarray, offset: np.ndarray, wanted: np.ndarray, q: int, length: int) -> np.ndarray:
    """Which of the wanted positions start a string that another one starts too.

    ``h0`` identifies the q-gram bucket of every position; ``segment`` ends bound
    how far a position may look.  Each round sorts by (bucket, bucket h later).
    """
    n = len(h0)
    bucket, depth = h0, q
    live = np.ones(n, bool)
    while depth < length:
        step = min(depth, length - depth)
        goal = depth + step
        can = np.flatnonzero(live & (offset[segment + 1] - np.arange(n) >= goal))
        if goal >= length:
            can = can[wanted[can]]
        bucket, many = _deepen(bucket, can, step)
        live = np.zeros(n, bool)
        live[can] = many if goal >= length else True
        depth = goal
    return live & wanted


def _deepen(bucket: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: pointers of the given positions, and which of them share theirs."""
    first, later = bucket[at], bucket[at + step]
    order = np.lexsort((later, first))
    a, b = first[order], later[order]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    out = np.full(len(bucket), U64(2**64 - 1))
    out[at[order]] = np.repeat(head, size).astype(U64)
    many = np.zeros(len(at), bool)
    many[order] = np.repeat(size > 1, size)
    return out, many


def _covered(start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Bytes of each document under its intervals (both ends rise within a document)."""
    from_ = start.copy()
    if len(start):
        same = doc[1:] == doc[:-1]
        from_[1:] = np.where(same, np.maximum(start[1:], end[:-1]), start[1:])
    return np.bincount(doc, weights=end - from_, minlength=n_docs).astype(np.int64)


#: Rows of texts that are Python objects at a time.
_ROWS = 256
_TEXT = pa.schema([("key", pa.binary()), ("text", pa.string())])


def _fingerprints(least: int, length: int, gram: int, words: int):
    schema = pa.schema([
        ("id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("n_words", pa.int64()),
        ("anchors", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
    ])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text"))
            for at, end, buf, offs in B.blocks(text):
                m = end - at
                raw = buf.tobytes()
                digest = [hashlib.sha256(raw[offs[i] : offs[i + 1]]) for i in range(m)]
                keys = [x.digest()[:16] for x in digest]
                d, a, h, _, _ = anchors_of(buf, offs, least, gram)
                size = np.diff(offs)
                passage = np.zeros(m, np.int64)
                if ((size >= least) & (size < length)).any():
                    s, e, of = B.word_windows(buf, offs, np.ones(m, bool), words)
                    wide = e - s >= least
                    passage = _covered(s[wide], e[wide], of[wide], m)
                fresh = np.zeros(m, bool)
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                keep = fresh[d]
                d, a, h = d[keep], a[keep], h[keep]
                count = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=m)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, m), pa.array(keys, pa.binary()), pa.array(size),
                        pa.array([x.hexdigest() for x in digest]), pa.array(passage),
                        pa.ListArray.from_arrays(pa.array(count), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(count), pa.array((a - offs[d]).astype(np.int32))),
                    ],
                    schema=schema,
                )

    return run, "id long, key binary, n_bytes long, sha string, n_words long, anchors array<long>, places array<int>"


def _distinct_texts(least: int):
    """Texts long enough to repeat, once for each task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            text = batch.column(0)
            keep, keys = [], []
            for i, value in enumerate(text.to_pylist()):
                raw = (value or "").encode()
                if len(raw) >= least:
                    key = hashlib.sha256(raw).digest()[:16]
                    if key not in seen:
                        seen.add(key)
                        keep.append(i)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), text.take(pa.array(keep, pa.int64())).cast(pa.string())], schema=_TEXT)

    return run


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("span", pa.int32()), ("edge", pa.bool_()), ("keys", pa.binary()), ("starts", pa.binary())])
_SEGMENTS_DDL = "anchor long, segment binary, span int, edge boolean, keys binary, starts binary"


def _around(raw: bytes, h: int, a: int, lo: int, hi: int, half: int, gram: int):
    """The two parts of a hot anchor's window starts, each under its anchor and context."""
    mid = a - half  # windows that start up to here hold [mid, a + gram), later ones [a, mid + least]
    for side, first, last, context in ((b"L", lo, min(hi, mid), (mid, a + gram)), (b"R", max(lo, mid + 1), hi, (a, a + gram + half + 1))):
        if first <= last:
            name = hashlib.blake2b(raw[context[0] : context[1]] + h.to_bytes(8, "little") + side, digest_size=8).digest()
            yield int.from_bytes(name, "little"), first, last


def _segments(least: int, length: int, gram: int):
    """Bytes around repeated anchors; equal segments of a batch are one row."""
    half = (least - gram) // 2

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            keys, places, hots = (get(c).to_pylist() for c in ("key", "places", "hots"))
            for at, end, buf, offs in B.blocks(get("text")):
                d, a, h, lo, hi = anchors_of(buf, offs, least, gram)
                raw = buf.tobytes()
                rel = a - offs[d]
                span = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=end - at))))
                found: dict[tuple[int, bytes, int, bool], tuple[list, list]] = {}
                for i in range(end - at):
                    s, e = span[i], span[i + 1]
                    hit = np.flatnonzero(np.isin(rel[s:e], np.asarray(places[at + i], np.int64))) + s
                    hot, zero, stop = set(hots[at + i]), int(offs[i]), int(offs[i + 1])
                    for j in hit.tolist():
                        name, p, first, last = int(h[j]), int(a[j]), int(lo[j]), int(hi[j])
                        parts = _around(raw, name, p, first, last, half, gram) if p - zero in hot else ((name, first, last),)
                        for anchor, x, y in parts:
                            edge = x == zero or bool(B.IS_SPACE[raw[x - 1]])
                            who = found.setdefault((anchor, raw[x : min(y + length, stop)], y - x + 1, edge), ([], []))
                            who[0].append(keys[at + i])
                            who[1].append(x - zero)
                out = {
                    "anchor": np.array([k[0] for k in found], U64).view(np.int64),
                    "segment": [k[1] for k in found], "span": [k[2] for k in found], "edge": [k[3] for k in found],
                    "keys": [b"".join(v[0]) for v in found.values()],
                    "starts": [np.array(v[1], np.int64).tobytes() for v in found.values()],
                }
                yield B.table(out, _SEGMENTS)

    return run


#: Kinds of runs: of ``length``-byte windows, and of passages of whole words.
BYTES, WORDS = 0, 1


def _repeated_runs(least: int, length: int, q: int, words: int):
    """Rows sorted by anchor: runs of bytes covered by repeated windows."""
    schema = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def solve(held):
        t = pa.Table.from_batches(held)
        merged: dict[tuple, set] = {}
        for *name, keys, starts in zip(*(t.column(c).to_pylist() for c in _SEGMENTS.names), strict=True):
            who = merged.setdefault(tuple(name), set())
            who.update(zip((keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(starts, np.int64).tolist(), strict=True))
        segs = [k[1] for k in merged]
        buf = np.frombuffer(b"".join(segs), np.uint8)
        lens = np.array([len(s) for s in segs], np.int64)
        offset = np.concatenate(([0], np.cumsum(lens)))
        n = len(buf)
        seg = np.repeat(np.arange(len(segs), dtype=np.int32), lens)
        at = np.arange(n)
        room = offset[seg + 1] - at
        # windows are told apart by anchor: the same string always has the same one
        own = at - offset[seg] < np.array([k[2] for k in merged])[seg]
        many = np.array([len(v) > 1 for v in merged.values()])
        bucket, depth = B.range_hash(B.rolling(buf), at, np.minimum(at + q, n)), q
        while True:
            step = min(depth, least - depth)
            can = np.flatnonzero(room >= depth + step)
            bucket, shared = _deepen(bucket, can, step)
            depth += step
            if depth == least:
                break
        live = np.zeros(n, bool)
        live[can] = shared
        live = (live | many[seg]) & own
        short = bucket
        while depth < length:
            step = min(depth, length - depth)
            can = np.flatnonzero(live & (room >= length) if depth + step == length else room >= depth + step)
            bucket, shared = _deepen(bucket, can, step)
            depth += step
        hit = np.zeros(n, bool)
        if least < length:
            hit[can] = shared
            hit |= live & (room >= length) & many[seg]
        else:
            hit = live
        out = {f.name: [] for f in schema}
        places = [list(v) for v in merged.values()]

        def emit(kind, first, last):
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                s = int(seg[a])
                for key, start in places[s]:
                    for name, x in zip(schema.names, (key, kind, start + a - int(offset[s]), start + b - int(offset[s])), strict=True):
                        out[name].append(x)

        p = np.flatnonzero(hit)
        if len(p):
            new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (seg[p[1:]] != seg[p[:-1]])))
            head = np.flatnonzero(new)
            emit(BYTES, p[head], p[np.append(head[1:], len(p)) - 1] + length)
        if least < length:
            a, b, of = B.word_windows(buf, offset, np.array([k[3] for k in merged], bool), words)
            keep = live[a] & (b - a >= least) & (b - a < length)
            a, b, of = a[keep], b[keep], of[keep]
            first, last, size = short[a], short[b - least], b - a
            order = np.lexsort((last, first, size))
            x, y, z = first[order], last[order], size[order]
            same = np.zeros(len(a), bool)
            same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (z[1:] == z[:-1])
            twice = same.copy()
            twice[:-1] |= same[1:]
            repeated = many[of]
            repeated[order] |= twice
            a, b, of = a[repeated], b[repeated], of[repeated]
            if len(a):
                head = np.flatnonzero(np.concatenate(([True], (a[1:] > b[:-1]) | (of[1:] != of[:-1]))))
                emit(WORDS, a[head], b[np.append(head[1:], len(a)) - 1])
        return B.table(out, schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                anchors = batch.column("anchor").to_numpy()
                last = held[-1].column("anchor")[-1].as_py() if held else None
                edge = int(np.searchsorted(anchors, last, "right")) if last is not None else 0
                if size >= REFINE_BYTES and edge < batch.num_rows:
                    if edge:
                        held.append(batch.slice(0, edge))
                    yield solve(held)
                    held, size, batch = [], 0, batch.slice(edge)
                    continue
                take = batch.num_rows
                lens = np.diff(np.frombuffer(batch.column("segment").buffers()[1], np.int32)[batch.column("segment").offset :][: take + 1])
                fits = int(np.searchsorted(np.cumsum(lens), max(REFINE_BYTES - size, 1))) + 1
                if fits < take:
                    take = int(np.searchsorted(anchors, anchors[fits - 1], "right"))
                held.append(batch.slice(0, take))
                size += int(lens[:take].sum())
                batch = batch.slice(take)
        if held:
            yield solve(held)

    return run


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for s, e in sorted(runs):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return spans


_SPANS = "array<struct<start:bigint,end:bigint>>"
_CUT_DDL = f"key binary, n_removed long, n_spans long, n_passage long, kept_sha256 string, spans {_SPANS}"


def _cut_out(batches):
    schema = pa.schema([
        ("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_passage", pa.int64()),
        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])
    for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
        out = {f.name: [] for f in schema}
        for key, text, runs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "text", "runs")), strict=True):
            raw = text.encode()
            spans = _merged([(r["start"], r["end"]) for r in runs if r["kind"] == BYTES])
            every = _merged([(r["start"], r["end"]) for r in runs])
            sha, at = hashlib.sha256(), 0
            for s, e in spans:
                sha.update(raw[at:s])
                at = e
            sha.update(raw[at:])
            out["key"].append(key)
            out["n_removed"].append(sum(e - s for s, e in spans))
            out["n_spans"].append(len(spans))
            out["n_passage"].append(sum(e - s for s, e in every))
            out["kept_sha256"].append(sha.hexdigest())
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
        yield B.table(out, schema)


def _repeated_places(marks: DataFrame, parts: int) -> DataFrame:
    """(key, places, hots): places of each text whose anchor occurs at another place, too."""
    place = marks.select("key", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select(
        "key", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place")
    )
    which = F.xxhash64("key", "place")
    often = cut(place.groupBy("anchor").agg(F.min(which).alias("a"), F.max(which).alias("b"), F.count("*").alias("c")).where("a <> b").select("anchor", "c"))
    share = max(HOT_PLACES, int(often.agg(F.sum("c")).first()[0] or 0) // (8 * parts))
    hot = often.where(F.col("c") > share).select("anchor")  # at most 8 * parts rows, as each has more than one share
    met = (
        place.join(F.broadcast(hot), "anchor", "left_anti").join(often.where(F.col("c") <= share), "anchor", "left_semi")
        .select("key", "place", F.lit(None).cast("int").alias("hot"))
        .unionByName(place.join(F.broadcast(hot), "anchor", "left_semi").select("key", "place", F.col("place").alias("hot")))
    )
    return met.groupBy("key").agg(F.collect_set("place").alias("places"), F.collect_set("hot").alias("hots"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, q: int = 120, words: int = 51, least: int = 240,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, n_passage,
    kept_sha256 and ``spans`` (array of byte ranges to remove, end exclusive).

    ``n_passage`` counts bytes under repeated ``length``-byte strings and under repeated
    strings of ``words`` whole words (from ``least`` bytes on).
    """
    if not GRAM <= q <= length:
        raise ValueError(f"q must lie between {GRAM} and length")
    least = min(max(least, q), length)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    run, schema = _fingerprints(least, length, GRAM, words)
    marks = cut(plain.mapInArrow(run, schema))
    texts = plain.select("text").mapInArrow(_distinct_texts(least), "key binary, text string")
    cand = cut_bucketed(texts.join(_repeated_places(marks, parts), "key"), "key")
    segments = cand.mapInArrow(_segments(least, length, GRAM), _SEGMENTS_DDL)
    runs = (
        segments.repartition(parts, "anchor").sortWithinPartitions("anchor")
        .mapInArrow(_repeated_runs(least, length, q, words), "key binary, kind int, start long, end long")
        .groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("runs"))
    )
    removed = (
        cand.join(runs, "key").select("key", "text", "runs").mapInArrow(_cut_out, _CUT_DDL)
        .groupBy("key").agg(*(F.min(c).alias(c) for c in ("n_removed", "n_spans", "n_passage", "kept_sha256", "spans")))
    )
    copies = marks.groupBy("key").agg(F.count("*").alias("copies"))
    found = copies.join(removed, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda all_, some, none: F.when(whole, all_).otherwise(F.coalesce(some, none))
    passage = F.when(F.col("copies") > 1, F.col("n_words")).otherwise(F.coalesce("n_passage", F.lit(0)))
    return marks.select("id", "key", "n_bytes", "sha", "n_words").join(found, "key").select(
        F.col("id").alias(id_col), "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.col("n_bytes")).otherwise(passage).cast("long").alias("n_passage"),
        pick(F.lit(hashlib.sha256().hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        pick(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))), F.col("spans"), F.array().cast(_SPANS)).alias("spans"),
    )
