"""Best-fit packing by the linear grouping scheme.

Documents become token pieces of at most ``capacity`` tokens.  How pieces can be
packed depends only on how many there are of each length, so the plan is made from
the length histogram (``capacity`` numbers, whatever the corpus):

1. *Grouping.*  Large lengths, in falling order, are cut into ``groups`` groups of
   equal cardinality and rounded up to the longest of their group.
2. *Configurations.*  Over these few sizes, the longest size left is combined with
   the sizes that fill the capacity best (an exact subset-sum over what is left),
   as often as the counts allow.
3. *Substitution.*  The places of a group take its actual pieces, longest first;
   what they are shorter than their group's size stays free.
4. *Best fit.*  Small pieces, longest first, go where the least room is left that
   holds them; new sequences open only when nothing fits.

Everything is planned in runs (equal sequences in a row), so the plan's size
depends on the capacity and the number of groups and not on the number of pieces.
The pieces then take the places of their length by rank.  Ranks are numbered in
salted shares of each length, so a length that many pieces have is no hot key.

Null text is the empty document (its closing token alone).  Ids are integers, may repeat or be
null: each row is packed by itself.  Other columns are ignored, an empty table
gives an empty result.
"""
from __future__ import annotations

import functools
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.plans.lineage import cut

#: Distinct words whose token ids a Python worker keeps (about 30 bytes each).
CACHE_WORDS = 1_500_000
#: New words that are kept apart before they are merged with the others.
RECENT_WORDS = 65_536
#: Pieces of one length that one rank share holds, about.
SHARE_ROWS = 100_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the parts of a block that tokenise by themselves.

    These are words; a point or comma between an ASCII letter and white space (or
    the end) is a part of its own.
    """
    n = len(buf)
    inside = ~B.IS_SPACE[buf]
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[offs[:-1]] = ends[offs[1:]] = True
    after = np.ones(n, bool)  # white space or the document's end comes next
    after[:-1] = ~inside[1:]
    after |= ends[1:]
    stop = _STOP[buf] & after
    stop[1:] &= _LETTER[buf[:-1]]
    stop[:1] = False
    stop &= ~begins[:n]
    first = begins[:n] | stop
    first[1:] |= ~inside[:-1]
    last = after
    last[:-1] |= stop[1:]
    start = np.flatnonzero(first & inside)
    return start, np.flatnonzero(last & inside) + 1, np.searchsorted(offs, start, "right") - 1


#: Fixed value: the pre-tokenizer pattern under which words can be encoded by themselves.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_words(path: str) -> bool:
    """Whether a vocabulary file folds case, and pre-tokenises by the pattern and nothing else.

    Then no token reaches over white space, and letters stand apart from points and commas.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x, name: (x or {}).get(name) or ([x] if x else [])
    normal = [(x["type"], x.get("pattern", {}).get("Regex")) for x in parts(spec.get("normalizer"), "normalizers")]
    before = parts(spec.get("pre_tokenizer"), "pretokenizers")
    split = [x for x in before if x["type"] == "Split"]
    return (
        ("Lowercase", None) in normal and all(x in (("NFC", None), ("Lowercase", None), ("Replace", r"\s+")) for x in normal)
        and [x["type"] for x in before] == ["Split", "ByteLevel"] and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
        and split[0]["pattern"] == {"Regex": _PATTERN} and split[0]["behavior"] == "Removed" and split[0]["invert"] and spec["model"]["type"] == "BPE"
    )


class WordTable:
    """Token ids of words by 64-bit hash, in flat arrays.

    A vocabulary that does not split at words (``splits_at_words``) encodes whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_words(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a run of letters
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        none = np.zeros(0, np.uint64)
        self.levels = [(none, np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2  # all, recent: sorted hash, place, size
        self.tokens = np.zeros(1 << 16, "<u4")
        self.used = 0

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _append(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words at the end of the table: (place, size) of each."""
        size = np.zeros(len(words), np.int64)
        plain = np.array([w.isalpha() for w in words], bool)  # one run of ASCII letters
        ids = np.zeros(0, "<u4")
        if plain.any():  # encoded as one text; the marks tell where words end
            ids = np.array(self._batch([b" ".join(w for w, p in zip(words, plain, strict=True) if p).decode()])[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == plain.sum():
                size[plain] = np.diff(ends, prepend=0)
            else:  # a vocabulary without such marks
                plain[:] = False
                ids = ids[:0]
        rest = [e.ids for e in self._batch([w.decode() for w, p in zip(words, plain, strict=True) if not p])]
        size[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        place = np.zeros(len(words), np.int64)
        for own, base in ((plain, self.used), (~plain, self.used + len(ids))):
            place[own] = base + np.cumsum(size[own]) - size[own]
        new = np.concatenate((ids, np.fromiter((x for row in rest for x in row), "<u4", int(size[~plain].sum()))))
        while self.used + len(new) > len(self.tokens):
            self.tokens = np.concatenate((self.tokens, np.zeros(len(self.tokens), "<u4")))
        self.tokens[self.used : self.used + len(new)] = new
        self.used += len(new)
        return place, size

    def _register(self, h: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        merge = lambda a, b: tuple(np.concatenate(x)[o] for o in [np.argsort(np.concatenate((a[0], b[0])), kind="stable")] for x in zip(a, b, strict=True))
        self.levels[1] = merge(self.levels[1], (h, place, size.astype(np.int32)))
        if len(self.levels[1][0]) > RECENT_WORDS:
            self.levels = [merge(*self.levels), tuple(x[:0] for x in self.levels[1])]

    def encode(self, buf: np.ndarray, offs: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a block, each closed, one after the other; ids of each)."""
        m = len(offs) - 1
        if not self.by_word:
            raw = buf.tobytes()
            whole = [self.encode_text(raw[a:b].decode(), closing) for a, b in zip(offs, offs[1:], strict=False)]
            return np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        start, end, doc = chunks(buf, offs)
        h = B.range_hash(B.rolling(buf, lower=True), start, end)
        value, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place, size, known = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        for hashes, places, sizes in self.levels:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                hit = hashes[at] == value
                place[hit], size[hit] = places[at[hit]], sizes[at[hit]]
                known |= hit
        new = np.flatnonzero(~known)
        mark = self.used
        if len(new):
            raw = buf.tobytes()
            place[new], size[new] = self._append([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            if len(self.levels[0][0]) + len(self.levels[1][0]) + len(new) <= CACHE_WORDS:
                self._register(value[new], place[new], size[new])
                mark = self.used
        count = size[inverse]
        lens = np.bincount(doc, weights=count, minlength=m).astype(np.int64) + 1
        out = np.full(int(lens.sum()), closing, "<u4")
        ends = np.cumsum(lens)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = self.tokens[B.ranges(place[inverse], count)]
        self.used = mark
        return out, lens

    def encode_text(self, text: str, closing: int) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, closing], "<u4")


@functools.cache
def _encoder(path: str) -> WordTable:
    return WordTable(path)


_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(path: str, capacity: int, closing: int):
    def run(batches):
        table = _encoder(path)
        for batch in batches:
            ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text"))
            for at, end, buf, offs in B.blocks(text):
                tokens, lens = table.encode(buf, offs, closing)
                stop = np.cumsum(lens)
                raw = buf.tobytes()
                special = b"<|" in raw  # may hold special tokens, which are told apart by case
                out = {f.name: [] for f in _PIECES}
                for i, number in enumerate(ids.slice(at, end - at).to_pylist()):
                    own = tokens[stop[i] - lens[i] : stop[i]]
                    if special and b"<|" in raw[offs[i] : offs[i + 1]]:
                        own = table.encode_text(text[at + i].as_py(), closing)
                    own = own.tobytes()
                    for k, p in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[p : p + 4 * capacity]
                        out["id"].append(number)
                        out["piece"].append(k)
                        out["start"].append(p // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PIECES], schema=_PIECES)

    return run


@dataclass
class Plan:
    """Runs of places: pieces of ``length`` with rank in [first, first + count) go to
    sequences ``sequence + rank - first`` at ``offset``; sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def _best_fill(sizes: list[int], left: np.ndarray, room: int) -> list[int]:
    """How many of each size (at most what is left) fill the room best."""
    best = np.full(room + 1, -1, np.int64)  # index of the last size used to reach a sum
    used = np.zeros(room + 1, np.int64)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for i, (s, n) in enumerate(zip(sizes, left.tolist(), strict=True)):
        n = min(n, room // s)
        if not n:
            continue
        # copies of size i on top of each sum reached without it, as far as n allows
        copies = np.where(reach, 0, -1)
        for t in range(s, room + 1):
            if copies[t] < 0 and 0 <= copies[t - s] < n:
                copies[t] = copies[t - s] + 1
        new = copies > 0
        best[new], used[new] = i, copies[new]
        reach |= new
        if reach[room]:
            break
    take = [0] * len(sizes)
    t = int(np.flatnonzero(reach)[-1])
    while t:
        i, k = int(best[t]), int(used[t])
        take[i] += k
        t -= k * sizes[i]
    return take


def make_plan(counts: np.ndarray, capacity: int, groups: int = 48, small: float = 1 / 8) -> Plan:
    """The packing of ``counts[l]`` pieces of each length l."""
    out: list[tuple[int, int, int, int, int]] = []
    rank = np.zeros(capacity + 1, np.int64)
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room: (first sequence, how many)
    n_seq = 0

    def place(length: int, n: int, seq: int, offset: int) -> None:
        out.append((length, int(rank[length]), n, seq, offset))
        rank[length] += n

    full = int(counts[capacity])
    if full:
        place(capacity, full, 0, 0)
        n_seq = full
    limit = int(capacity * small)
    large = [(x, int(counts[x])) for x in range(capacity - 1, limit, -1) if counts[x]]
    total = sum(n for _, n in large)
    # groups of equal cardinality, each a queue of (length, how many) in falling order
    queue: list[list[list[int]]] = []
    sizes: list[int] = []
    if total:
        share, seen = -(-total // groups), 0
        for x, n in large:
            while n:
                if seen % share == 0 or not queue:
                    queue.append([])
                    sizes.append(x)
                k = min(n, share - seen % share)
                queue[-1].append([x, k])
                seen, n = seen + k, n - k
    left = np.array([sum(n for _, n in q) for q in queue], np.int64)
    while left.sum():
        i = int(np.flatnonzero(left)[0])
        rest = left.copy()
        rest[i] -= 1
        take = _best_fill(sizes, rest, capacity - sizes[i])
        take[i] += 1
        use = np.array(take)
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        at = 0
        slots = [j for j, k in enumerate(take) for _ in range(k)]
        while at < times:  # split where the actual length of a place changes
            need = dict.fromkeys(slots, 0)
            for j in slots:
                need[j] += 1
            n = times - at
            plan = []
            for j in need:  # places of one group take consecutive shares of its queue
                n = min(n, max(1, queue[j][0][1] // need[j])) if queue[j][0][1] >= need[j] else 1
            used = 0
            for j in need:
                for _ in range(need[j]):
                    want, seq = n, n_seq + at
                    x = queue[j][0]
                    if x[1] < want:  # only when n is 1
                        raise AssertionError("run split")
                    plan.append((x[0], want, seq, j))
                    x[1] -= want
                    if not x[1]:
                        queue[j].pop(0)
            for x, want, seq, _ in plan:
                place(x, want, seq, used)
                used += x
            free[capacity - used].append((n_seq + at, n))
            at += n
        n_seq += times
    for x in range(limit, 0, -1):
        n, room = int(counts[x]), x
        while n:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                fits = capacity // x
                k = -(-n // fits)
                free[capacity].append((n_seq, k))
                n_seq += k
                room = x
                continue
            seq, m = free[room].pop()
            each = room // x
            if n >= m * each:
                taken, rest = m, 0
            elif n >= each:
                taken, rest = n // each, m - n // each
            else:
                taken, rest, each = 1, m - 1, n
            for t in range(each):
                place(x, taken, seq, capacity - room + t * x)
            if rest:
                free[room].append((seq + taken, rest))
            free[room - each * x].append((seq, taken))
            n -= taken * each
    out.sort()
    columns = np.array(out, np.int64).reshape(-1, 5).T
    return Plan(*columns, n_seq)


def best_plan(counts: np.ndarray, capacity: int, groups: int = 48) -> Plan:
    """The plan with the fewest sequences over a few limits between large and small."""
    plans = (make_plan(counts, capacity, groups, small) for small in (1 / 8, 1 / 4, 1 / 3, 1 / 2))
    return min(plans, key=lambda p: p.n_sequences)


def _assign(plan: Plan):
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        key = (plan.length.astype(np.uint64) << np.uint64(48)) | plan.first.astype(np.uint64)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            length = get("length").to_numpy(zero_copy_only=False)
            rank = get("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in _PIECES.names), pa.array(plan.sequence[at] + rank - plan.first[at]), pa.array(plan.offset[at])], schema=schema
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str | None = None, closing: int = 0, groups: int = 48) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(_cut_pieces(vocabulary or default_vocabulary(), capacity, closing), _PIECES_DDL))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = best_plan(counts, capacity, groups)
    shares = max(8, int(counts.sum()) // SHARE_ROWS)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(shares)))
    before = (
        dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
        .select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    )
    own = Window.partitionBy("length", "share").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("local", F.row_number().over(own) - 1).join(before, ["length", "share"])
    ranked = ranked.select(*_PIECES.names, (F.col("local") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(_assign(plan), f"{_PIECES_DDL}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
