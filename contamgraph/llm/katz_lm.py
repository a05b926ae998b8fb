"""Katz backoff language model over word n-grams.

Counts are Good-Turing discounted up to ``CUTOFF``; what a history's seen
followers lose goes to its unseen followers in proportion to the next lower
order, with backoff weights normalised exactly: for every history, the
probabilities of all known words, the end of text and one unknown word sum to 1.

The corpus is encoded once into *shards* (tables of local word numbers, in shared
storage).  For each order, a shard sends its distinct n-grams to the partition
that owns their history; the partition sums training counts over all shards and
answers with the counts and with each history's sufficient statistics (total,
followers by count, lower-order mass of its followers).  Those answers are the
partitioned n-gram tables; no table of the corpus's words or n-grams is ever
broadcast or collected, only the count-of-counts (``CUTOFF + 1`` numbers an order)
reach the driver.  Each shard then evaluates its tokens recursively: discounted
relative frequency where the n-gram is known, backoff weight times the shorter
n-gram's probability where not.

Degenerate statistics have defined results.  Where the raw count classes give a
factor outside (0, 1), their log-linear fit is used (as in simple Good-Turing),
and where that has none either, half a count is taken; a
history whose followers all lie above the cutoff gives up half a count each, so
no word has probability 0.  Without training tokens every token has the
probability of the unknown word, 1.

Words are runs without ASCII white space, A-Z lower-cased; each text ends with
one end token.  Null text is the empty text (one end token).  Ids are integers, may be null or
repeat; each row is scored by itself.  Other columns are ignored.  Words are
told apart by 64-bit hashes, followers of one history by 48 bits of them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.plans.lineage import cut, cut_bucketed

U64 = np.uint64
SHARD_BYTES = 7 << 20
#: Counts above are not discounted (Katz, 1987).
CUTOFF = 5
_END = U64(0x1D8E4E27C47D124F)
_BEGIN = U64(0xEB44ACCAB455D165)

_SHARDS = pa.schema([
    ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.binary()), ("lens", pa.binary()),
    ("low", pa.binary()), ("mid", pa.binary()), ("high", pa.binary()), ("vocab", pa.binary()),
])
_SHARDS_DDL = "shard long, ids array<long>, train binary, lens binary, low binary, mid binary, high binary, vocab binary"
_ASK = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("histories", pa.binary()), ("widths", pa.binary()), ("followers", pa.binary()), ("counts", pa.binary()), ("at", pa.binary()), ("lower", pa.binary())])
_ASK_DDL = "bucket int, shard long, histories binary, widths binary, followers binary, counts binary, at binary, lower binary"
_TELL = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("stats", pa.binary()), ("mass", pa.binary())])
_TELL_DDL = "shard long, bucket int, counts binary, stats binary, mass binary"
_STATS = CUTOFF + 3  # total, followers with count 1..CUTOFF, followers above, their sum


def _z(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unz(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _rows(batch: pa.RecordBatch):
    """Rows one by one, so that one decoded shard is held at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _encode(batches):
    """Whole documents to shards of local word numbers, most frequent first."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    ids, train, lens, hashes, held, number = [], [], [], [], 0, 0

    def flush():
        h = np.concatenate(hashes)
        vocab, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.argsort(-count, kind="stable")
        place = np.empty(len(vocab), np.int64)
        place[rank] = np.arange(len(vocab))
        local = place[inverse].astype("<u4").view(np.uint8).reshape(-1, 4)
        return B.table(
            {
                "shard": [first + number], "ids": [ids], "train": [np.array(train, np.uint8).tobytes()],
                "lens": [np.concatenate(lens).astype(np.uint32).tobytes()],
                "low": [_z(local[:, 0].tobytes())], "mid": [_z(local[:, 1].tobytes())],
                "high": [_z(np.ascontiguousarray(local[:, 2:4]).tobytes())], "vocab": [vocab[rank].tobytes()],
            },
            _SHARDS,
        )

    for batch in batches:
        id_col, text, flag = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "train"))
        for at, end, buf, offs in B.blocks(text):
            word, doc, _ = B.words(buf, offs)
            n = np.bincount(doc, minlength=end - at)
            out = np.full(len(word) + end - at, _END)
            out[np.arange(len(word)) + doc] = word
            ids += id_col.slice(at, end - at).to_pylist()
            train += [bool(x) for x in flag.slice(at, end - at).to_pylist()]
            lens.append(n + 1)
            hashes.append(out)
            held += len(buf) + end - at
            if held >= SHARD_BYTES:
                yield flush()
                ids, train, lens, hashes, held = [], [], [], [], 0
                number += 1
    if ids:
        yield flush()


class Shard:
    """One decoded shard with the token arrays that every order needs."""

    def __init__(self, row: dict):
        self.number = row["shard"]
        self.ids = row["ids"]
        self.lens = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        low = np.frombuffer(_unz(row["low"]), np.uint8)
        local = np.zeros((len(low), 4), np.uint8)
        local[:, 0], local[:, 1] = low, np.frombuffer(_unz(row["mid"]), np.uint8)
        local[:, 2:] = np.frombuffer(_unz(row["high"]), np.uint8).reshape(-1, 2)
        self.token = local.reshape(-1).view("<i4")
        self.vocab = np.frombuffer(row["vocab"], U64)
        self.train_doc = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.train = np.repeat(self.train_doc, self.lens)
        start = np.cumsum(self.lens) - self.lens
        self.position = (np.arange(len(self.token)) - np.repeat(start, self.lens)).astype(np.int32)

    def histories(self, order: int) -> np.ndarray:
        """Hash of the order - 1 tokens before each token; begin marks pad."""
        word = self.vocab[self.token] if len(self.token) else np.zeros(0, U64)
        out = np.full(len(word), U64(order))
        for back in range(1, order):
            before = np.full(len(word), _BEGIN)
            before[back:] = word[: len(word) - back]
            before[self.position < back] = _BEGIN
            out = B.mix(out * U64(0xD1342543DE82EF95) + before)
        return out

    def grams(self, order: int, bits: int):
        """Distinct n-grams in (bucket, history, follower) order, and each token's place among them."""
        h = self.histories(order)
        key = np.unique(h, return_inverse=True)[1] * max(1, len(self.vocab))
        key += self.token
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        del key
        # unique histories are sorted by hash, so by bucket: key order groups buckets and histories
        gh, gw = h[at], self.vocab[self.token[at]]
        count = np.bincount(inverse, weights=self.train, minlength=len(at)).astype(np.int64)
        bucket = (gh >> U64(64 - bits)).astype(np.int64)
        return gh, gw, at, inverse, count, bucket


def _small(x: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest width, told by a leading byte, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k, most in ((1, 2**8), (2, 2**16), (4, 2**32), (8, 2**64)) if top < most)
    return _z(bytes([kind]) + x.astype(f"<u{kind}").tobytes())


def _wide(raw: bytes) -> np.ndarray:
    raw = _unz(raw)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def discounts(classes: np.ndarray) -> np.ndarray:
    """Factors for counts 1..CUTOFF from the numbers of n-grams with counts 1..CUTOFF+1.

    Katz's factors from the raw numbers; where those leave (0, 1), as copies in
    the corpus make them do, from their log-linear fit; else half a count.
    """
    r = np.arange(1, CUTOFF + 1)
    n = np.asarray(classes[: CUTOFF + 1], float)
    tries = []
    if (n > 0).all():
        tries.append(n)
        slope, level = np.polyfit(np.log(np.arange(1, CUTOFF + 2)), np.log(n), 1)
        tries.append(np.exp(level) * np.arange(1.0, CUTOFF + 2) ** slope)
    for m in tries:
        top = (CUTOFF + 1) * m[CUTOFF] / m[0]
        if top < 1:
            d = ((r + 1) * m[1:] / m[:-1] / r - top) / (1 - top)
            if ((d > 0) & (d < 1)).all():
                return d
    return (r - 0.5) / r


def _lose(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    c = count.astype(float)
    low = (count >= 1) & (count <= CUTOFF)
    c[low] *= d[count[low] - 1]
    return c


def unigram(count: np.ndarray, total: int, classes: np.ndarray, sums: tuple[int, int]) -> np.ndarray:
    """Probabilities of tokens with these training counts; 0 is the one unknown word.

    sums: number and total of the words above the cutoff.
    """
    if not total:
        return np.ones(len(count))
    d = discounts(classes)
    r = np.arange(1, CUTOFF + 1)
    m = classes[:CUTOFF].astype(float)
    if m.sum():
        unknown = float((m * r * (1 - d)).sum()) / total
        known = _lose(count, d) / total
    else:  # every word above the cutoff: each gives half a count
        unknown = 0.5 * sums[0] / total
        known = np.maximum(count - 0.5, 0) / total
    return np.where(count > 0, known, unknown)


def conditional(count: np.ndarray, history: np.ndarray, stats: np.ndarray, flat: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Katz probability of each n-gram with a count, backoff weight of each history).

    count and history belong to n-grams, the rest to histories; the weight of a
    history that never backs off means nothing.
    """
    total = stats[:, 0].astype(float)
    m, above, above_sum = stats[:, 1 : CUTOFF + 1], stats[:, CUTOFF + 1], stats[:, CUTOFF + 2]
    r = np.arange(1, CUTOFF + 1)
    kept = np.where(flat, above_sum - 0.5 * above, m @ (r * d) + above_sum)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(total > 0, (1 - kept / total) / (1 - mass), 1.0)
        seen = np.where(flat[history], count - 0.5, _lose(count, d)) / total[history]
    return seen, weight


def _ask_words(bits: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                s = Shard(row)
                order = np.argsort(s.vocab)
                count = np.bincount(s.token, weights=s.train, minlength=len(s.vocab)).astype(np.int64)[order]
                v = s.vocab[order]
                out = {f.name: [] for f in _ASK}
                for key, a, b in zip(*B.splits((v >> U64(64 - bits)).astype(np.int64)), strict=True):
                    for name, x in zip(_ASK.names, (int(key), s.number, b"", b"", v[a:b].tobytes(), _small(count[a:b]), b"", b""), strict=True):
                        out[name].append(x)
                yield B.table(out, _ASK)

    return run


def _classes(count: np.ndarray) -> np.ndarray:
    """n-grams with counts 1..CUTOFF+1, all n-grams, all tokens, n-grams above the cutoff."""
    by = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    return np.concatenate((by, [np.count_nonzero(count), count.sum(), np.count_nonzero(count > CUTOFF)])).astype(np.int64)


def _count_words(piece: pa.Table) -> pa.Table:
    rows = piece.to_pylist()
    words = [np.frombuffer(r["followers"], U64) for r in rows]
    value, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([_wide(r["counts"]) for r in rows]), minlength=len(value)).astype(np.int64)
    out = {f.name: [] for f in _TELL}
    at = 0
    for r, w in zip(rows, words, strict=True):
        for name, x in zip(_TELL.names, (r["shard"], r["bucket"], _small(total[inverse[at : at + len(w)]]), b"", b""), strict=True):
            out[name].append(x)
        at += len(w)
    for name, x in zip(_TELL.names, (-1, rows[0]["bucket"], _classes(total).tobytes(), b"", b""), strict=True):
        out[name].append(x)
    return pa.Table.from_batches([B.table(out, _TELL)])


def _ask_grams(order: int, bits: int, summaries: list[np.ndarray]):
    """Requests of a shard for one order, once its lower orders are answered."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                s = Shard(row)
                p = evaluate(s, row, summaries, bits)
                gh, gw, at, _, count, bucket = s.grams(order, bits)
                lower, which = np.unique(p[at], return_inverse=True)
                out = {f.name: [] for f in _ASK}
                for key, a, b in zip(*B.splits(bucket), strict=True):
                    h, s0, e0 = B.splits(gh[a:b])
                    used, idx = np.unique(which[a:b], return_inverse=True)
                    for name, x in zip(
                        _ASK.names,
                        (int(key), s.number, h.tobytes(), _small(e0 - s0), B.pack48(gw[a:b]), _small(count[a:b]), _small(idx), lower[used].tobytes()),
                        strict=True,
                    ):
                        out[name].append(x)
                yield B.table(out, _ASK)

    return run


def _count_grams(piece: pa.Table) -> pa.Table:
    """One partition of histories: counts over all shards, and the histories' statistics."""
    rows = piece.to_pylist()
    hist = [np.frombuffer(r["histories"], U64) for r in rows]
    width = [_wide(r["widths"]) for r in rows]
    count = np.concatenate([_wide(r["counts"]) for r in rows])
    follower = np.concatenate([B.unpack48(r["followers"]) for r in rows])
    lower = np.concatenate([np.frombuffer(r["lower"], float)[_wide(r["at"])] for r in rows])
    value, hid = np.unique(np.concatenate(hist), return_inverse=True)
    own = np.repeat(hid, np.concatenate(width))
    order = np.lexsort((follower, own))
    so, sf = own[order], follower[order]
    new = np.ones(len(order), bool)
    new[1:] = (so[1:] != so[:-1]) | (sf[1:] != sf[:-1])
    head = np.flatnonzero(new)
    total = np.add.reduceat(count[order], head)
    gram_of = np.empty(len(order), np.int64)
    gram_of[order] = np.cumsum(new) - 1
    seen = total > 0
    gh = so[head]
    stats = np.zeros((len(value), _STATS), np.int64)
    stats[:, 0] = np.bincount(gh, weights=total, minlength=len(value))
    for r in range(1, CUTOFF + 1):
        stats[:, r] = np.bincount(gh[total == r], minlength=len(value))
    big = total > CUTOFF
    stats[:, CUTOFF + 1] = np.bincount(gh[big], minlength=len(value))
    stats[:, CUTOFF + 2] = np.bincount(gh[big], weights=total[big], minlength=len(value))
    flat = (stats[:, 1 : CUTOFF + 1].sum(1) == 0) & (stats[:, 0] > 0)
    mass = np.bincount(gh[seen], weights=lower[order][head][seen], minlength=len(value))
    out = {f.name: [] for f in _TELL}
    at = h_at = 0
    for r, h, w in zip(rows, hist, width, strict=True):
        n = int(w.sum())
        mine = hid[h_at : h_at + len(h)]
        counts = total[gram_of[at : at + n]]
        # only histories with an unseen follower back off: the others need their total alone
        backs_off = np.zeros(len(h), bool)
        backs_off[np.repeat(np.arange(len(h)), w)[counts == 0]] = True
        own = stats[mine]
        columns = [own[:, 0], flat[mine], backs_off, *(own[backs_off, j] for j in range(1, _STATS))]
        planes = b"".join(len(x).to_bytes(8, "little") + x for x in map(_small, columns))
        for name, x in zip(_TELL.names, (r["shard"], r["bucket"], _small(counts), planes, mass[mine][backs_off].tobytes()), strict=True):
            out[name].append(x)
        at, h_at = at + n, h_at + len(h)
    for name, x in zip(_TELL.names, (-1, rows[0]["bucket"], _classes(total).tobytes(), b"", b""), strict=True):
        out[name].append(x)
    return pa.Table.from_batches([B.table(out, _TELL)])


def _histories(answer: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics, flat, lower-order mass) of an answer's histories; zeros where one never backs off."""
    raw, columns, at = answer["stats"], [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        columns.append(_wide(raw[at + 8 : at + 8 + n]))
        at += 8 + n
    total, flat, backs_off = columns[:3]
    stats, mass = np.zeros((len(total), _STATS), np.int64), np.zeros(len(total))
    stats[:, 0] = total
    rows = np.flatnonzero(backs_off)
    for j, c in enumerate(columns[3:], 1):
        stats[rows, j] = c
    mass[rows] = np.frombuffer(answer["mass"], float)
    return stats, flat.astype(bool), mass


def word_counts(shard: Shard, answers: list[dict]) -> np.ndarray:
    """Training count of each word of the shard's vocabulary, from the answers in bucket order."""
    told = [_wide(a["counts"]) for a in sorted(answers, key=lambda a: a["bucket"])]
    count = np.zeros(len(shard.vocab), np.int64)
    count[np.argsort(shard.vocab)] = np.concatenate(told) if told else []
    return count


def evaluate(shard: Shard, row: dict, summaries: list[np.ndarray], bits: int) -> np.ndarray:
    """Probability of each token under the highest order that has been answered."""
    s = summaries[0]
    p = unigram(word_counts(shard, row["a1"])[shard.token], int(s[CUTOFF + 2]), s[: CUTOFF + 1], (int(s[CUTOFF + 3]), 0))
    for order in range(2, len(summaries) + 1):
        gh, _, _, inverse, _, _ = shard.grams(order, bits)
        told = sorted(row[f"a{order}"], key=lambda a: a["bucket"])
        count = np.concatenate([_wide(a["counts"]) for a in told])
        stats, flat, mass = (np.concatenate(x) for x in zip(*map(_histories, told), strict=True))
        _, s0, e0 = B.splits(gh)
        del gh, told
        history = np.repeat(np.arange(len(s0)), e0 - s0)
        seen, weight = conditional(count, history, stats, flat, mass, discounts(summaries[order - 1][: CUTOFF + 1]))
        p *= weight[history][inverse]
        known = (count > 0)[inverse]
        p[known] = seen[inverse[known]]
    return p


_SCORES = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(bits: int, summaries: list[np.ndarray]):
    s = summaries[0]
    n_train, n_words = int(s[CUTOFF + 2]), int(s[CUTOFF + 1])

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row)
                start = np.cumsum(shard.lens) - shard.lens
                score = np.add.reduceat(np.log10(evaluate(shard, row, summaries, bits)), start)
                count = word_counts(shard, row["a1"])[shard.token]
                base = np.log10((count + 1) / (n_train + n_words + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.ids, pa.int64()), pa.array(shard.train_doc), pa.array(shard.lens),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64), start)),
                        pa.array(np.add.reduceat(base, start)), pa.array(score),
                    ],
                    schema=_SCORES,
                )

    return run


def _summary(told: DataFrame) -> np.ndarray:
    """Sum of the partitions' count classes (CUTOFF + 4 numbers a partition)."""
    width = CUTOFF + 4
    parts = told.where("shard = -1").select("counts").toLocalIterator()
    return sum((np.frombuffer(bytes(r["counts"]), np.int64) for r in parts), np.zeros(width, np.int64))


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Train on the rows where ``train`` holds and score every row.

    Returns (id, train, n_tokens, n_known, train_tokens, base_score, score), where
    score is the log10 probability of the text and base_score that of an add-one
    unigram model.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    bits = B.bucket_count(2 * docs.rdd.getNumPartitions(), 16).bit_length() - 1
    shards = cut_bucketed(plain.mapInArrow(_encode, _SHARDS_DDL), "shard")
    answers, summaries = [], []

    def with_answers() -> DataFrame:
        out = shards
        for i, told in enumerate(answers, 1):
            mine = told.where("shard <> -1").groupBy("shard").agg(F.collect_list(F.struct("bucket", "counts", "stats", "mass")).alias(f"a{i}"))
            out = out.join(mine.hint("shuffle_hash"), "shard", "left")
        return out

    for n in range(1, order + 1):
        if n == 1:
            ask, tell = shards.mapInArrow(_ask_words(bits), _ASK_DDL), _count_words
        else:
            ask, tell = with_answers().mapInArrow(_ask_grams(n, bits, list(summaries)), _ASK_DDL), _count_grams
        told = cut(ask.groupBy("bucket").applyInArrow(tell, _TELL_DDL))
        answers.append(told)
        summaries.append(_summary(told))
    scores = with_answers().mapInArrow(_score(bits, summaries), "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known",
        F.lit(int(summaries[0][CUTOFF + 2])).cast("long").alias("train_tokens"), "base_score", "score",
    )
