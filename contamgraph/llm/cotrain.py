"""Quality classifier by co-training.

Two views of a page see different evidence: the *text view* (its words and their
first bytes, hashed to ``2**16`` cells each, and statistics of characters, words and
lines) and the *metadata view* (source, language, length).  Each has class counts of
the cells that rows have, as in naive Bayes; cells whose log-odds do not stand
``LEAST_Z`` standard errors from zero count nothing.  Counts can be summed, so learning
from any number of rows is one distributed sum.  A row's evidence (its log-odds added
up, for a text beside its statistics) becomes a probability by a logistic regression
on calibration rows, which are kept out of the counts.

Round 0 learns from all labelled rows but a fifth, the calibration rows.
In every round both views, calibrated, judge all rows of the pool (rows without a
label); rows that a view is confident of leave the pool for good, and their
pseudo-labels are added to the counts of the *other* view, where they stay.  No
bound cuts the exchange.  A row that was named before is recognised by the earlier
rounds' models, which travel along, so a round is one pass and one sum.  At last
the calibrated views are combined on the calibration rows and score every document.

Equal rows (same text and metadata) are one row from the first shuffle on, so
copies weigh once, and their scores are joined back by a 64-bit key.  Labels join
their rows in that shuffle, too, so features move once.  The driver
holds the models (``2**17`` counts for each class, view and label) and at most
``max_labelled`` calibration rows, the ones with the smallest hashes of the key.

Several labels (such as quality and toxicity) are learned in the same passes, each
with its own models and pool.

Null text is empty, null metadata is a value of its own.  Ids are integers; rows
may repeat, rows without an id are scored like others and never train.  Labels other
than 0 and 1 are ignored, of several labels of an id, or of equal rows, the smallest
counts.  Where the training or the calibration rows hold no row of a class, every
score is the share of class 1 (0.5 without labels).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.plans.lineage import cut

#: Cells of the words (as many again are those of their first STEM bytes).
WORD_CELLS, STEM = 1 << 16, 5
#: Log-odds that count as strong by themselves.
STRONG = 2.0
#: Standard errors that a cell's log-odds must stand from zero.
LEAST_Z = 3.0
#: Hash slots from which the calibration rows are cut.
_SLOTS = 4096
#: Hash cells of the metadata view for each metadata column.
META_CELLS = 32
_CLASSES = {
    "upper": list(range(65, 91)), "lower": list(range(97, 123)), "digit": list(range(48, 58)), "space": [32], "line": [10],
    "stop": [ord(c) for c in ".!?"], "comma": [ord(c) for c in ",;:"], "bar": [ord("|")], "bang": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*@~^_=+<>{}[]\\"], "wide": list(range(128, 256)),
}
_KIND = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _KIND[_bytes] = _i
_N_KINDS = len(_CLASSES) + 1
N_TEXT = _N_KINDS + 8


def text_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Statistics of each document of a block, as rates and logarithms."""
    m = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((m, N_TEXT), np.float32)
    doc = np.repeat(np.arange(m), size)
    kinds = np.bincount(doc * _N_KINDS + _KIND[buf], minlength=m * _N_KINDS).reshape(m, _N_KINDS)
    out[:, :_N_KINDS] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    word, of, start = B.words(buf, offs)
    n = np.bincount(of, minlength=m)
    some = np.maximum(n, 1)
    key, count = _by_doc(word, of)
    distinct = np.bincount(key, minlength=m)
    most = np.zeros(m, np.int64)
    np.maximum.at(most, key, count)
    out[:, _N_KINDS] = np.log1p(size)
    out[:, _N_KINDS + 1] = np.log1p(n)
    out[:, _N_KINDS + 2] = size / some / 10
    out[:, _N_KINDS + 3] = distinct / some
    out[:, _N_KINDS + 4] = most / some
    # lines: share that repeats another one of the document
    breaks = buf == 10
    first = np.zeros(len(buf), bool)
    first[offs[:-1][size > 0]] = True
    if len(buf):
        first[1:] |= breaks[:-1]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(buf))
    line = B.range_hash(B.rolling(buf), begin, end) if len(buf) else np.zeros(0, np.uint64)
    line_doc = np.searchsorted(offs, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=m)
    lkey, _ = _by_doc(line, line_doc)
    out[:, _N_KINDS + 5] = 1 - np.bincount(lkey, minlength=m) / np.maximum(lines, 1)
    out[:, _N_KINDS + 6] = np.log1p(lines)
    # words without a lower-case letter or wide byte before the next word
    low = np.concatenate(([0], np.cumsum((_KIND[buf] == 1) | (_KIND[buf] == 10))))
    stop = np.append(start[1:], len(buf))
    odd = low[stop] == low[start] if len(start) else np.zeros(0, bool)
    out[:, _N_KINDS + 7] = np.bincount(of[odd], minlength=m) / some
    return out


def _by_doc(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value): their documents and counts."""
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], np.diff(np.append(at, len(v)))


N_X = 2 * WORD_CELLS


def text_cells(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each document of a block, sorted: (document, cell)."""
    word, of, start = B.words(buf, offs)
    end = B.word_windows(buf, offs, np.ones(len(offs) - 1, bool), 1)[1]
    stem = B.range_hash(B.rolling(buf, lower=True), start, np.minimum(start + STEM, end)) if len(start) else word
    cell = lambda h: (h >> np.uint64(48)).astype(np.int64)
    code = np.unique(np.concatenate((of * N_X + cell(word), of * N_X + WORD_CELLS + cell(stem))))
    return code // N_X, code % N_X


_ROWS = pa.schema([("key", pa.int64()), ("x", pa.binary()), ("z", pa.binary())])


def _distinct_rows(n_meta: int):
    """Cells of both views, once for each distinct row of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            keys = get("key").to_pylist()
            fresh = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            size = np.log2(np.maximum(np.array(get("size").to_pylist(), np.int64), 0) + 1).astype(np.int64)
            z = np.stack([np.array(get(f"m{j}").to_pylist(), np.int64) + j * META_CELLS for j in range(n_meta)] + [size + n_meta * META_CELLS], 1).astype("<u2")
            for at, end, buf, offs in B.blocks(get("text")):
                doc, cell = text_cells(buf, offs)
                edge = np.searchsorted(doc, np.arange(end - at + 1))
                words = np.bincount(doc[cell < WORD_CELLS], minlength=end - at)
                low = (cell % WORD_CELLS).astype("<u2")
                stats = text_features(buf, offs)
                x = [_packed(low[a:b], n, own) for own, n, a, b in zip(stats, words.tolist(), edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([get("key").slice(at, end - at), pa.array(x, pa.binary()), pa.array([_packed(r, len(r)) for r in z[at:end]], pa.binary())], schema=_ROWS)

    return run


def _packed(cells: np.ndarray, first: int, stats: np.ndarray | None = None) -> bytes:
    """Number of cells in the first block, statistics, and cells in two bytes each."""
    return first.to_bytes(4, "little") + (b"" if stats is None else stats.astype("<f4").tobytes()) + cells.tobytes()


def _merged(n_labels: int):
    """Rows sorted by key, features or labels: one row for each key."""
    schema = pa.schema([*_ROWS, *((f"y{j}", pa.int32()) for j in range(n_labels))])

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in schema.names), strict=True):
                if last is not None and last[0] == row[0]:
                    last = tuple(b if a is None else a for a, b in zip(last, row, strict=True))
                else:
                    out += [] if last is None else [last]
                    last = row
            yield B.table({c: [r[i] for r in out] for i, c in enumerate(schema.names)}, schema)
        if last is not None:
            yield B.table({c: [last[i]] for i, c in enumerate(schema.names)}, schema)

    return run


class Logistic:
    """Ridge-penalised logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        a = self._design(x)
        w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(a @ w)
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x.astype(float) - self.mean) / self.scale, np.ones((len(x), 1))), 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


class Side:
    """Cells and statistics of some rows in one view."""

    def __init__(self, column, n_stats: int):
        raw = [bytes(r) for r in (column.to_pylist() if hasattr(column, "to_pylist") else column)]
        self.n = len(raw)
        count = np.array([len(r) // 2 for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), "<u2")
        start = np.cumsum(count) - count
        first = flat[start[:, None] + np.arange(2)].view("<u4").ravel()
        self.stats = flat[start[:, None] + 2 + np.arange(2 * n_stats)].view("<f4").astype(float)
        place = np.arange(len(flat)) - np.repeat(start + 2 + 2 * n_stats, count)
        own = place >= 0
        self.row = np.repeat(np.arange(self.n), count)[own]
        self.cell = flat[own].astype(np.int64) + WORD_CELLS * (place[own] >= first[self.row])


#: Statistics before the cells, and blocks of cells, of the text and of the metadata view.
_STATS = (N_TEXT, 0)
_BLOCKS = ((0, WORD_CELLS, N_X), (0,))


class View:
    """Class counts of one view as log-odds, with its calibration."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, blocks: tuple[int, ...]):
        share = (counts + 0.5) / (totals[:, None] + 1)
        odds = np.log(share[1] / share[0])
        error = np.sqrt((1 / (counts + 0.5) - 1 / (totals[:, None] + 1)).sum(0))
        self.weight = np.where(np.abs(odds) >= LEAST_Z * error, odds, 0).astype(np.float32)
        self.blocks = blocks if len(blocks) > 1 else (0, len(odds))
        self.platt: Logistic | None = None

    def evidence(self, side: Side) -> np.ndarray:
        """For each block of cells: mean log-odds, and logarithms of the strong odds for and against."""
        columns = [side.stats]
        for low, high in zip(self.blocks, self.blocks[1:], strict=False):
            own = (side.cell >= low) & (side.cell < high)
            row, w = side.row[own], self.weight[side.cell[own]]
            n = np.maximum(np.bincount(row, minlength=side.n), 1)
            add = lambda v: np.bincount(row, weights=v, minlength=side.n)  # noqa: E731, B023
            columns.append(np.stack((add(w) / np.sqrt(n), np.log1p(add(w * (w >= STRONG))), np.log1p(add(-w * (w <= -STRONG)))), 1))
        return np.concatenate(columns, 1)

    def calibrate(self, side: Side, y: np.ndarray) -> None:
        self.platt = Logistic(self.evidence(side), y)

    def logit(self, side: Side) -> np.ndarray:
        return self.platt.logit(self.evidence(side))


def named(views: tuple[View, View], sides: tuple[Side, Side], confident: float) -> tuple[np.ndarray, np.ndarray]:
    """Class that each view is confident of, by row: 0, 1, or -1 for none."""
    out = []
    for view, side in zip(views, sides, strict=True):
        p = _sigmoid(view.logit(side))
        out.append(np.where(p >= confident, 1, np.where(p <= 1 - confident, 0, -1)))
    return out[0], out[1]


def _sides(batch) -> tuple[Side, Side]:
    x, z = (Side(batch.column(batch.schema.get_field_index(c)), n) for c, n in zip("xz", _STATS, strict=True))
    return x, z


_SUMS = pa.schema([("label", pa.int32()), ("view", pa.int32()), ("y", pa.int32()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_SUMS_DDL = "label int, view int, y int, cells array<int>, counts array<long>"


def _tally(n_labels: int, widths: tuple[int, int], past: list[list[tuple[View, View] | None]], confident: float):
    """Class counts of the rows that are to be learned: the labelled ones, or those that
    the last of the ``past`` rounds' views name first.  The cell -1 counts rows."""

    def run(batches):
        total = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            sides = _sides(batch)
            held = np.array(get("held").to_pylist(), bool)
            for label in range(n_labels):
                y = np.array([-1 if v is None else v for v in get(f"y{label}").to_pylist()], np.int64)
                if not past:
                    learn = (np.where(held, -1, y),) * 2
                elif past[-1][label] is None:
                    continue
                else:
                    pool = y < 0
                    for views in past:
                        text, meta = named(views[label], sides, confident)
                        learn = (np.where(pool, meta, -1), np.where(pool, text, -1))  # each view learns from the other
                        pool &= (text < 0) & (meta < 0)
                for view, (side, want) in enumerate(zip(sides, learn, strict=True)):
                    for c in (0, 1):
                        own = want == c
                        if own.any():
                            counts = total.setdefault((label, view, c), np.zeros(widths[view] + 1, np.int64))
                            counts[:-1] += np.bincount(side.cell[own[side.row]], minlength=widths[view])
                            counts[-1] += own.sum()
        out = {f.name: [] for f in _SUMS}
        for (label, view, c), counts in total.items():
            used = np.flatnonzero(counts)
            cells = np.where(used == widths[view], -1, used)
            for name, v in zip(_SUMS.names, (label, view, c, cells, counts[used]), strict=True):
                out[name].append(v)
        yield B.table(out, _SUMS)

    return run


class Counts:
    """Class counts of both views of one label."""

    def __init__(self, widths: tuple[int, int]):
        self.cells = [np.zeros((2, w)) for w in widths]
        self.rows = [np.zeros(2), np.zeros(2)]

    def add(self, sums: pa.Table, label: int, least: int = 0) -> None:
        """Add a round's sums; a class of which a view named fewer than ``least`` rows is left out."""
        col = {c: sums.column(c).to_numpy() for c in ("label", "view", "y", "cell", "n")}
        for view in (0, 1):
            for c in (0, 1):
                own = (col["label"] == label) & (col["view"] == view) & (col["y"] == c)
                cell, n = col["cell"][own], col["n"][own]
                rows = n[cell < 0].sum()
                if rows >= max(least, 1):
                    self.cells[view][c][cell[cell >= 0]] += n[cell >= 0]
                    self.rows[view][c] += rows

    def views(self, sides: tuple[Side, Side], y: np.ndarray) -> tuple[View, View] | None:
        """Calibrated views; none where a class is missing."""
        if not all((r > 0).all() for r in self.rows) or not _both(y):
            return None
        out = []
        for view, side in enumerate(sides):
            model = View(self.cells[view], self.rows[view], _BLOCKS[view])
            model.calibrate(side, y)
            out.append(model)
        return out[0], out[1]


def _score(final: list, shares: list[float]):
    schema = pa.schema([("key", pa.int64()), ("p", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sides = _sides(batch)
            p = np.empty((n, 3 * len(final)))
            for j, made in enumerate(final):
                if made is None:
                    p[:, 3 * j : 3 * j + 3] = shares[j]
                else:
                    (text, meta), join = made
                    t, m = text.logit(sides[0]), meta.logit(sides[1])
                    p[:, 3 * j : 3 * j + 3] = _sigmoid(np.stack((t, m, join.logit(np.stack((t, m), 1))), 1))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(list(p), pa.list_(pa.float64()))], schema=schema)

    return run


def _both(y: np.ndarray) -> bool:
    return len(y) > 0 and 0 < y.sum() < len(y)


def _calibration_rows(rows: DataFrame, n_labels: int, bound: int) -> pa.Table:
    """Rows of the calibration fold in the first hash slots that hold at most ``bound`` rows."""
    held = rows.where("held")
    slots = held.groupBy(F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(_SLOTS)).alias("slot")).count().collect()
    total, edge = 0, 0
    for r in sorted(slots, key=lambda r: r["slot"]):
        total += r["count"]
        if total > bound:
            break
        edge = r["slot"] + 1
    return held.where(F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(_SLOTS)) < edge).select("key", "x", "z", *(f"y{j}" for j in range(n_labels))).orderBy("key").toArrow()


def cotrain(
    docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"),
    size_col: str = "n_chars", rounds: int = 3, exchange: int = 1, confident: float = 0.95, max_labelled: int = 10_000,
) -> DataFrame:
    """(id, p) for every row of ``docs``; p holds, for each label, the calibrated
    probabilities of the text view, of the metadata view, and of both combined.

    Fewer than ``exchange`` rows of a class that a view names in a round are left out
    of the other view's counts, as too few to learn from (1: all are learned).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text, size = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(size_col).cast("long"), F.lit(-1))
    meta = [F.pmod(F.xxhash64(F.lit(j), F.coalesce(F.col(c).cast("string"), F.lit("\0null"))), F.lit(META_CELLS)) for j, c in enumerate(meta_cols)]
    key = F.xxhash64(text, size, *meta).alias("key")
    ids = docs.select(F.col(id_col).cast("long").alias("id"), key)
    plain = docs.select(key, text.alias("text"), F.greatest(size, F.lit(0)).alias("size"), *(m.alias(f"m{j}") for j, m in enumerate(meta)))
    n = len(label_cols)
    y = [F.min(F.when(F.col(c).isin(0, 1), F.col(c).cast("int"))).alias(f"y{j}") for j, c in enumerate(label_cols)]
    known = labels.select(F.col(id_col).cast("long").alias("id"), *label_cols).where("id is not null")
    known = ids.join(known, "id").groupBy("key").agg(*y)
    features = plain.mapInArrow(_distinct_rows(len(meta_cols)), "key long, x binary, z binary")
    ys = [f"y{j}" for j in range(n)]
    both = features.unionByName(known, allowMissingColumns=True).repartition(parts, "key").sortWithinPartitions("key")
    rows = both.mapInArrow(_merged(n), "key long, x binary, z binary, " + ", ".join(f"{c} int" for c in ys))
    rows = cut(rows.withColumn("held", F.coalesce(*ys).isNotNull() & (F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(5)) == 4)))

    widths = (N_X, len(meta_cols) * META_CELLS + 64)
    held = _calibration_rows(rows, n, max_labelled)
    hx, hz = held.column("x").to_pylist(), held.column("z").to_pylist()
    counts, past = [Counts(widths) for _ in range(n)], []

    def summed() -> pa.Table:
        out = rows.mapInArrow(_tally(n, widths, past, confident), _SUMS_DDL).select("label", "view", "y", F.posexplode("cells").alias("i", "cell"), "counts")
        return out.groupBy("label", "view", "y", "cell").agg(F.sum(F.element_at("counts", F.col("i") + 1)).alias("n")).toArrow()

    side = []
    for j in range(n):
        own = [i for i, v in enumerate(held.column(f"y{j}").to_pylist()) if v is not None]
        side.append(((Side([hx[i] for i in own], _STATS[0]), Side([hz[i] for i in own], _STATS[1])), np.array([held.column(f"y{j}")[i].as_py() for i in own], float)))
    for r in range(rounds + 1):
        sums = summed()
        for j in range(n):
            counts[j].add(sums, j, exchange if r else 0)
        past.append([counts[j].views(*side[j]) for j in range(n)])
    final = []
    for j, views in enumerate(past[-1]):
        if views is None:
            final.append(None)
            continue
        sides, y = side[j]
        final.append((views, Logistic(np.stack([v.logit(s) for v, s in zip(views, sides, strict=True)], 1), y)))
    have = [rows.agg(F.avg(f"y{j}")).first()[0] if final[j] is None else 0.0 for j in range(n)]
    scored = rows.mapInArrow(_score(final, [0.5 if s is None else float(s) for s in have]), "key long, p array<double>")
    return ids.join(scored, "key").select(F.col("id").alias(id_col), "p")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", flag_col: str | None = None, keep_above: float = 0.5, **options) -> DataFrame:
    """(id, p_text, p_meta, score, keep) for every row of ``docs``; with ``flag_col``, a
    second label, also (flag)_score and whether it is at least one half."""
    cols = (label_col,) if flag_col is None else (label_col, flag_col)
    p = lambda i: F.element_at("p", i)
    out = cotrain(docs, labels, cols, id_col=id_col, **options)
    flags = [] if flag_col is None else [p(6).alias(f"{flag_col}_score"), (p(6) >= 0.5).alias(flag_col)]
    return out.select(id_col, p(1).alias("p_text"), p(2).alias("p_meta"), p(3).alias("score"), (p(3) >= keep_above).alias("keep"), *flags)
