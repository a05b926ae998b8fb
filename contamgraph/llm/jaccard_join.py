"""N-gram Jaccard join as a blocked sparse matrix product.

The document by shingle incidence matrix is cut into column blocks (ranges of the
shingle hash).  Pass one counts each column and throws away columns with one
entry, which can add to no overlap.  The remaining entries are gathered by row;
a row keeps only if it can still reach the threshold: with n shingles, at most
``n - ceil(t n)`` of which may be missing from a partner, a row whose shingles
occurring nowhere else exceed that number has no partner at all.  The rarest
remaining shingles up to the same bound are its *prefix*; two documents that link
share a prefix shingle (size-derived bound of prefix filtering).  Documents
joined by shared prefix shingles form families; each family is multiplied block
by block: rows meet along the inverted columns of their prefixes, their overlap is
counted exactly over all their shingles, and pairs below ``t / (1 + t) * (n1 + n2)`` are discarded.

Documents with equal sets are one row from the first pass on, a family is walked
breadth first and a document that already belongs to a component is never compared
with that component again, so a group of m near copies costs about m row products.
Only a spanning forest of links is emitted.

What still grows: families come from shared prefix shingles that are not verified
yet, so they may hold more than near copies.  A family of B blocks (of
``BLOCK_ENTRIES`` entries) is dealt as pairs of blocks, each row to B - 1 of them.
Shingles that many rows share stand last in a row's order, so they are walked only
for rows that consist of such.

Sets are identified by a 64-bit fingerprint and shingles by 48 hash bits beside
the column-block bits; all counts are exact up to hash collisions.

Ids are integers.  Nulls, empty and white-space-only texts have the empty set, link with nothing and
are their own component.  Rows may repeat, ids may repeat or be null: rows are
matched by their set, and ``component_id`` is the smallest id that carries any
set of the component (null where no row of it has an id).  Columns beside id and
text are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.operators.components import connected_components
from contamgraph.plans.lineage import cut

U64 = np.uint64
CHUNK_BYTES = 8 << 20
#: Incidence entries that one block product holds.
BLOCK_ENTRIES = 2_000_000

_MEMBERS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64())])
_PIECES = pa.schema([("bucket", pa.int32()), ("fps", pa.binary()), ("ns", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_SHARED = pa.schema([("part", pa.int32()), ("fps", pa.binary()), ("ns", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("dfs", pa.binary())])
_SETS = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """(first row, sizes, fingerprints, documents of entries, entries) of each block."""
    for at, end, buf, offs in B.blocks(batch.column(batch.schema.get_field_index("text"))):
        word, doc, _ = B.words(buf, offs)
        d, h = B.shingle_sets(word, doc, end - at, k)
        n = np.bincount(d, minlength=end - at).astype(np.int64)
        fp = np.zeros(end - at, U64)
        some = np.flatnonzero(n)
        if len(some):
            begin = np.concatenate(([0], np.cumsum(n)))[some]
            fp[some] = B.mix(np.add.reduceat(B.mix(h ^ U64(0x5851F42D4C957F2D)), begin) + n[some].astype(U64))
        yield at, n, fp, d, h


def _members(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for at, n, fp, _, _ in _sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(n)), pa.array(n), pa.array(fp.view(np.int64))], schema=_MEMBERS
                )

    return run


def _column_pieces(k: int, bits: int):
    """Entries of a task's distinct sets, dealt to column blocks."""

    def flush(fps, ns, rows, hashes):
        fp, n = np.concatenate(fps), np.concatenate(ns)
        row, h = np.concatenate(rows), np.concatenate(hashes)
        bucket = (h >> U64(64 - bits)).astype(np.int64)
        order = np.lexsort((row, bucket))
        row, h, bucket = row[order], h[order], bucket[order]
        out = {f.name: [] for f in _PIECES}
        for key, a, b in zip(*B.splits(bucket), strict=True):
            own, s, e = B.splits(row[a:b])
            for name, value in zip(
                _PIECES.names,
                (int(key), fp[own].tobytes(), n[own].astype(np.uint32).tobytes(), (e - s).astype(np.uint32).tobytes(), B.pack48(h[a:b])),
                strict=True,
            ):
                out[name].append(value)
        return B.table(out, _PIECES)

    def run(batches):
        seen: set[int] = set()
        fps, ns, rows, hashes, held, at_row = [], [], [], [], 0, 0
        for batch in batches:
            for _, n, fp, d, h in _sets(batch, k):
                keep = np.zeros(len(n), bool)
                for i, x in enumerate(fp.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        keep[i] = True
                if not keep.any():
                    continue
                new_row = np.cumsum(keep) - 1 + at_row
                of = keep[d]
                fps.append(fp[keep]), ns.append(n[keep]), rows.append(new_row[d[of]]), hashes.append(h[of])
                at_row += int(keep.sum())
                held += int(of.sum()) * 8
                if held >= CHUNK_BYTES:
                    yield flush(fps, ns, rows, hashes)
                    fps, ns, rows, hashes, held, at_row = [], [], [], [], 0, 0
        if held:
            yield flush(fps, ns, rows, hashes)

    return run


def _join(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _count_columns(bits: int):
    """One column block: entries of columns with two rows or more, dealt by row."""

    def run(piece: pa.Table) -> pa.Table:
        bucket = piece.column("bucket")[0].as_py()
        fps, ns = _join(piece.column("fps"), U64), _join(piece.column("ns"), np.uint32)
        counts = _join(piece.column("counts"), np.uint32).astype(np.int64)
        h = B.unpack48(b"".join(piece.column("hashes").to_pylist()))
        _, first = np.unique(fps, return_index=True)
        once = np.zeros(len(fps), bool)
        once[first] = True
        own = np.repeat(np.arange(len(fps)), counts)
        keep = once[own]
        own, h = own[keep], h[keep]
        order = np.argsort(h, kind="stable")
        own, h = own[order], h[order]
        _, s, e = B.splits(h)
        df = np.repeat(e - s, e - s)
        many = df >= 2
        own, h, df = own[many], h[many], df[many]
        out = {f.name: [] for f in _SHARED}
        if len(own):
            part = (fps[own] >> U64(64 - bits)).astype(np.int64)
            order = np.lexsort((own, part))
            own, h, df, part = own[order], h[order], df[order], part[order]
            full = h | (U64(bucket) << U64(64 - bits))
            for key, a, b in zip(*B.splits(part), strict=True):
                who, s, e = B.splits(own[a:b])
                for name, value in zip(
                    _SHARED.names,
                    (int(key), fps[who].tobytes(), ns[who].tobytes(), (e - s).astype(np.uint32).tobytes(), full[a:b].tobytes(), np.minimum(df[a:b], 2**32 - 1).astype(np.uint32).tobytes()),
                    strict=True,
                ):
                    out[name].append(value)
        return pa.Table.from_batches([B.table(out, _SHARED)])

    return run


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _gather_rows(percent: int):
    """Rows of the incidence matrix that can still reach the threshold."""

    def run(piece: pa.Table) -> pa.Table:
        fps, ns = _join(piece.column("fps"), U64), _join(piece.column("ns"), np.uint32).astype(np.int64)
        counts = _join(piece.column("counts"), np.uint32).astype(np.int64)
        h, df = _join(piece.column("hashes"), U64), _join(piece.column("dfs"), np.uint32)
        who, inverse = np.unique(fps, return_inverse=True)
        n = np.zeros(len(who), np.int64)
        n[inverse] = ns
        own = np.repeat(inverse, counts)
        shared = np.bincount(own, minlength=len(who))
        room = _prefix_length(n, percent) - (n - shared)
        alive = room[own] > 0
        own, h, df = own[alive], h[alive], df[alive]
        order = np.lexsort((h, df, own))
        own, h = own[order], h[order].view(np.int64)
        who_at, s, e = B.splits(own)
        lengths = np.minimum(room[who_at], e - s)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[B.ranges(s, lengths)]))
        tokens = pa.array([h[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary())
        return pa.Table.from_arrays(
            [pa.array(who[who_at].view(np.int64)), pa.array(n[who_at]), prefix, tokens], schema=_SETS
        )

    return run


def link_forest(fps: np.ndarray, ns: np.ndarray, counts: np.ndarray, tokens: np.ndarray, percent: int, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among the given rows: (row, root) positions.

    Breadth-first row products; a row meets the rows that share one of the ``first`` entries
    of both (all, by default), and its overlap with those is counted over all entries.  Rows
    that have joined a component leave the columns, so no pair inside one is counted again.
    """
    m = len(fps)
    first = counts if first is None else first
    ptr = np.concatenate(([0], np.cumsum(counts)))
    _, col = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(m), counts)
    n_cols = int(col.max()) + 1 if len(col) else 0
    lead = np.arange(len(col)) - ptr[row] < first[row]
    order = np.argsort(col[lead], kind="stable")
    post = row[lead][order]
    width = np.bincount(col[lead], minlength=n_cols)
    head = np.concatenate(([0], np.cumsum(width)))[:-1]
    free, mine = np.ones(m, bool), np.zeros(n_cols, bool)
    left, gone = m, 0
    forest = []
    for seed in range(m):
        if not free[seed]:
            continue
        free[seed] = False
        left, gone = left - 1, gone + 1
        queue = [seed]
        while queue:
            x = queue.pop()
            if gone > 64 and gone > left:  # drop finished rows from the columns
                keep = free[post]
                col_of = np.repeat(np.arange(n_cols), width)[keep]
                post = post[keep]
                width = np.bincount(col_of, minlength=n_cols)
                head = np.concatenate(([0], np.cumsum(width)))[:-1]
                gone = 0
            own = col[ptr[x] : ptr[x] + first[x]]
            near = post[B.ranges(head[own], width[own])]
            cand = np.unique(near[free[near]])
            if not len(cand):
                continue
            mine[col[ptr[x] : ptr[x + 1]]] = True
            hit = mine[col[B.ranges(ptr[cand], counts[cand])]]
            overlap = np.add.reduceat(hit, np.cumsum(counts[cand]) - counts[cand], dtype=np.int64)
            mine[col[ptr[x] : ptr[x + 1]]] = False
            linked = cand[100 * overlap >= percent * (ns[x] + ns[cand] - overlap)]
            if len(linked):
                free[linked] = False
                left, gone = left - len(linked), gone + len(linked)
                forest += [(int(y), seed) for y in linked]
                queue += linked.tolist()
    return forest


def _multiply(percent: int):
    """Stream of rows sorted by block: links of each block."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def solve(held):
        t = pa.Table.from_batches(held)
        fps, first = np.unique(t.column("fp").to_numpy(), return_index=True)
        blocks = t.column("block").to_numpy()
        pairs = []
        del fps, first
        for _, s, e in zip(*B.splits(blocks), strict=True):
            part = t.slice(s, e - s)
            fp, at = np.unique(part.column("fp").to_numpy(), return_index=True)
            if len(fp) < 2:
                continue
            raw = part.column("tokens").to_pylist()
            tokens = [np.frombuffer(raw[i], U64) for i in at]
            counts = np.array([len(x) for x in tokens])
            n = part.column("n").to_numpy()[at]
            lead = part.column("lead").to_numpy()[at]
            pairs += [(fp[a], fp[b]) for a, b in link_forest(fp, n, counts, np.concatenate(tokens), percent, lead)]
        src, dst = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                last = held[-1].column("block")[-1].as_py() if held else None
                blocks = batch.column("block").to_numpy()
                # rows of the block at hand come first; a full buffer ends where a block ends
                edge = int(np.searchsorted(blocks, last, "right")) if last is not None else 0
                if size >= BLOCK_ENTRIES * 8 and edge < batch.num_rows:
                    if edge:
                        held.append(batch.slice(0, edge))
                    yield solve(held)
                    held, size, batch = [], 0, batch.slice(edge)
                    continue
                held.append(batch)
                size += batch.column("tokens").nbytes
                break
        if held:
            yield solve(held)

    return run


def shingle_links(docs: DataFrame, k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """``(members, forest)``: members has a row (id, n, fp) for each row of
    ``docs(id, text)``; forest links fingerprints (src, dst) whose sets reach the
    threshold, with as few links as their components need."""
    spark = docs.sparkSession
    members = docs.mapInArrow(_members(k), "id long, n long, fp long")
    count = B.bucket_count(docs.rdd.getNumPartitions())
    bits = count.bit_length() - 1
    pieces = docs.select("text").mapInArrow(_column_pieces(k, bits), "bucket int, fps binary, ns binary, counts binary, hashes binary")
    shared = pieces.groupBy("bucket").applyInArrow(_count_columns(bits), "part int, fps binary, ns binary, counts binary, hashes binary, dfs binary")
    sets = cut(shared.groupBy("part").applyInArrow(_gather_rows(percent), "fp long, n long, prefix array<long>, tokens binary"))
    entry = sets.select("fp", F.explode("prefix").alias("token"))
    anchor = entry.groupBy("token").agg(F.min("fp").alias("anchor"), F.count("*").alias("c")).where("c > 1")
    coarse = entry.join(anchor, "token").where("fp <> anchor").select(F.col("fp").alias("src"), F.col("anchor").alias("dst")).distinct()
    family = cut(connected_components(coarse))
    rows = family.join(sets.select("fp", "n", F.size("prefix").alias("lead"), "tokens"), family["node"] == sets["fp"]).select("component", "fp", "n", "lead", "tokens")
    size = (
        family.join(sets.select("fp", F.length("tokens").alias("bytes")), family["node"] == F.col("fp"))
        .groupBy("component").agg(F.sum("bytes").alias("bytes"))
        .select("component", F.ceil(F.col("bytes") / (8 * BLOCK_ENTRIES)).cast("int").alias("n_blocks"))
    )
    # row blocks of a large family meet pairwise; a small family is its only block
    dealt = rows.join(size, "component").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.where("n_blocks <= 2 or o <> b or n_blocks = 1").select(
        F.when(F.col("n_blocks") <= 1, F.xxhash64("component"))
        .otherwise(F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o")))
        .alias("block"), "fp", "n", "lead", "tokens",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_multiply(percent), "src long, dst long")
    return members, cut(links)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: (id, n_shingles, component_id).

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct k-word shingles (words: runs without ASCII white space, A-Z lower-cased).
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    members, forest = shingle_links(plain, k, percent)
    members = cut(members)
    by_set = members.where("n > 0").groupBy("fp").agg(F.min("id").alias("least_id"))
    joined = connected_components(forest)
    named = by_set.join(joined, by_set["fp"] == joined["node"], "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    best = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = named.join(best, "component").select(F.col("fp").alias("set_fp"), "component_id")
    out = members.join(label, (members["fp"] == label["set_fp"]) & (members["n"] > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
