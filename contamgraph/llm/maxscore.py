"""Exact top-k inner products by MaxScore.

Components are the terms.  Within a shard, a query's term d adds between its least
and greatest ``q_d * x_d``; the differences are the score bounds.  Terms are taken
by falling bound: the *essential* ones are as many as are needed for the bounds of
the rest, added up, to stay below the current k-th best score.  Their postings
(the shard's columns) are traversed for all vectors; a vector is probed in the
other terms only while its score so far and the bounds left still reach the k-th best.
Each block of a shard raises the threshold for the next; the shards' lists are
merged by (score, smaller id).

Shards are packed once and stay where they are.  Queries, a stated part of the rows,
are packed too and go to all shards in groups of at most ``GROUP_BYTES``, by broadcast;
each further group is one more pass over the shards.  The first shard is searched
before the others, and its k-th best scores are the thresholds that all start from.

Every row takes part with the integers ``floor(scale * x)``, exactly: sums that
may leave the exact range of a double are taken in arbitrary precision (and held
to the range of a long).  Vectors that are null, empty, or hold null or non-finite
components, and rows without an id, take no part.  Vectors of unequal lengths are
filled up with zeros.  A repeated id is one candidate for each of its rows, and its rows
are separate queries only if their vectors differ; no query meets its own id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B
from contamgraph.plans.lineage import cut

SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Bytes of queries that are broadcast at a time.
GROUP_BYTES = 64 << 20
_BLOCK = 2048
_PACKED = pa.schema([("part", pa.string()), ("ids", pa.binary()), ("values", pa.binary()), ("dims", pa.int32())])
_PACKED_DDL = "part string, ids binary, values binary, dims int"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(tag: str, rows: int):
    """Rows of a task to blocks of ids and float64 matrices."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{tag}{task.partitionId() if task else 0}"
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vec = part.column(part.schema.get_field_index("v")).to_pylist()
                dims = max(map(len, vec))
                m = np.zeros((len(vec), dims))
                for i, x in enumerate(vec):
                    m[i, : len(x)] = x
                ids = part.column(part.schema.get_field_index("id")).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{name}-{number}"]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([dims], pa.int32())],
                    schema=_PACKED,
                )
                number += 1

    return run


def top_of_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floors: list[int | None] | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's best k in this shard.

    With ``floors``, scores below a query's floor may be left out.
    """
    dims = max(queries.shape[1], vectors.shape[1])
    fill = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    queries, vectors = fill(queries), fill(vectors)
    order = np.argsort(ids, kind="stable")  # ties go to smaller ids
    ids, vectors = ids[order], vectors[order]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dims
    exact = top < 2**52
    columns = np.ascontiguousarray(vectors.T)
    if not exact:
        columns, queries = (np.frompyfunc(int, 1, 1)(m) for m in (columns, queries))
    low, high = columns.min(1), columns.max(1)
    out = []
    for q, own, floor in zip(queries, query_ids.tolist(), floors or [None] * len(queries), strict=True):
        least, most = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
        bound, base = most - least, least.sum()
        by = np.argsort(-bound.astype(float), kind="stable")
        rest = np.concatenate((np.cumsum(bound[by][::-1])[::-1], [0]))  # bounds of the terms from i on
        best_s: list = []
        best_i: list = []
        for at in range(0, len(ids), _BLOCK):
            end = min(at + _BLOCK, len(ids))
            need = max((x - base for x in (floor, best_s[k - 1] if len(best_s) >= k else None) if x is not None), default=None)
            # essential: up to where the remaining bounds alone cannot reach the threshold
            essential = dims if need is None else int(np.flatnonzero(rest < need)[0]) if (rest < need).any() else dims
            score = np.zeros(end - at, columns.dtype)
            for d in by[:essential]:
                score = score + (q[d] * columns[d, at:end] - least[d])
            cand = np.arange(at, end)
            for i in range(essential, dims + 1):
                if need is not None and (i == essential or i % 4 == 0 or i == dims):
                    keep = score + rest[i] >= need
                    if not keep.all():
                        cand, score = cand[keep], score[keep]
                if i == dims or not len(cand):
                    break
                d = by[i]
                score = score + (q[d] * columns[d, cand] - least[d])
            other = ids[cand] != own
            cand, score = cand[other], score[other]
            if not len(cand):
                continue
            s = np.concatenate((np.array(best_s, columns.dtype), score + base))
            j = np.concatenate((np.array(best_i, np.int64), cand))
            if exact:
                pick = np.lexsort((j, -s))[:k]
            else:
                pick = np.array(sorted(range(len(s)), key=lambda x: (-s[x], j[x]))[:k], np.int64)
            best_s, best_i = list(s[pick]), j[pick].tolist()
        clip = lambda x: max(-(2**63), min(2**63 - 1, int(x)))
        out += [(own, int(ids[i]), clip(s)) for s, i in zip(best_s, best_i, strict=True)]
    return out


def _matrix(raw, dims: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, dims)


def _search(k: int, group):
    """Best rows of each shard for a broadcast group of (ids, values, dims, floors)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, vectors = np.frombuffer(r["ids"], np.int64), _matrix(r["values"], r["dims"])
                for q_ids, q_values, q_dims, floors in group.value:
                    hits = top_of_shard(_matrix(q_values, q_dims), np.frombuffer(q_ids, np.int64), vectors, ids, k, floors)
                    cols = list(zip(*hits, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_HITS)

    return run


_ASKED = pa.schema([*_PACKED, ("floors", pa.list_(pa.int64()))])


def _floors(k: int, first):
    """Query blocks with the k-th best score of each query in the broadcast first shard (null, if it has fewer)."""

    def run(batches):
        ids, vectors = first.value
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                asked, values = np.frombuffer(r["ids"], np.int64), _matrix(r["values"], r["dims"])
                floors = []
                for j in range(len(asked)):  # one by one: a repeated id may have several vectors
                    best = top_of_shard(values[j : j + 1], asked[j : j + 1], vectors, ids, k)
                    floors.append(best[k - 1][2] if len(best) >= k else None)
                yield B.table({c: [r[c]] for c in _PACKED.names} | {"floors": [floors]}, _ASKED)

    return run


def _groups(blocks: DataFrame):
    """Query blocks in groups of at most ``GROUP_BYTES`` (or one block)."""
    held, size = [], 0
    for r in blocks.toLocalIterator():
        values = bytes(r["values"])
        if held and size + len(values) > GROUP_BYTES:
            yield held
            held, size = [], 0
        held.append((bytes(r["ids"]), values, r["dims"], list(r["floors"])))
        size += len(values)
    if held:
        yield held


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite)
        .select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))
    )
    n = rows.count()
    place = F.xxhash64("id", "v")
    shards = cut(rows.repartition(max(1, -(-n // SHARD_ROWS)), place).mapInArrow(_pack("s", SHARD_ROWS), _PACKED_DDL))
    asks = rows.where(F.pmod("id", F.lit(every)) == 0).distinct()
    seed = shards.limit(1).collect()
    hits = None
    if seed:
        first = spark.sparkContext.broadcast((np.frombuffer(bytes(seed[0]["ids"]), np.int64), _matrix(bytes(seed[0]["values"]), seed[0]["dims"])))
        packed = asks.repartition(max(1, -(-n // every // QUERY_ROWS)), place).mapInArrow(_pack("q", QUERY_ROWS), _PACKED_DDL)
        for group in _groups(cut(packed.mapInArrow(_floors(k, first), f"{_PACKED_DDL}, floors array<long>"))):
            found = shards.mapInArrow(_search(k, spark.sparkContext.broadcast(group)), "query_id long, vec_id long, score long")
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias("vec_id"), "score")
