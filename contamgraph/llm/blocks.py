"""Vectorised text blocks.

A block is a run of whole documents as one UTF-8 buffer with offsets.  Words,
word hashes and rolling hashes are computed over the buffer with NumPy, so a
Python worker touches every byte a fixed number of times and never loops over
words.  A block holds about ``limit`` bytes (one longer document makes a block
of its own), which bounds the memory of a worker.

Word and window hashes are 64 bits wide and independent of the process.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 17

_base = 0x9E3779B97F4A7C15 | 5  # odd: invertible modulo 2**64
_inverse = pow(_base, -1, 1 << 64)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_BYTE_LOWER = _BYTE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base, and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 4096)
        a, b = np.full(size, U64(_base)), np.full(size, U64(_inverse))
        a[0] = b[0] = 1
        _powers, _inverses = np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64)
    return _powers[:n], _inverses[:n]


def rolling(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(table[buf] * powers(len(buf))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in [start, end), the same wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: (hash, document, start)."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.astype(U64), empty, empty
    inside = ~IS_SPACE[buf]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return range_hash(rolling(buf, lower=True), starts, ends), doc, starts


def word_windows(buf: np.ndarray, offs: np.ndarray, edge: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each run of ``words`` whole words inside a document.

    ``edge`` tells whether a document's first byte can start a word.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    inside = ~IS_SPACE[buf]
    some = offs[:-1] < offs[1:]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offs[:-1][some]] = edge[some]
    last[:-1] = ~inside[1:]
    last[offs[1:][some] - 1] = True
    start, end = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    to = np.searchsorted(end, start, "right") + words - 1
    start, to = start[to < len(end)], to[to < len(end)]
    end = end[to]
    doc = np.searchsorted(offs, start, "right") - 1
    own = end <= offs[doc + 1]
    return start[own], end[own], doc[own]


def shingle_sets(word: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, sorted by (document, hash): (document, hash).

    A document with fewer words has its whole sequence as its only shingle.
    """
    n = len(word)
    mult = mix(np.arange(11, 11 + k, dtype=U64)) | U64(1)
    parts_d, parts_h = [], []
    if n >= k:
        whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        h = np.zeros(len(whole), U64)
        for j in range(k):
            h += word[whole + j] * mult[j]
        parts_d.append(doc[whole])
        parts_h.append(mix(h))
    count = np.bincount(doc, minlength=n_docs) if n else np.zeros(n_docs, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(count)))[short]
        h = np.full(len(short), U64(0xA0761D6478BD642F))
        for j in range(k - 1):
            has = count[short] > j
            h[has] += word[begin[has] + j] * mult[j]
        parts_d.append(short)
        parts_h.append(mix(h + count[short].astype(U64)))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    d, h = np.concatenate(parts_d), np.concatenate(parts_h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - counts), counts)


def pack48(x: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(U64, copy=False)


def splits(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a sorted array: (key, begin, end)."""
    if not len(sorted_keys):
        z = np.zeros(0, np.int64)
        return sorted_keys, z, z
    begin = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    end = np.append(begin[1:], len(sorted_keys))
    return sorted_keys[begin], begin, end


def bucket_count(partitions: int, at_least: int = 16) -> int:
    """Power of two that grows with the number of input partitions."""
    return 1 << max(at_least.bit_length() - 1, (2 * max(1, partitions) - 1).bit_length())


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
