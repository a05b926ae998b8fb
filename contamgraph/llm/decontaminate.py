"""Benchmark decontamination by template canonicalisation.

Text becomes a sequence of tokens (runs of letters, or of digits with inner points
and commas).  Numbers, units after numbers, and names are replaced by typed
placeholders, so a question asked again with other numbers, names or units has the
same template.  A capitalised word may be a name or only begin a sentence, so both
sides are read in three ways: names are capitalised words inside a sentence; names
are all capitalised words but the function words in ``COMMON``, whatever stands
before; or every token is literal, so a copy always joins.  Windows of ``window``
template tokens are hashed; document windows are joined with benchmark windows of
the same reading by hash, and matches are gathered by (document, item, distance of
their positions).

A document leaks an item when its matched windows cover at least ``coverage`` of
the item's tokens, and the aligned placeholder values are *consistent*: an item
value always meets the same document value, and two item values of a type never
meet the same one, in at least ``consistency`` of the aligned slots.  Each distance
is judged by itself, then all together with the longest first (a copy with words put
in has several); each reading is, too, and the match that covers most is told.  A run
of ``VERBATIM`` tokens copied word for word leaks the item whatever its share.  Windows made of
placeholders alone match nothing.  An item shorter than a window is one window
if it has at least ``shortest`` tokens; shorter items match nothing.

The benchmark is dealt into chunks of about ``chunk_tokens`` tokens in all readings
(a size that is counted first); each chunk's window table travels to every task, and a larger
benchmark means more passes over the documents and no larger table.  Documents are
read whole and need no shuffle.

Null and empty texts have no windows.  Ids of documents and items are integers; rows may repeat, ids may be null; other
columns are ignored.  An empty benchmark leaks nowhere.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B

U64 = np.uint64
#: Units that may follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons "
    "ml cl dl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent dollar dollars cent cents euro euros usd eur gbp kmh mph hz khz mhz ghz kb mb gb tb v w kw j kj cal kcal pa k c f degree degrees"
).split()
#: Words that are no names where a sentence begins with them.
COMMON = (
    "a an the this that these those it its he she they we you i his her their our my your there here what which who whom whose when where why how "
    "if in on at by for from to of with without and or but so as is are was were do does did can could will would should may might must has have had "
    "after before during while because since then than not no yes all each every some any one two three many much more most given find let suppose "
    "le la les un une des du de et ou mais que qui quand comment pourquoi dans sur avec pour par il elle ils elles nous vous je tu ce cette ces si est sont "
    "der die das ein eine einer einem und oder aber wenn wann wer was wie wo warum in im am auf mit von zu bei nach aus ist sind es er sie wir ihr ich "
    "el los las una unos unas y o pero cuando donde como cual quien por para con sin en del al es son se su sus lo mi"
).split()
NUMBER, NAME, UNIT = (U64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))
_TYPES = np.array([NUMBER, NAME, UNIT], U64)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;|\n\r\"'()[]{}#*$%&"]] = True


def _literal_hash(texts: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in texts])
    return B.range_hash(B.rolling(buf, lower=True), np.concatenate(([0], ends[:-1])), ends)


_UNIT_HASHES = np.sort(_literal_hash(UNITS))
_COMMON_HASHES = np.sort(_literal_hash(COMMON))
#: Fixed value: a copied run of so many tokens is a leak by itself.
VERBATIM = 13
#: Number of readings that ``canonical`` gives.
READINGS = 3


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def canonical(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Template tokens of a block in each reading: (template value, literal hash, document)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if not n:
        return [(none.astype(U64), none.astype(U64), none)] * READINGS
    digit, letter = _DIGIT[buf], _LETTER[buf]
    if n > 2:  # points and commas between digits belong to the number
        digit[1:-1] |= ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    kind = digit.astype(np.uint8) + 2 * letter.astype(np.uint8)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = kind[1:] != kind[:-1]
    change |= edge
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(offs, starts, "right") - 1
    literal = B.range_hash(B.rolling(buf, lower=True), starts, ends)
    number = digit[starts]
    same = np.concatenate(([False], doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, bool)
    stops = np.concatenate(([0], np.cumsum(_STOP[buf])))
    inside = same.copy()  # in the same sentence as the token before
    if len(starts) > 1:
        inside[1:] &= stops[starts[1:]] == stops[ends[:-1]]
    first = buf[starts]
    second = buf[np.minimum(starts + 1, n - 1)]
    capital = (first >= 65) & (first <= 90) & (ends - starts > 1) & ~((second >= 65) & (second <= 90))
    after_number = np.concatenate(([False], number[:-1])) & same if len(number) else number
    unit = ~number & after_number & _member(literal, _UNIT_HASHES)
    out = []
    for name in (capital & inside & ~number, capital & ~number & ~_member(literal, _COMMON_HASHES)):
        template = literal.copy()
        template[name], template[unit], template[number] = NAME, UNIT, NUMBER
        # a name of several words is one slot
        again = np.zeros(len(name), bool)
        again[1:] = name[1:] & name[:-1] & inside[1:]
        keep = ~again
        out.append((template[keep], literal[keep], doc[keep]))
    return [*out, (literal, literal, doc)]


def windows(template: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each full window inside one document: (first token, hash); all-slot windows are left out."""
    n = len(template)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    mult = B.mix(np.arange(101, 101 + width, dtype=U64)) | U64(1)
    h = np.zeros(len(at), U64)
    for j in range(width):
        h += B.mix(template[at + j]) * mult[j]
    slots = np.concatenate(([0], np.cumsum(np.isin(template, _TYPES))))
    some = slots[at + width] - slots[at] < width
    return at[some], B.mix(h[some])


@dataclass
class Reading:
    """Window table of some benchmark items in one reading, sorted by hash."""

    template: np.ndarray
    literal: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width: hash, item number, position


@dataclass
class Chunk:
    """Some benchmark items in all readings."""

    items: list
    readings: list[Reading]


def compile_chunk(rows: list[tuple], window: int, shortest: int) -> Chunk:
    """Benchmark rows (item_id, text) to window tables."""
    column = pa.array([t for _, t in rows], pa.string())
    parts = [[(t, x, d + at) for t, x, d in canonical(buf, offs)] for at, end, buf, offs in B.blocks(column)]
    none = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64)
    readings = []
    for r in range(READINGS):
        template, literal, doc = (np.concatenate(x) for x in zip(*(p[r] for p in parts), strict=True)) if parts else none
        readings.append(_compile(template, literal, doc, len(rows), window, shortest))
    return Chunk([i for i, _ in rows], readings)


def _compile(template: np.ndarray, literal: np.ndarray, doc: np.ndarray, n_items: int, window: int, shortest: int) -> Reading:
    length = np.bincount(doc, minlength=n_items)
    begin = np.cumsum(length) - length
    tables = {}
    for width in sorted({window} | {int(x) for x in length if shortest <= x < window}):
        own = np.isin(doc, np.flatnonzero(length >= window if width == window else length == width))
        index = np.flatnonzero(own)
        at, h = windows(template[index], doc[index], width)
        at = index[at]
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        tables[width] = h, doc[at], at - begin[doc[at]]
    return Reading(template, literal, begin, length, tables)


_LEAKS = pa.schema([
    ("id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_windows", pa.int64()),
    ("n_slots", pa.int64()), ("slot_consistency", pa.float64()), ("verbatim", pa.bool_()),
])
_LEAKS_DDL = "id long, item_id long, coverage double, n_windows long, n_slots long, slot_consistency double, verbatim boolean"


def _consistent(pairs: list[tuple[int, int, int]]) -> float:
    """Share of aligned slots (type, item value, document value) that agree with a one-to-one renaming."""
    if not pairs:
        return 1.0
    there, back, good = {}, {}, 0
    for kind, a, b in pairs:
        ok = there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a
        good += ok
    return good / len(pairs)


def _leaks_of_block(chunk: Chunk, buf: np.ndarray, offs: np.ndarray, coverage: float, consistency: float):
    """Leaks in a block: (document, item id, coverage, windows, slots, slot consistency, verbatim)."""
    best = {}
    for reading, tokens in zip(chunk.readings, canonical(buf, offs), strict=True):
        for d, i, *found in _leaks_of_reading(reading, *tokens, coverage, consistency):
            if (d, i) not in best or found[0] > best[d, i][0]:
                best[d, i] = found
    return [(d, chunk.items[i], *found) for (d, i), found in sorted(best.items())]


def _leaks_of_reading(own: Reading, template: np.ndarray, literal: np.ndarray, doc: np.ndarray, coverage: float, consistency: float):
    """Leaks of one reading, with item numbers in place of ids."""
    hits = []
    for width, (table, item, place) in own.tables.items():
        pos, h = windows(template, doc, width)
        left = np.searchsorted(table, h, "left")
        some = np.flatnonzero(table[np.minimum(left, len(table) - 1)] == h) if len(table) else np.zeros(0, np.int64)
        if len(some):
            n = np.searchsorted(table, h[some], "right") - left[some]
            entry = B.ranges(left[some], n)
            hits.append((np.repeat(pos[some], n), item[entry], place[entry], np.full(len(entry), width)))
    if not hits:
        return
    pos, item, place, width = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((pos, pos - place, item, doc[pos]))
    pos, item, place, width = pos[order], item[order], place[order], width[order]
    for k, a, b in zip(*B.splits(doc[pos] * len(own.length) + item), strict=True):
        d, i = divmod(int(k), len(own.length))
        gap = pos[a:b] - place[a:b]
        _, s, e = B.splits(gap)
        order = np.argsort(s - e, kind="stable")  # distances with most windows first
        groups = [np.arange(a + s[g], a + e[g]) for g in order]
        best = None
        for j, group in enumerate([*groups, np.concatenate(groups)] if len(groups) > 1 else groups):
            reach = len(group) + int(width[group].max()) - 1  # tokens of a run of these windows
            if j < len(groups) - 1 and reach < VERBATIM and int(width[group].sum()) < coverage * own.length[i]:
                continue
            found = _judge(own, i, pos[group], place[group], width[group], literal, coverage, consistency)
            if found is not None and (best is None or found[0] > best[0]):
                best = found
        if best is not None:
            yield d, i, *best


def _judge(own: Reading, i: int, pos: np.ndarray, place: np.ndarray, width: np.ndarray, literal: np.ndarray, coverage: float, consistency: float):
    """(coverage, windows, slots, slot consistency, verbatim) of an alignment that is a leak, or None."""
    size = int(own.length[i])
    partner = np.full(size, -1, np.int64)
    each = B.ranges(place, width)
    there = B.ranges(pos, width)
    partner[each[::-1]] = there[::-1]  # the first alignment of a token counts
    mine = np.flatnonzero(partner >= 0)
    share = len(mine) / size
    at = own.begin[i] + mine
    x, y = own.literal[at], literal[partner[mine]]
    if share < coverage and _longest_run(mine, partner[mine], x == y) < VERBATIM:
        return None
    slot = np.isin(own.template[at], _TYPES)
    pairs = list(zip(own.template[at][slot].tolist(), x[slot].tolist(), y[slot].tolist(), strict=True))
    agree = _consistent(pairs)
    if agree < consistency and _longest_run(mine, partner[mine], x == y) < VERBATIM:
        return None
    return share, len(pos), len(pairs), agree, bool((x == y).all())


def _longest_run(mine: np.ndarray, there: np.ndarray, same: np.ndarray) -> int:
    """Length of the longest run of tokens that follow each other on both sides and are equal."""
    mine, there = mine[same], there[same]
    if not len(mine):
        return 0
    breaks = np.flatnonzero((np.diff(mine) != 1) | (np.diff(there) != 1))
    return int(np.diff(np.concatenate(([-1], breaks, [len(mine) - 1]))).max())


def _leaks(chunk: Chunk, coverage: float, consistency: float):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for at, _, buf, offs in B.blocks(batch.column(batch.schema.get_field_index("text"))):
                found = [(ids[at + d].as_py(), *rest) for d, *rest in _leaks_of_block(chunk, buf, offs, coverage, consistency)]
                if found:
                    yield B.table(dict(zip(_LEAKS.names, zip(*found, strict=True), strict=True)), _LEAKS)

    return run


def _without(chunk: Chunk, text_col: str, coverage: float, consistency: float):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, _, buf, offs in B.blocks(batch.column(batch.schema.get_field_index(text_col))):
                keep[[at + x[0] for x in _leaks_of_block(chunk, buf, offs, coverage, consistency)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _chunks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, shortest: int, chunk_tokens: int):
    """Window tables of bounded parts of the benchmark, one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    # bytes / 2 bounds the number of tokens
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(READINGS * total / 2 / chunk_tokens))
    for c in range(n_chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks)) == c)
        part = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if part:
            yield compile_chunk(part, window, shortest)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 8, coverage: float = 0.5, consistency: float = 0.8, shortest: int = 4, chunk_tokens: int = 2_000_000,
) -> DataFrame:
    """One row for each (document row, benchmark item) that leaks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], _LEAKS_DDL)
    for chunk in _chunks(benchmark, item_col, item_text_col, window, shortest, chunk_tokens):
        out = out.unionByName(rows.mapInArrow(_leaks(chunk, coverage, consistency), _LEAKS_DDL))
    return out.withColumnRenamed("id", id_col)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 8, coverage: float = 0.5, consistency: float = 0.8, shortest: int = 4, chunk_tokens: int = 2_000_000,
) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    for chunk in _chunks(benchmark, item_col, item_text_col, window, shortest, chunk_tokens):
        docs = docs.mapInArrow(_without(chunk, text_col, coverage, consistency), docs.schema)
    return docs
