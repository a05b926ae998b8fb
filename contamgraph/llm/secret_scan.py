"""Secret scan: known patterns, and strings that a tokenizer finds hard to shorten.

Three patterns give the base spans (``assign``, ``access``, ``hex``), leftmost and
non-overlapping for each kind.  The token-efficiency test adds ``random`` spans: a run of
at least ``min_length`` key characters is taken for a random string when a byte-pair
vocabulary spends a token on fewer than ``max_ratio`` characters of it.  Words and
identifiers of any language compress better; what may not is excluded by shape:
hexadecimal digests of the usual lengths, subresource-integrity digests, UUIDs,
runs of few different characters, and identifiers whose parts (between ``/ _ = + -``)
are each letters only or digits only, if the letter parts compress like words, are
single lower-case tokens, or are under ``FEW_LETTERS`` letters together.  A run of one case is read in lower case, too.
A shorter run is random if a part of it with ``SHORT`` characters or more mixes digits
into letters or changes case often and compresses below ``SHORT_RATIO``; hexadecimal
ones are not.  Shorter keys and keys of digits only look like other
numbers and words, and are found by the base patterns alone.  A run that
overlaps a base span adds nothing.

Offsets are code points, ends exclusive.  Null text is empty and has no spans.
Rows may repeat, ids may be null, other columns are ignored; long texts are
searched whole.  Byte classes are counted over whole blocks first, so regular
expressions run only over texts that hold a long enough run.
"""
from __future__ import annotations

import base64
import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B

#: The base patterns, and what their matches must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("passw", "secret", "token", "api")

SHORT, SHORT_RATIO = 12, 1.8
FEW_LETTERS, FEW_KINDS = 8, 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-fA-F]+")
_INTEGRITY = re.compile(r"sha(1|256|384|512)[-=]", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[/_=+-]+")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True
_IS_KEY = np.zeros(256, bool)
_IS_KEY[48:58] = _IS_KEY[65:91] = _IS_KEY[97:123] = True
_IS_KEY[[ord(c) for c in "+/_=-"]] = True

SPANS = "array<struct<kind:string,start:int,end:int>>"


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _ratio(parts: list[str], vocabulary: str) -> float:
    """Characters a token; text of one case as it is or in lower case."""
    encode = _encoding(vocabulary).encode_ordinary
    tokens = 0
    for p in parts:
        n = len(encode(p))
        tokens += min(n, len(encode(p.lower()))) if p[1:].isupper() else n
    return sum(map(len, parts)) / max(tokens, 1)


def _excluded(s: str) -> bool:
    """Digests by their shape."""
    if _DIGEST.fullmatch(s) and len(s) in DIGEST_LENGTHS:
        return True
    return bool(_INTEGRITY.match(s) or _UUID.search(s))


def _identifier(s: str, vocabulary: str, max_ratio: float) -> bool:
    """Parts of letters and parts of digits, where the letters are words."""
    parts = [p for p in _PARTS.split(s) if p]
    if not all(p.isalpha() or p.isdigit() for p in parts):
        return False
    letters = [p for p in parts if p.isalpha()]
    if all(p[1:].islower() and len(_encoding(vocabulary).encode_ordinary(p)) == 1 for p in letters):
        return True  # words or codes of the vocabulary
    return sum(map(len, letters)) < FEW_LETTERS or len(set("".join(parts))) < FEW_KINDS or _ratio(letters, vocabulary) >= max_ratio


def _changes(s: str) -> int:
    """Changes of case between neighbouring letters."""
    return sum(a.isupper() != b.isupper() for a, b in zip(s, s[1:], strict=False) if a.isalpha() and b.isalpha())


def _short_random(s: str, vocabulary: str, max_ratio: float) -> bool:
    for p in _PARTS.split(s):
        if len(p) < SHORT or _DIGEST.fullmatch(p):
            continue
        digits, letters = sum(c.isdigit() for c in p), sum(c.isalpha() for c in p)
        if (letters >= 4 and digits >= 2 or _changes(p) >= 4) and _ratio([p], vocabulary) < min(max_ratio, SHORT_RATIO):
            return True
    return False


def _random(s: str, vocabulary: str, min_length: int, max_ratio: float) -> bool:
    if _excluded(s):
        return False
    if len(s) < min_length:
        return _short_random(s, vocabulary, max_ratio)
    return not _identifier(s, vocabulary, max_ratio) and _ratio([s], vocabulary) < max_ratio


def spans_of(text: str, vocabulary: str, min_length: int = 20, max_ratio: float = 2.2, long_hex: bool = True, long_key: bool = True) -> list[tuple[int, int, int]]:
    """Spans as (start, kind number, end), sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if long_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    if long_key:
        base: list[list[int]] = []  # disjoint, so their ends rise with their starts
        for s, _, e in sorted(out):
            if base and s < base[-1][1]:
                base[-1][1] = max(base[-1][1], e)
            else:
                base.append([s, e])
        ends = [e for _, e in base]
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            if e - s < min(min_length, SHORT):
                continue
            near = bisect.bisect_right(ends, s)  # the first base span that ends after the run starts
            if near < len(base) and base[near][0] < e:
                continue
            value = m[0].strip("=-_/+")
            if len(value) >= min(min_length, SHORT) and _random(value, vocabulary, min_length, max_ratio):
                out.append((s, 3, e))
    return sorted(out)


def _has_run(member: np.ndarray, offs: np.ndarray, at_least: int) -> np.ndarray:
    """Documents that hold a run of at_least bytes of a class."""
    n = len(member)
    edge = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1]))) if n else np.zeros(0, np.int64)
    end = np.append(edge[1:], n)
    long = edge[member[edge] & (end - edge >= at_least)] if n else edge
    stop = end[member[edge] & (end - edge >= at_least)] if n else edge
    out = np.zeros(len(offs) - 1, bool)
    if len(long):  # a run may reach over documents; each that it touches is looked at
        first, last = np.searchsorted(offs, long, "right") - 1, np.searchsorted(offs, stop - 1, "right") - 1
        out[B.ranges(first, last - first + 1)] = True
    return out


def _scan(vocabulary: str, min_length: int, max_ratio: float):
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("scan_text"))
            for at, end, buf, offs in B.blocks(column):
                long_hex = _has_run(_IS_HEX[buf], offs, MIN_HEX)
                long_key = _has_run(_IS_KEY[buf], offs, min(min_length, SHORT))
                found = []
                for i, text in enumerate(column.slice(at, end - at).to_pylist()):
                    spans = spans_of(text or "", vocabulary, min_length, max_ratio, bool(long_hex[i]), bool(long_key[i]))
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                rest = batch.slice(at, end - at)
                arrays = [rest.column(i) for i in range(rest.num_columns) if rest.schema.names[i] != "scan_text"]
                names = [x for x in rest.schema.names if x != "scan_text"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, struct)], names=[*names, "secret_spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, min_length: int = 20, max_ratio: float = 2.2) -> DataFrame:
    """(id, secret_spans) for every row of ``docs``."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("scan_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scan(vocabulary or default_vocabulary(), min_length, max_ratio), f"`{id_col}` {kind}, secret_spans {SPANS}")


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the given kinds, comma-joined in their order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None, min_length: int = 20, max_ratio: float = 2.2) -> DataFrame:
    """``docs`` with each secret span of the text replaced by ``mark``; all columns are kept.

    Overlapping spans are one.  Null text stays null.
    """
    path = vocabulary or default_vocabulary()
    names = docs.columns

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            column = batch.column(place)
            out = column.to_pylist()
            for at, _, buf, offs in B.blocks(column):
                long_hex = _has_run(_IS_HEX[buf], offs, MIN_HEX)
                long_key = _has_run(_IS_KEY[buf], offs, min(min_length, SHORT))
                for i in range(len(offs) - 1):
                    text = out[at + i]
                    if text:
                        spans = spans_of(text, path, min_length, max_ratio, bool(long_hex[i]), bool(long_key[i]))
                        if spans:
                            out[at + i] = _masked(text, spans, mark)
            arrays = [pa.array(out, column.type) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.select(*names).mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]
