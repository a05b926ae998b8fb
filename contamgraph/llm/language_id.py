"""Language identification by multilingual mixture inference.

Each language has a distribution over character trigrams (bytes of the folded
text, hashed to ``2**16`` cells), counted over all labelled training rows.  A
document is a mixture: every word was written in one of its languages, and
expectation-maximisation, run until no proportion moves by ``TOLERANCE``, estimates
the proportions from the words' trigram likelihoods.  Starting from the language
with the largest proportion, the next largest one joins the document's set while
the set's own likelihood less ``penalty * languages * log(words)`` rises; sets may
grow to all learned languages.  The prediction is the language with the largest
proportion in the set, its score the proportion.

``keep_identified`` also holds each text against a background without a language,
in which all trigram cells are equally likely: a text whose languages explain a
trigram worse than that, by more than ``margin`` nats, is in none of them.

The model is ``languages * 2**16`` numbers, whatever the corpus: tasks emit their
non-zero counts, which are summed by (language, cell) with a map-side combine.

Null texts and texts without a letter are ``und`` with score 0, as is every text
when no training row has a language.  Ties go to the language that sorts first.
Ids are integers, may be null or repeat; other columns are neither read nor needed.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contamgraph.llm import blocks as B

CELLS = 1 << 16
SMOOTH = 0.5
UNKNOWN = "und"
#: Proportions that move by less have converged.
TOLERANCE = 1e-3

_FOLD = np.full(256, 32, np.uint8)  # everything that is no letter byte is a boundary
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigram_cells(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around letter bytes: (cell, word number, document of each word)."""
    low = _FOLD[buf]
    if len(buf) > 1:  # upper-case Latin-1 letters in UTF-8
        upper = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][upper] += 0x20
    n = len(low)
    letter = low != 32
    edge = np.zeros(n + 1, bool)
    edge[offs[:-1]] = True
    begin = np.empty(n, bool)
    begin[:1] = True
    begin[1:] = ~letter[:-1]
    begin |= edge[:n]
    end = np.empty(n, bool)
    end[n - 1 :] = True
    end[:-1] = ~letter[1:] | edge[1:n]
    at = np.flatnonzero(letter)
    code = low[at].astype(np.uint32) << np.uint32(8)
    left, right = ~begin[at], ~end[at]
    code[left] |= low[at[left] - 1].astype(np.uint32) << np.uint32(16)
    code[~left] |= np.uint32(32 << 16)
    code[right] |= low[at[right] + 1]
    code[~right] |= np.uint32(32)
    cell = (code * np.uint32(2654435761)) >> np.uint32(16)
    word = np.cumsum(begin[at]) - 1
    first = np.flatnonzero(begin[at])
    doc = np.searchsorted(offs, at[first], "right") - 1
    return cell, word, doc


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    row: dict[str, int] = {}
    total = np.zeros(0, np.int64)
    for batch in batches:
        lang, text = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "text"))
        for at, end, buf, offs in B.blocks(text):
            number = np.array([row.setdefault(x, len(row)) for x in lang.slice(at, end - at).to_pylist()])
            if len(total) < len(row) * CELLS:
                total = np.concatenate((total, np.zeros(len(row) * CELLS - len(total), np.int64)))
            if len(buf):
                cell, word, doc = trigram_cells(buf, offs)
                np.add.at(total, number[doc][word] * CELLS + cell, 1)
    total = total.reshape(-1, CELLS)
    used = [np.union1d(np.flatnonzero(x), [0]) for x in total]  # cell 0 names languages without a trigram, too
    yield B.table({"lang": list(row), "cells": used, "counts": [x[i] for x, i in zip(total, used, strict=True)]}, schema)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (cells x languages) from every row that has a language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(_count, "lang string, cells array<int>, counts array<long>").select("lang", F.posexplode("cells").alias("i", "cell"), "counts")
    model = counted.groupBy("lang", "cell").agg(F.sum(F.element_at("counts", F.col("i") + 1)).alias("n")).toArrow()  # languages x 2**16 rows at most
    langs = model.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {x: j for j, x in enumerate(names)}
    counts = np.zeros((CELLS, len(names)))
    counts[model.column("cell").to_numpy(), np.array([place[x] for x in langs], np.int64)] = model.column("n").to_numpy()
    return names, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * CELLS)).astype(np.float32)


class Words:
    """Likelihoods of the words of some documents, relative to each word's best language."""

    def __init__(self, like: np.ndarray, count: np.ndarray):
        self.like, self.count = like, count
        self.start = np.cumsum(count) - count

    def of(self, docs: np.ndarray) -> Words:
        return Words(self.like[B.ranges(self.start[docs], self.count[docs])], self.count[docs])

    def step(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round of expectation-maximisation: new proportions, log-likelihood of the old ones."""
        joint = self.like * np.repeat(share, self.count, axis=0)
        total = np.maximum(joint.sum(1), 1e-30)
        joint /= total[:, None]
        new = np.add.reduceat(joint, self.start, axis=0) / self.count[:, None]
        return new.astype(np.float32), np.add.reduceat(np.log(total), self.start, dtype=np.float64)

    def fit(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions at convergence and their log-likelihoods; documents leave as they converge."""
        share, log = share.copy(), np.zeros(len(share))
        todo, own = np.arange(len(share)), self
        while len(todo):
            new, log[todo] = own.step(share[todo])
            moves = np.abs(new - share[todo]).max(1) >= TOLERANCE
            share[todo] = new
            if not moves.all():
                own, todo = own.of(np.flatnonzero(moves)), todo[moves]
        return share, log


def mixtures(cell: np.ndarray, word: np.ndarray, doc: np.ndarray, n_docs: int, table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Under each document's best language set: proportions (documents x languages),
    and log-likelihood a trigram."""
    n_langs = table.shape[1]
    out, level = np.zeros((n_docs, n_langs), np.float32), np.zeros(n_docs)
    if not len(cell) or not n_langs:
        return out, level
    word_start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    score = np.stack([np.add.reduceat(table[:, j][cell], word_start) for j in range(n_langs)], 1)
    top = score.max(1)
    has, start, end = B.splits(doc)
    words = Words(np.exp(score - top[:, None]), end - start)
    share, _ = words.fit(np.full((len(has), n_langs), 1 / n_langs, np.float32))
    rank = np.argsort(-share, axis=1, kind="stable")
    cost = penalty * np.log(words.count + 1.0)
    # one language: the likelihood is known without fitting
    best = np.zeros_like(share)
    np.put_along_axis(best, rank[:, :1], 1, axis=1)
    _, best_log = words.step(best)
    best_value = best_log - cost
    todo, own = np.arange(len(has)), words
    for m in range(2, n_langs + 1):
        mask = np.zeros((len(todo), n_langs), np.float32)
        np.put_along_axis(mask, rank[todo, :m], 1, axis=1)
        part = share[todo] * mask + mask * 1e-6
        part, log = own.fit(part / part.sum(1, keepdims=True))
        value = log - m * cost[todo]
        better = value > best_value[todo]
        todo, own = todo[better], own.of(np.flatnonzero(better))
        if not len(todo):
            break
        best[todo], best_log[todo], best_value[todo] = part[better], log[better], value[better]
    out[has] = best
    n_cells = np.diff(np.append(word_start, len(cell)))
    level[has] = (best_log + np.add.reduceat(top, start, dtype=np.float64)) / np.add.reduceat(n_cells, start)
    return out, level


def _judge(text: pa.Array, at: int, buf: np.ndarray, offs: np.ndarray, names: list[str], table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, whether a language is known, log-likelihood a trigram) of a block's documents."""
    m = len(offs) - 1
    share, level = np.zeros((m, len(names)), np.float32), np.zeros(m)
    if len(buf) and names:
        share, level = mixtures(*trigram_cells(buf, offs), m, table, penalty)
    letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
    letter = letters[offs[1:]] > letters[offs[:-1]]
    for i in np.flatnonzero(~letter).tolist():
        value = text[at + i].as_py()
        letter[i] = value is not None and any(c.isalpha() for c in value)
    return share, letter & (share.sum(1) > 0), level


def _predict(names: list[str], table: np.ndarray, penalty: float):
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            ids, held, text = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "held_out", "text"))
            for at, end, buf, offs in B.blocks(text):
                m = end - at
                share, known, _ = _judge(text, at, buf, offs, names, table, penalty)
                top = share.argmax(1) if names else np.zeros(m, int)
                yield B.table(
                    {
                        "id": ids.slice(at, m).to_pylist(), "held_out": held.slice(at, m).to_pylist(),
                        "lang_pred": [names[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)],
                        "score": [min(1.0, float(share[i, t])) if known[i] else 0.0 for i, t in enumerate(top)],
                        "langs": [[names[j] for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0.01] if known[i] else [] for i in range(m)],
                    },
                    schema,
                )

    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 2.0) -> DataFrame:
    """(id, held_out, lang_pred, score, langs) for every row; learns from rows not held out."""
    held = F.coalesce(held_out, F.lit(True))
    names, table = fit(docs.where(~held), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predict(names, table, penalty), "id long, held_out boolean, lang_pred string, score double, langs array<string>")
    return out.withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.25,
    languages: tuple[str, ...] | None = None, penalty: float = 2.0, margin: float = 0.5, write_lang: bool = False,
) -> DataFrame:
    """The rows of ``docs`` in a known language (one of ``languages``, if given): its proportion
    is ``least_score`` or more, and the text's languages explain a trigram better than chance
    less ``margin``.  All columns are kept; with ``write_lang``, ``lang_col`` holds the prediction."""
    names, table = fit(docs.where(~F.coalesce(held_out, F.lit(True))), text_col, lang_col)
    wanted = np.array([languages is None or x in languages for x in names], bool)
    background = -np.log(CELLS) - margin

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            keep, top = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for at, end, buf, offs in B.blocks(text):
                share, known, level = _judge(text, at, buf, offs, names, table, penalty)
                if names:
                    top[at:end] = share.argmax(1)
                    keep[at:end] = known & (share.max(1) >= least_score) & (level >= background) & wanted[top[at:end]]
            if write_lang and names:
                place = batch.schema.get_field_index(lang_col)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(names).take(pa.array(top)).cast(batch.schema.field(place).type))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
