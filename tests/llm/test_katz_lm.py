import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contamgraph.llm.katz_lm import CUTOFF, discounts, katz_scores


class Katz:
    """Straightforward model over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, [None] + [Counter() for _ in range(order)]
        for w in texts:
            for n in range(1, order + 1):
                pad = ["<s>"] * (n - 1) + w
                self.c[n].update(tuple(pad[j : j + n]) for j in range(len(w)))
        self.total, self.words = sum(self.c[1].values()), len(self.c[1])
        self.d = [None] + [discounts(np.array([Counter(c.values())[r] for r in range(1, CUTOFF + 2)])) for c in self.c[1:]]
        self.follow = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
        for n in range(2, order + 1):
            for g, k in self.c[n].items():
                self.follow[n][g[:-1]][g[-1]] = k
        self.unknown = 1 - sum(self.cut(1, k) for k in self.c[1].values()) / self.total if self.total else 1.0

    def cut(self, n, k):
        return k * self.d[n][k - 1] if k <= CUTOFF else float(k)

    def kept(self, n, f):
        flat = all(k > CUTOFF for k in f.values())
        return {w: k - 0.5 if flat else self.cut(n, k) for w, k in f.items()}

    def p(self, n, h, w):
        if n == 1:
            k = self.c[1].get((w,), 0)
            return self.cut(1, k) / self.total if k else self.unknown
        f = self.follow[n].get(h)
        if not f:
            return self.p(n - 1, h[1:], w)
        total, kept = sum(f.values()), self.kept(n, f)
        if w in f:
            return kept[w] / total
        return (1 - sum(kept.values()) / total) / (1 - sum(self.p(n - 1, h[1:], x) for x in f)) * self.p(n - 1, h[1:], w)

    def score(self, w):
        pad = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(self.order, tuple(pad[j : j + self.order - 1]), w[j])) for j in range(len(w)))


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\0end"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain_model(docs, prose, order):
    train = F.col("doc_id") % 3 != 0
    model = Katz([tokens(r[1]) for r in prose if r[0] is not None and r[0] % 3], order)
    got = {r["doc_id"]: r for r in katz_scores(docs, train, order=order).collect()}
    assert len(got) == len(prose)
    for i, text, *_ in prose:
        w, r = tokens(text), got[i]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == model.total
        assert r["n_known"] == sum((x,) in model.c[1] for x in w)
        base = sum(math.log10((model.c[1].get((x,), 0) + 1) / (model.total + model.words + 1)) for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(model.score(w), rel=1e-9)


def test_probabilities_sum_to_one(prose):
    model = Katz([tokens(r[1]) for r in prose], 2)
    for h in [(b"the",), (b"river",), ("<s>",), (b"unseen",)]:
        assert sum(model.p(2, h, w) for (w,) in model.c[1]) + model.p(2, h, b"never seen") == pytest.approx(1)


def test_better_than_base_on_repetitive_text(docs):
    r = katz_scores(docs, F.col("doc_id") % 2 == 0).where("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_no_training_rows(docs, prose):
    rows = katz_scores(docs, F.lit(False)).collect()
    assert len(rows) == len(prose)
    assert {r["train_tokens"] for r in rows} == {0} and {r["score"] for r in rows} == {0.0} and {r["n_known"] for r in rows} == {0}


def test_empty_table(no_docs):
    assert katz_scores(no_docs, F.lit(True)).count() == 0


def test_discounts():
    assert np.allclose(discounts(np.array([0, 0, 0, 0, 0, 0])), (np.arange(1, 6) - 0.5) / np.arange(1, 6))
    d = discounts(np.array([1000, 300, 120, 70, 40, 25]))
    assert ((d > 0) & (d < 1)).all()
