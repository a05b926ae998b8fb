"""The operator against a plain version: tokens one by one, windows as tuples, alignments in dictionaries."""
import random
import re

from contamgraph.llm.decontaminate import COMMON, UNITS, VERBATIM, leaks

STOPS = set(".!?:;|\n\r\"'()[]{}#*$%&")


def readings(text):
    """Three lists of (template, literal) for ASCII text."""
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[0-9](?:[.,](?=[0-9])|[0-9])*|[A-Za-z]+", text)]
    out = []
    for reading in range(2):
        tokens, last_name = [], False
        for i, (w, s, _) in enumerate(found):
            inside = i > 0 and not any(c in STOPS for c in text[found[i - 1][2] : s])
            number = w[0].isdigit()
            capital = w[0].isupper() and len(w) > 1 and not w[1].isupper()
            name = capital and (inside if reading == 0 else w.lower() not in COMMON)
            unit = not number and i > 0 and found[i - 1][0][0].isdigit() and w.lower() in UNITS
            if name and last_name and inside:
                continue
            last_name = name
            tokens.append(("<num>" if number else "<unit>" if unit else "<name>" if name else w.lower(), w.lower()))
        out.append(tokens)
    return [*out, [(w.lower(), w.lower()) for w, _, _ in found]]


def judge(item, doc, matches, width, coverage, consistency):
    partner = {}
    for pos, place in matches:
        for j in range(width):
            partner.setdefault(place + j, pos + j)
    mine = sorted(partner)
    longest = run = 0
    for a, b in zip([None, *mine], mine, strict=False):
        same = item[b][1] == doc[partner[b]][1]
        follows = a is not None and b == a + 1 and partner[b] == partner[a] + 1 and item[a][1] == doc[partner[a]][1]
        run = (run + 1 if follows else 1) if same else 0
        longest = max(longest, run)
    share = len(mine) / len(item)
    if share < coverage and longest < VERBATIM:
        return None
    pairs = [(item[b][0], item[b][1], doc[partner[b]][1]) for b in mine if item[b][0].startswith("<")]
    there, back, good = {}, {}, 0
    for kind, x, y in pairs:
        good += there.setdefault((kind, x), y) == y and back.setdefault((kind, y), x) == x
    if pairs and good / len(pairs) < consistency and longest < VERBATIM:
        return None
    return share


def plain(docs, items, window=8, coverage=0.5, consistency=0.8, shortest=4):
    best = {}
    for d, text in docs:
        for i, question in items:
            for doc, item in zip(readings(text or ""), readings(question or ""), strict=True):
                width = window if len(item) >= window else len(item)
                if width < shortest:
                    continue
                at = {}
                for p in range(len(item) - width + 1):
                    w = tuple(t for t, _ in item[p : p + width])
                    if not all(t.startswith("<") for t in w):
                        at.setdefault(w, []).append(p)
                gaps = {}
                for p in range(len(doc) - width + 1):
                    for place in at.get(tuple(t for t, _ in doc[p : p + width]), ()):
                        gaps.setdefault(p - place, []).append((p, place))
                order = sorted(gaps, key=lambda g: (-len(gaps[g]), g))
                tries = [gaps[g] for g in order] + ([[m for g in order for m in gaps[g]]] if len(order) > 1 else [])
                for found in tries:
                    share = judge(item, doc, found, width, coverage, consistency)
                    if share is not None:
                        best[d, i] = max(best.get((d, i), 0), share)
    return best


def corpus():
    rng = random.Random(11)
    names, units = ["Anna", "Boston", "Tom Lee", "Mercury"], ["kg", "miles", "hours"]
    filler = "the a of river stone counts moves quickly under because old bridge window and then stops where many wait".split()

    def sentence():
        words = [rng.choice(filler) for _ in range(rng.randint(4, 9))]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(1, len(words)), rng.choice([rng.choice(names), f"{rng.randint(2, 30)} {rng.choice(units)}", str(rng.randint(2, 999))]))
        return " ".join(words).capitalize()

    items = [(i, ". ".join(sentence() for _ in range(rng.randint(1, 4))) + rng.choice([".", "?"])) for i in range(25)] + [(90, "one two"), (91, None), (92, "")]

    def change(text):
        kind = rng.random()
        if kind < 0.25:
            return text
        if kind < 0.6:
            swap = {w: str(rng.randint(2, 999)) for w in re.findall(r"[0-9]+", text)}
            swap |= dict(zip(names, rng.sample(["Berlin", "Carla", "Omar", "Jupiter"], 4), strict=True))
            return re.sub("|".join(sorted(map(re.escape, swap), key=len, reverse=True)), lambda m: swap[m[0]], text)
        words = text.split()
        if kind < 0.8:
            a = rng.randint(0, len(words) - 1)
            return " ".join(words[a : a + rng.randint(3, 20)])
        return " ".join(rng.choice([w, rng.choice(filler)]) if rng.random() < 0.2 else w for w in words)

    docs = [(i, " ".join([sentence() + ".", *(change(rng.choice(items[:25])[1]) for _ in range(rng.randint(0, 3))), sentence() + "."])) for i in range(120)]
    return [*docs, (500, None), (501, "")], items


def test_equals_plain_version(spark):
    docs, items = corpus()
    want = plain(docs, items)
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in out}
    assert len(want) > 40 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
