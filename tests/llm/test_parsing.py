"""Fingerprints by locally consistent parsing against plain Python, symbol by symbol."""

import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import parsing

ODD = [None, "", "a", "ab", "aaaa", "a" * 300, "Que " * 400, "日本語 😀 text", "\n\n\n", "same text " * 20, "same text " * 20, "x\x00y"]
M = (1 << 64) - 1
C = [int(x) for x in parsing._ODD]


def mixed(x):
    x = (x + C[2]) & M
    x = ((x ^ x >> 30) * C[0]) & M
    x = ((x ^ x >> 27) * C[1]) & M
    return x ^ x >> 31


def toss(symbols):
    out = [symbols[0] & 1]
    for b, c in zip(symbols, symbols[1:], strict=False):
        k = ((b ^ c) & -(b ^ c)).bit_length() - 1
        out.append(2 * k + (c >> k & 1))
    return out


def level(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [s if n == 1 else mixed(s ^ (n * C[2] & M)) for s, n in runs]
    colour = names
    for _ in range(4):
        colour = toss(colour)
    beside = lambda i: [colour[k] for k in (i - 1, i + 1) if 0 <= k < len(colour)]
    for high in (5, 4, 3):
        colour = [min({0, 1, 2} - set(beside(i))) if c == high else c for i, c in enumerate(colour)]
    long = {i for i, (_, n) in enumerate(runs) if n >= parsing.LONG_RUN}
    starts = [i for i, c in enumerate(colour) if i == 0 or i in long or i - 1 in long or all(c > x for x in beside(i))]
    out = []
    for a, b in zip(starts, starts[1:] + [len(names)], strict=True):
        if a in long:
            s, n = runs[a]
            out += [mixed((s * C[5] + 3) & M)] * (n // 3) + [mixed((s * C[5] + n % 3) & M)] * (n % 3 > 0)
        else:
            out.append(mixed(sum(n * C[p] for p, n in enumerate(names[a:b])) & M))
    return out


def sketch(text):
    out, symbols = [], [ord(c) for c in text or ""]
    for _ in range(parsing.LEVELS):
        symbols = level(symbols) if symbols else []
        seen, slots = {}, {}
        for s in symbols:
            times = seen[s] = seen.get(s, -1) + 1
            name = mixed((s + times * C[4]) & M) if times else s
            slots[name % parsing.SLOTS] = min(slots.get(name % parsing.SLOTS, M), name >> 6)
        out.append([min(mixed(slots[k]) & 0xFFFF, 0xFFFE) if k in slots else 0xFFFF for k in range(parsing.SLOTS)])
    return out


def alike(a, b):
    filled = [min(sum(v < 0xFFFF for v in x) for x in (s, t)) >= parsing.FILLED for s, t in zip(a, b, strict=True)]
    k = max((i for i, f in enumerate(filled) if f), default=0)
    either = [(x, y) for x, y in zip(a[k], b[k], strict=True) if x < 0xFFFF or y < 0xFFFF]
    j = sum(x == y for x, y in either) / len(either) if either else 1.0
    return 2 * j / (1 + j)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_sketches_are_those_of_plain_python():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + [prose(rng, n) for n in (1, 2, 5, 30, 200, 900)] + ["".join(rng.choice("ab") for _ in range(500))]
    got = parsing.sketches(texts)
    assert got.tolist() == [sketch(t) for t in texts]
    assert all(parsing.sketches([t])[0].tolist() == g.tolist() for t, g in zip(texts, got, strict=True))
    assert all((parsing.read(parsing.spelt(g)) == g).all() for g in got)
    for a in got:
        assert [float(x) for x in parsing.likeness(np.stack([a] * len(got)), got)] == [alike(a.tolist(), b.tolist()) for b in got]


def test_equal_substrings_share_their_inner_phrases():
    rng = random.Random(2)
    inner = prose(rng, 400)
    for before in (1, 7, 50, 333):
        names = []
        for text in (inner, prose(rng, before) + inner + prose(rng, 9)):
            symbols = [ord(c) for c in text]
            for _ in range(parsing.LEVELS):
                symbols = level(symbols)
            names.append(symbols)
        common = len(set(names[0]) & set(names[1]))
        assert common >= len(set(names[0])) - 16


def test_bounds_of_parts_are_found_by_search(spark):
    rng = random.Random(3)
    bounds = sorted({(rng.randrange(-9, 9), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(21)})
    keys = [*bounds, *((k, h + 1) for k, h in bounds), *((rng.randrange(-12, 12), rng.randrange(-99, 99)) for _ in range(50))]
    rows = spark.createDataFrame(keys, "k long, h long").withColumn("part", parsing._part(bounds)).collect()
    assert [r["part"] for r in rows] == [sum(b <= (r["k"], r["h"]) for b in bounds) for r in rows]


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_edit_likeness_is_that_of_plain_python(spark, parts):
    rng = random.Random(4)
    texts = ODD + [prose(rng, rng.randrange(1, 300)) for _ in range(30)] + ["long text, " * 20_000]
    rows = [(3 * i - 40, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    got = {r["doc_id"]: r for r in parsing.edit_likeness(docs, parts=parts).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (i, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other, following = sketch(text), sketch(changed), sketch(after)
        assert got[i]["fingerprint"] == parsing.spelt(np.array(own)) and got[i]["edited_fingerprint"] == parsing.spelt(np.array(other))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (alike(own, other), alike(own, following))


def test_edit_likeness_of_odd_tables(spark):
    hot = [(None, f"text {i} of no id") for i in range(300)] + [(7, f"text {i} of one id") for i in range(300)] + [(8, "equal rows")] * 5
    docs = spark.createDataFrame(hot, "doc_id long, text string")
    got = parsing.edit_likeness(docs, parts=8)
    assert got.count() == len(hot) and got.where("doc_id IS NULL").count() == 300
    assert parsing.edit_likeness(docs.limit(0)).count() == 0
    one = parsing.edit_likeness(docs.where("text = 'text 3 of one id'")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    found = parsing.fingerprints(docs.withColumnRenamed("doc_id", "fingerprint"))
    assert found.columns == ["text", "fingerprint"] and found.where("text = 'equal rows'").select("fingerprint").distinct().count() == 1


def test_edited_texts_are_near_and_other_texts_are_not():
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (40, 80, 200, 500, 2000) for _ in range(20)]
    own = parsing.sketches(texts)
    changed = parsing.sketches([parsing.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)])
    again = [w * 400 for w in ("Que ", "Enor, ", "a b c d e f g h i j k l m n o p q r s t u v ", "z")]
    changed_again = parsing.sketches([parsing.edited(t, prose(rng, 400)) for t in again])
    assert parsing.likeness(parsing.sketches(again), changed_again).min() > 0.45
    near, other = parsing.likeness(own, changed), parsing.likeness(own, np.roll(own, -1, 0))
    assert near.min() > 0.3 and 0.55 < near.mean() < 0.75 and other.max() < 0.25
