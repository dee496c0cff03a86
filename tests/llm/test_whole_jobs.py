"""Whole jobs that the first round's corpus operators did only in part."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabloom.llm import jaccard_join, license_scan, packing, token_codes, tokens


def test_licenses_inside_lines(spark):
    plain = "the river ran past the old mill and the children of the village played on its banks "
    texts = [
        "Copyright 2019 Jane Doe and contributors. Released under the MIT License.",
        plain * 40 + "this text was released under the MIT License by its authors and " + plain * 40,
        "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction",
        "This work is in the public\ndomain.",
        "Licensed under the GNU Lesser General Public License, version 2.1, or the MIT License.",
        "You need written permission from the council to build a garage.",
        plain * 40 + "She renewed her driving license at the town hall in the morning. " + plain * 40,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_licenses"], r["families"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: (1, ["mit"]), 1: (1, ["mit"]), 2: (1, ["mit"]), 3: (1, ["public-domain"]), 4: (2, ["lgpl", "mit"]), 5: (0, []), 6: (0, [])}


def test_jaccard_links(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(100)]
        for n in range(24):
            w = list(base)
            for _ in range(n % 3):
                w[rng.randrange(100)] = rng.choice(words)
            texts.append(" ".join(w))
            if n % 12 == 11:
                base[rng.randrange(100)] = rng.choice(words)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    rep = [sets.index(s) for s in sets]
    want = {(a, b) for b in set(rep) for a in set(rep) if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "_BLOCK", 5)
    links, members = jaccard_join.jaccard_links(docs)
    got = [tuple(r) for r in links.collect()]
    assert len(want) > len(set(rep))
    assert len(got) == len(set(got))
    assert set(got) == want
    assert {r["id"]: r["rep"] for r in members.collect()} == dict(enumerate(rep))
    some, all_ = (jaccard_join.jaccard_components(docs, every=e).collect() for e in (False, True))
    assert sorted(some) == sorted(all_)


def near_copies(rng, words, groups, size, passage):
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(60)]
        for n in range(size):
            w = list(base)
            for _ in range(n % 4):
                w[rng.randrange(60)] = rng.choice(words)
            rows.append(" ".join(w))
            if n % 10 == 9:
                base[rng.randrange(60)] = rng.choice(words)
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randrange(30))]) for _ in range(40)]
    return rows


@pytest.mark.parametrize(("crowd", "leaf", "block"), [(3, 8, 5)])
def test_jaccard_join_recursion(spark, monkeypatch, crowd, leaf, block):
    """Crowded shingles, regions in regions and a passage that many documents share, against brute force."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = near_copies(rng, words, 3, 30, [rng.choice(words) for _ in range(50)])
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    rep = [sets.index(s) for s in sets]
    links = {(a, b) for b in set(rep) for a in set(rep) if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    label = dict(enumerate(rep))
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for name, value in (("_CROWD", crowd), ("_LEAF", leaf), ("_BLOCK", block)):
        monkeypatch.setattr(jaccard_join, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: (label[r], sum(r in p for p in links)) for i, r in enumerate(rep)}


def against_brute_force(spark, texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    label = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {i: (label[i], sum(i in p for p in links)) for i in range(len(sets))}
    return links


def test_crowded_documents_show_more_hashes_and_not_whole_sets(spark, monkeypatch):
    """Documents that share a passage with many, but have enough of their own, settle before the crowd's join."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(44)]
    texts = []
    for g in range(30):
        own = [f"d{g}w{i}" for i in range(70)]
        texts += [" ".join(passage + own), " ".join(passage + own[: rng.randrange(60, 69)] + [f"d{g}x"])]
    crowds = []
    near = jaccard_join._Crowd.near
    monkeypatch.setattr(jaccard_join._Crowd, "near", lambda self, points, level=0: (crowds.append(points.count()), near(self, points, level))[1])
    for name, value in (("_OFTEN", 1 << 30), ("_LEAF", 8), ("_BLOCK", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert len(against_brute_force(spark, texts)) >= 30
    assert sum(crowds) == 0


def test_crowded_and_settled_documents(spark, monkeypatch):
    """Links between documents that settle at once, after more hashes, and never."""
    rng = random.Random(4)
    passages = [[f"p{k}v{i}" for i in range(30)] for k in range(4)]
    texts = []
    for g in range(45):
        words = [w for p in rng.sample(passages, g % 5 if g % 5 < 4 else 4) for w in p] + [f"d{g}w{i}" for i in range(rng.choice((4, 12, 40, 80)))]
        texts.append(" ".join(words))
        for n in range(g % 3):
            words = list(words)
            words[rng.randrange(len(words))] = f"d{g}x{n}"
            texts.append(" ".join(words))
    for name, value in (("_OFTEN", 1 << 30), ("_LEAF", 8), ("_BLOCK", 5), ("_CROWD", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert against_brute_force(spark, texts)


def test_few_regions_need_no_meeting(spark, monkeypatch):
    def meet(*_):
        raise AssertionError("the centres of few regions are compared at once")

    monkeypatch.setattr(jaccard_join, "_meet", meet)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    assert against_brute_force(spark, list(dict.fromkeys(near_copies(rng, words, 2, 12, [rng.choice(words) for _ in range(20)]))))


@pytest.mark.parametrize("words", [True, False])
def test_ids_as_the_library_gives_them(words):
    """Special strings in a text are special tokens; the expected ids come from a plain tokenizer."""
    path = packing.word_vocabulary() if words else token_codes.byte_vocabulary()
    texts = ["<|endoftext|> b", "a<|endoftext|>", "x <|startoftext|> y. z", "<|ENDOFTEXT|> b", None, "", "plain. words here!", "<|endoftext|><|endoftext|>", "one. two. three <|endoftext|> four. five."]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = tokens.Encoder(path, words).encode(pa.array(texts))
    begin = [0, *got.ends[:-1].tolist()]
    assert [got.ids[a:b].tolist() for a, b in zip(begin, got.ends.tolist(), strict=True)] == want
    assert got.stops.tolist() == sorted(got.stops.tolist())
