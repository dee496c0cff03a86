"""Corpus operators against plain Python on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import components, decontam, jaccard_join, langid, license_scan, line_dedup, packing, quality_rules, sharding, token_codes, tokens, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


ODD = [None, "", "a", " ", "\n", "Word. " * 4000, "ÀÉ ñ ß 日本", "x\n\nX \nx", "same text here", "same text here", "\t a\x0bb \x0c"]


def test_line_dedup(spark):
    texts = ODD + [f"Header Line\nown {i}\n header line \n" for i in range(12)] + ["header line\nheader line"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts).withColumn("n_lines", F.lit("x"))).collect()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(frame(spark, ["x"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "h")] * 12, "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(nulls).collect()] == [1] * 12


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    at = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(at)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 4, 30, 300, 3000)] + ["a b c d a b c\na b c\na b c#*|"]
    rows = quality_rules.with_counts(frame(spark, texts).withColumn("n_words", F.lit(-1))).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(texts[r["doc_id"]])


def test_quality_verdict(spark):
    rng = random.Random(10)
    clean = "\n".join(" ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(5)) for _ in range(9)) + "." for _ in range(9))
    menu = "\n".join(" | ".join(f"menu{i}{k}" for k in range(9)) for i in range(9))
    shout = " ".join(f"BUY{i}!!" for i in range(80))
    symbols = " ".join(f"word{i}%%%" for i in range(80))
    mixed = clean + "\nHome | About | Contact | More"
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, [clean, menu, shout, symbols, mixed, None])).collect()}
    assert [got[i]["kept"] for i in range(6)] == [True, False, False, False, True, False]
    assert got[4]["cleaned"] == clean and got[5]["base_failed"]


def test_sharding(spark):
    rng = random.Random(2)
    texts = ["copy of a text " * 9] * 400 + ["".join(rng.choice("abc ") for _ in range(rng.randrange(400))) for _ in range(800)] + ODD
    got = sharding.shard_by_bytes(frame(spark, texts), 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 8, max(len(t or "") for t in texts) + 16
    assert set(size) == set(range(8)) and max(abs(s - mean) for s in size.values()) <= largest + 0.02 * mean
    assert sharding.shard_by_bytes(frame(spark, ["x"]).limit(0), 4).count() == 0
    assert sharding.shard_by_bytes(frame(spark, ["x"]), 4).first()["slot"] == 0


def test_sharding_keeps_small_groups_together(spark):
    texts = [f"group {i % 200} " * 3 for i in range(2000)]
    got = sharding.shard_by_bytes(frame(spark, texts), 4, tolerance=0.05).collect()
    assert max(len({r["shard"] for r in got if texts[r["doc_id"]] == t}) for t in set(texts)) == 1


def test_urls(spark):
    urls = [None, "no scheme", "http://A.example.NET/en/1?x#y", "https://example.com/de/", "http://x.org/fr/a", "http://x.net", "http://x.net/", "ftp://notexample.net?q", "http://h/p://q/r", "http://x.COM#f"]
    urls += [f"http://casino{i}.example.org/win/{i}" for i in range(30)] + [f"http://paper{i}.example.org/news/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(2, urls[2])], "page_id long, url string").withColumn("rule", F.lit(1))
    labels = spark.createDataFrame([(i, 0 if "casino" in (u or "") else 1, 0) for i, u in enumerate(urls)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    rows = url_rules.filter_urls(pages, labels).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: r for r in rows}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"),
        ("x.org", "/fr/a", "org/fr/", "allow"), ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("notexample.net", "", None, "allow"),
    ]
    assert (got[8]["host"], got[8]["path"], got[9]["host"]) == ("h", "/p://q/r", "x.com")
    assert all(got[i]["verdict"] == ("block" if "casino" in urls[i] else "allow") for i in range(10, len(urls)))
    assert url_rules.filter_urls(pages, labels.limit(0)).where("mined_rule IS NOT NULL").count() == 0
    assert url_rules.filter_urls(pages.limit(0), labels).count() == 0


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(i, f"https://a.example/{'spam/casino' if i % 2 else 'news/item'}/{i}") for i in range(40)] * 2, "page_id long, url string"
    )
    labels = spark.createDataFrame([(i, i % 2 ^ 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    clashing = pages.withColumns({c: F.lit(c) for c in ("bad", "tokens", "doc_id", "quality", "_label_id", "confidence", "n_bad", "_key")})
    out = url_rules.filter_urls(clashing, labels)
    assert set(clashing.columns) < set(out.columns)
    rows = out.collect()
    assert len(rows) == 80 and all(r["bad"] == "bad" and (r["verdict"] == "block") == bool(r["page_id"] % 2) for r in rows)
    plain = {(r["page_id"], r["mined_rule"]) for r in url_rules.filter_urls(pages, labels).collect()}
    assert plain == {(r["page_id"], r["mined_rule"]) for r in rows}


def test_licenses(spark):
    texts = ["Released under the MIT License.\nmore text", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "She renewed her driving license at the town hall in the morning.", None, "", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    got = {r["doc_id"]: r["families"] for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i] for i in range(8)] == [["mit"], ["proprietary"], ["cc-by-nc"], ["gpl"], [], [], [], ["apache", "mit"]]
    assert license_scan.scan_licenses(frame(spark, texts).limit(0)).count() == 0


WORDS = {"aa": "ba be bi bo bu da de di do du".split(), "zz": "kra kre kri kro kru sta ste sti sto stu".split()}


def test_language(spark):
    rng = random.Random(3)
    texts = [(y, " ".join("".join(rng.choice(WORDS[y]) for _ in range(rng.randrange(1, 4))) for _ in range(40))) for y in ("aa", "zz") for _ in range(60)]
    docs = spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(texts)] + [(900, "x", None), (901, None, "aa")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["lang_pred"] == texts[i][0] for i in held)
    assert (got[901]["lang_pred"], got[901]["score"], got[901]["rejected"]) == ("und", 0.0, True)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, ["", "12 %", "é", "a"]), model).collect()}
    assert odd[0] == odd[1] == "und" and odd[2] in WORDS and odd[3] in WORDS
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_language_sample_of_shared_ids(spark, monkeypatch):
    taken = Counter()
    monkeypatch.setattr(langid, "fit", lambda pairs: taken.update(y for _, y in pairs))
    rows = [(i, f"text {k}", y) for i, y in ((None, "en"), (7, "de"), (8, "fr")) for k in range(2000)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100)
    assert set(taken) == {"en", "de", "fr"} and all(60 < n <= 100 for n in taken.values())


def test_best_cuts_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        at = np.unique([0, *(rng.randrange(1, 200) for _ in range(25))])
        at = np.unique(np.concatenate([at, np.arange(0, at[-1], 16)]))
        pen = np.array([rng.choice([0, 3, 9]) for _ in at])
        limit = 32
        cost = lambda n: 0 if n & (n - 1) == 0 else limit - n
        f = [0] * len(at)
        for j in range(1, len(at)):
            f[j] = pen[j] + min(f[i] + cost(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= limit)
        cuts, total = packing.best_cuts(at, pen, limit)
        assert total == f[-1] and cuts[0] == 0 and cuts[-1] == at[-1] and set(cuts) <= set(at.tolist())


def reference(path, texts, end):
    tokenizer = tokens._load(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


SPACED = ["a  b", "a   b", " a", "a  ", "\n\na b\n \nc", "A'S it's 12,3 É́x", "tab\tx  \ty", "\x1c a \x85 b", "İstanbul ΣΑΣ Σ.", "<|endoftext|> b", "a, b.c d... e?! f\ng.\nh .x", "x　y", "don't. I'LL!", "x\x01y z", "Ġ a"]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 5)
    texts = [t for t in ODD + SPACED if t]
    for path, words in ((packing.word_vocabulary(), True), (token_codes.byte_vocabulary(), False)):
        encoder = tokens.Encoder(path, words)
        for _ in range(2):
            for batch in (texts, texts[::-1]):
                found = encoder.encode(pa.array(["x", *batch]).slice(1))
                got = [x.tolist() for x in np.split(found.ids, found.ends[:-1])]
                assert got == [x[:-1] for x in reference(path, batch, 0)]


def test_packing(spark, monkeypatch):
    rng = random.Random(5)
    texts = ODD + SPACED + [" ".join(rng.choice(["word", "other.", "And", "long"]) for _ in range(rng.randrange(900))) for _ in range(40)]
    want = reference(packing.word_vocabulary(), texts, 1)
    for stretch in (1 << 18, 5000):
        monkeypatch.setattr(packing, "_STRETCH", stretch)
        docs = frame(spark, texts).withColumn("offset", F.lit("x"))
        rows = packing.pack(docs, packing.word_vocabulary()).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == crc(ids) and r["doc_tokens"] == len(want[r["doc_id"]])
            by_doc[r["doc_id"]].append((r["start"], r["length"]))
            by_seq[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
        assert sorted(by_doc) == list(range(len(texts)))
        for i, spans in by_doc.items():
            spans.sort()
            assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == len(want[i])
        pad = 0
        order = []
        assert sorted(by_seq) == list(range(len(by_seq)))
        for k in sorted(by_seq):
            pieces = sorted(by_seq[k])
            n = sum(p[1] for p in pieces)
            assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()] and n <= 2048
            pad += 0 if n & (n - 1) == 0 else 2048 - n
            order += [p[2] for p in pieces]
        assert order == sorted(order) and pad < 0.03 * sum(map(len, want))
    assert packing.pack(frame(spark, ["x"]).limit(0), packing.word_vocabulary()).count() == 0


def test_codes_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    for ids in (np.zeros(0, np.uint32), np.arange(5, dtype=np.uint32), rng.integers(0, 1 << 16, 3000).astype(np.uint32), rng.integers(0, 1 << 25, 1500).astype(np.uint32)):
        codes = token_codes.Codes(token_codes.encode_levels(ids))
        assert codes.range(0, len(ids)).tolist() == ids.tolist()
        for a, b in ((0, 1), (511, 513), (7, 1400)):
            if b <= len(ids):
                assert codes.range(a, b).tolist() == ids[a:b].tolist() and codes[b - 1] == ids[b - 1]
    texts = ODD + SPACED
    want = reference(token_codes.byte_vocabulary(), texts, 0)
    path = "file://" + str(tmp_path / "codes")
    token_codes.write_codes(frame(spark, texts), token_codes.byte_vocabulary(), path)
    rows = token_codes.read_codes(spark, path).orderBy("doc_id").collect()
    start = 0
    assert len(rows) == len(texts)
    for r, ids in zip(rows, want, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), crc(ids), ids)
        start += len(ids)
    token_codes.write_codes(frame(spark, texts).limit(0), token_codes.byte_vocabulary(), path + "0")
    assert token_codes.read_codes(spark, path + "0").count() == 0


def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for _ in range(2):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
        w = list(base)
        for _ in range(25):
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    for _ in range(30):
        rows.append((len(rows), "this header is common to all of these documents " + " ".join(rng.choice(words) for _ in range(rng.randrange(20)))))
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for rounds, block, often in ((2, 128, 3), (1, 5, 10**9)):
        monkeypatch.setattr(jaccard_join, "_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "_BLOCK", block)
        monkeypatch.setattr(jaccard_join, "_OFTEN", often)
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs).collect()}
        assert got == want
    kept = {r["doc_id"] for r in jaccard_join.keep_one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_join_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "a b c"), (9, None)], "doc_id long, text string")
    got = sorted((r[0] or -1, r[1], r[2]) for r in jaccard_join.jaccard_components(odd).collect())
    assert got == [(-1, 1, None), (3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 0, 9)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_hits(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w = split(text)
    hit, found = set(), set()
    for k, t in items:
        x = split(t)
        m = min(n, len(x))
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(8)
    words = "the of a b c d e f".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))) for i in range(20)] + [(50, None), (51, ""), (52, "..."), (53, "Été, SOLO"), (54, "x y z")]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(150))) for _ in range(30)]
    texts += ["start one, " + items[k][1].upper() + "! end" for k in range(8)] + ["say Été solo. done", "x-y-z"]
    docs = frame(spark, texts).withColumn("n_hit", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.MAX_WORDS, 40):
        rows = decontam.find_contamination(docs, bench, max_words=most).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["hit_items"]) == brute_hits(texts[r["doc_id"]], items)
    solo = next(r for r in rows if r["text"] == "say Été solo. done")
    assert solo["cleaned"] == "say . done" and solo["contaminated"]
    kept = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = brute_hits(t, items)
        assert (i in kept) == (hit <= n * 0.5)
        if i in kept and not hit:
            assert kept[i] == t
    assert decontam.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", ["op1_url_rules", "op3_line_dedup", "op6_quality_rules", "op10_decontamination"])
def test_sql(spark, name):
    import os

    from tabloom.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df, rel = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(repr(list(r)) for r in df.select(*cols).collect()) == sorted(repr(list(r)) for r in rel.project(", ".join(cols)).fetchall())


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    body = lambda: " ".join(rng.choice(WORDS[rng.choice(["aa", "zz"])]) + rng.choice(WORDS["aa"]) for _ in range(60)) + "."
    texts = ["Common header line\n" + body() for _ in range(40)]
    texts += [texts[3], texts[4] + " x", body() + "\n" + item, item, None, "12 34 %"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == set(range(44))
    assert all("Common header" not in t for t in seen[1].values()) and set(seen[1]) == set(seen[0])
    assert set(seen[2]) == set(seen[1]) - {40, 41}
    assert set(seen[3]) == set(seen[2]) - {43} and item not in seen[3][42] and all(seen[3][i] == seen[2][i] for i in range(40))
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert {k[0] for k in key(again)} == set(seen[3])
    assert hashlib.sha256(repr(key(again)).encode()).hexdigest() == hashlib.sha256(repr(key(docs)).encode()).hexdigest()
