"""Importance resampling against plain Python, with small chunks, and its SQL."""

import hashlib
import math
import os
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tabloom.llm import importance

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "-- !", "A", "a b", "Ünï cödé 日本 " * 9, "word " * 3000, "same words here " * 8, "same words here " * 8]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, n):
    w = words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, n=2, percent=25):
    own = [grams(t, n) for _, t in rows]
    s, t = Counter(g for x in own for g in x), Counter(g for x in target for g in grams(x, n))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for (i, text), g in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = k
    return sorted(map(repr, out))


def told(df):
    return sorted(repr([r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")]) for r in df.collect())


@pytest.mark.parametrize(("n", "long", "chunk"), [(2, importance.LONG, importance.CHUNK_WORDS), (1, 50, 3), (2, 50, 7), (3, 0, 1)])
def test_resample_is_that_of_plain_python(spark, monkeypatch, n, long, chunk):
    """Chunks of a few words, also with a carry longer than a chunk, count every run of words once."""
    monkeypatch.setattr(importance, "LONG", long)
    made, size = importance._split, chunk

    def small(n):
        run = made(n)

        def with_size(batches):
            from tabloom.llm import importance as there

            there.CHUNK_WORDS = size
            return run(batches)

        return with_size

    monkeypatch.setattr(importance, "_split", small)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta", "γάμμα", "d,e", "x7"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(70, "Repeated rows count twice, all of their words too, " * 3)] * 2 + [(None, "no id " * 30)] * 2 + [(None, None)]
    target = ["alpha beta alpha beta", None, "x7 " * 40, ""]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, score string, bucket int").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert told(importance.resample(docs, items, n=n, percent=40)) == plain(rows, target, n, 40)


def test_resample_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, "some words of text " * 8) for i in range(40)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs.withColumn("n", F.lit(1)), none, with_text=True)
    assert got.columns == ["doc_id", "text", "n", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 11))
    assert got.where("text IS NULL").count() == 0


def test_target_like_texts_are_drawn_more_often(spark):
    texts = ["red green blue colours of paint " * 6, "stocks bonds money and markets " * 6]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(texts[0],)] * 3, "text string")
    drawn = importance.resample(docs, items).where("rank IS NOT NULL").select((F.col("doc_id") % 2).alias("kind")).collect()
    assert len(drawn) == 100 and sum(r["kind"] == 0 for r in drawn) >= 80  # a blind draw has about 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = importance.op11_importance_resampling(spark, SF)
    rel = con.sql(importance.SQL)
    assert sorted(rel.columns) == sorted(got.columns)
    want = rel.project(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
