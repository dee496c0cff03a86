"""Benchmark decontamination by a generalised suffix automaton over words.

The benchmark items are normalised to words and built into one suffix automaton, small enough to be rebuilt by every
task.  Training documents stream past it: the state after each word gives the longest item substring that ends there,
and where that reaches the window length the words are hit.  Only runs of words that the benchmark knows are walked.
Items beyond ``MAX_WORDS`` words are split over several automata, one pass each, so no task holds more.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import LOWER, UPPER, lean

#: Words of items in one automaton (about 100 MB in a task).
MAX_WORDS = 300_000
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then runs of ASCII letters, digits and anything beyond ASCII."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for k, words in items]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.next)
        #: The state that holds the last `window` words of a state's strings, if they are that long.
        self.tail = [-1] * n
        for v in sorted(range(n), key=self.len.__getitem__):
            if self.len[v] >= window:
                up = self.link[v]
                self.tail[v] = self.tail[up] if self.len[up] >= window else v
        self.of_window: dict[int, set[str]] = {}
        #: Whole items shorter than a window, at the state of their words.
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        for k, ids in coded:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.of_window.setdefault(self.tail[v], set()).add(k)
            if 0 < len(ids) < window:
                self.least = min(self.least, len(ids))
                while self.len[self.link[v]] >= len(ids):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(ids), k))
        #: From each state, the next one at or above it in the link tree that holds a short item.
        self.out = [0] * n
        for v in sorted(range(1, n), key=self.len.__getitem__):
            self.out[v] = v if v in self.short else self.out[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(hit spans of word positions, items that occur, longest match) of one document."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.least:
                longest = max(longest, self._walk(ids[a:b].tolist(), a, spans, found))
        return merged(spans), found, longest

    def _walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> int:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        v = matched = longest = 0
        for i, c in enumerate(ids, at):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v, matched = nxt[v][c], matched + 1
            longest = max(longest, matched)
            if matched >= window:
                spans.append((i - window + 1, i + 1))
                found |= self.of_window[self.tail[v]]
            x = self.out[v] if self.short else 0
            while x:
                for n, k in self.short[x]:
                    if n <= matched:
                        spans.append((i - n + 1, i + 1))
                        found.add(k)
                x = self.out[link[x]]
        return longest


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans with the same union; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return (b"".join(out) + text[last:]).decode("utf-8")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_OWN = ["n_words", "n_hit", "longest_match", "hit_items", "hit_spans", "contaminated", "cleaned"]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    with_cleaned: bool = True,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Add what each document shares with the items.

    Returns the input columns with ``n_words, n_hit, longest_match`` (long), ``hit_items`` (item ids as strings,
    sorted), ``hit_spans`` (word positions, end exclusive), ``contaminated`` and ``cleaned`` (the text without hit
    spans; null for a null text, or if not wanted).  A window is ``window`` consecutive words of an item; a shorter
    item is one window, an item without words none.  Null texts have no words.  Columns of these names are replaced.
    """
    docs = docs.drop(*_OWN)
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    parts = max(1, -(-size // (max_words * 4)))
    rows = items.where(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("k"), F.col(item_text).cast("binary").alias("t")
    )
    own = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("longest_match", T.LongType()),
            T.StructField("hit_items", T.ArrayType(T.StringType())),
            T.StructField("hit_spans", _SPANS),
            T.StructField("cleaned", T.StringType()),
        ]
    )
    base = docs.schema
    found = docs
    for part in range(parts):
        these = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == part)
        texts = [(r["k"], bytes(r["t"])) for r in these.toLocalIterator()]
        found = found.mapInArrow(lean(_pass(texts, window, text_col, part > 0, with_cleaned and part == parts - 1)), T.StructType(base.fields + own.fields))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.size("hit_spans") > 0)


def _pass(texts: list[tuple[str, bytes]], window: int, text_col: str, again: bool, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(k, words_of(t)) for k, t in texts], window)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                n, longest, ids, spans, cleaned = [], [], [], [], []
                column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
                before = batch.select(["longest_match", "hit_items", "hit_spans"]).to_pylist() if again else None
                for row, text in enumerate(column.to_pylist()):
                    words = words_of(text) if text else []
                    at, which, most = automaton.scan(words)
                    if before is not None:
                        old = before[row]
                        at = merged([*at, *((s["start"], s["end"]) for s in old["hit_spans"])])
                        which, most = which | set(old["hit_items"]), max(most, old["longest_match"])
                    n.append(len(words))
                    longest.append(most)
                    ids.append(sorted(which))
                    spans.append([{"start": a, "end": b} for a, b in at])
                    cleaned.append(None if text is None or not cut else _cut(text, at) if at else text.decode("utf-8"))
                keep = batch.columns[: batch.num_columns - 5] if again else batch.columns
                names = batch.schema.names[: len(keep)]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                own = [pa.array(n, pa.int64()), pa.array(longest, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, span), pa.array(cleaned, pa.string())]
                yield pa.RecordBatch.from_arrays([*keep, *own], [*names, "n_words", "longest_match", "hit_items", "hit_spans", "cleaned"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """The documents without benchmark text: hit spans are cut out, and a document goes where more than
    ``max_coverage`` of its words are hit.  Keeps the input's columns; clean documents stay as they are."""
    found = find_contamination(docs, items, text_col, **options)
    kept = found.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    return kept.withColumn(text_col, F.when(F.col("contaminated"), F.col("cleaned")).otherwise(F.col(text_col))).select(*docs.columns)


def op10_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_cleaned=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT m FROM win
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), hit AS (
  SELECT doc_id, item_id, g.m, i FROM g JOIN win ON g.m = win.m AND g.g = win.g
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
