"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text becomes the letters of its words; every byte 2-, 3- and 4-gram hashes to one of ``2**BITS`` buckets with an
embedding of a few numbers; the mean embedding goes through a linear softmax.  Embeddings and weights are trained by
stochastic gradient descent in numpy on a bounded sample of labelled documents, whole and in snippets.  A temperature
and a rejection threshold are calibrated on documents of the sample that training does not see.  Prediction needs
only each bucket's class scores, so it is a lookup and a mean over the whole text, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import lean

BITS, DIM = 14, 16
#: Bound of the labelled sample: so many documents for each label value.
PER_LANG = 400
_BLANK = bytes(0x20 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes of text that are hashed at once.
_STEP = 1 << 17


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _hashes(raw: bytes) -> np.ndarray:
    """The buckets of all byte 2-, 3- and 4-grams."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x101) + b[1:]
    three = two[:-1] * np.uint32(0x101) + b[2:]
    four = three[:-1] * np.uint32(0x101) + b[3:]
    grams = np.concatenate([two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x1B873593), four ^ np.uint32(0x2545F491)])
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def letters_of(text: str) -> bytes:
    """Lower-cased words parted and framed by single spaces; ASCII other than letters counts as space."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # bucket x language: the embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        raw = letters_of(text)
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, max(1, len(raw) - 3), _STEP):
            idx = _hashes(raw[at : at + _STEP + 3])
            total += self.scores[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` without letters or without any learned language."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippets(text: str, rng: np.random.Generator, n: int) -> list[str]:
    words = text.split()
    out = []
    for _ in range(n):
        size = int(rng.integers(3, 40))
        at = int(rng.integers(0, max(1, len(words) - size)))
        out.append(" ".join(words[at : at + size]))
    return [x for x in out if has_letter(x)]


def fit(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 2.0, false_rejects: float = 0.002, seed: int = 1) -> Model:
    """Train on (text, language) pairs; every fifth pair calibrates instead."""
    sample = sorted({(t, y) for t, y in sample if has_letter(t)}, key=lambda p: (p[1], p[0]))
    langs = sorted({y for _, y in sample})
    n_buckets = 1 << BITS
    if not langs:
        return Model([], np.zeros((n_buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    parts: dict[bool, list[tuple[np.ndarray, np.ndarray, int]]] = {True: [], False: []}
    for i, (text, y) in enumerate(sample):
        aside = i % 5 == 4
        for s in [text, *_snippets(text, rng, 3)]:
            counts = np.bincount(_hashes(letters_of(s)), minlength=n_buckets)
            at = np.flatnonzero(counts)
            parts[aside].append((at, (counts[at] / counts.sum()).astype(np.float32), langs.index(y)))
    e = rng.normal(0, 0.1, (n_buckets, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    train = parts[False]
    # each language weighs the same, however the sample is spread
    share = np.bincount([y for _, _, y in train], minlength=len(langs)) * len(langs) / max(1, len(train))

    def dense(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), n_buckets), np.float32)
        for k, (at, v, _) in enumerate(rows):
            x[k, at] = v
        return x, np.array([y for _, _, y in rows])

    size = 64
    for epoch in range(epochs):
        order = rng.permutation(len(train))
        step = np.float32(rate * (1 - epoch / epochs))
        for at in range(0, len(order), size):
            x, y = dense([train[k] for k in order[at : at + size]])
            h = x @ e
            g = _softmax(h @ w + bias)
            g[np.arange(len(y)), y] -= 1
            g = (g / np.maximum(share[y], 0.05)[:, None] / len(y)).astype(np.float32)
            back = g @ w.T
            w -= step * (h.T @ g)
            bias -= step * np.float32(0.1) * g.sum(axis=0)
            e -= step * np.float32(20) * (x.T @ back)
    scores = (e @ w).astype(np.float32)
    model = Model(langs, scores, bias.astype(np.float64), 1.0, 0.0)
    aside = parts[True] or train
    logits = np.array([v @ scores[at] + bias for at, v, _ in aside], np.float64)
    y = np.array([k for _, _, k in aside])
    model.temperature = min(
        (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0),
        key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean(),
    )
    right = _softmax(logits / model.temperature)[np.arange(len(y)), y]
    model.reject_below = min(0.5, float(np.quantile(right, false_rejects)))
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Fit on at most ``per_lang`` rows for each language, those of the lowest hashes of id and text.

    The rows are found by a hash threshold computed from each language's count, so no group is sorted or gathered.
    Rows that share an id, or have none, are drawn apart by their texts; rows that repeat both are drawn together.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return fit([])
    rank = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    limit = F.lit(0)
    for y, n in counts.items():
        limit = F.when(F.col(lang_col) == y, int(min(1.0, 1.2 * per_lang / n) * (1 << 30))).otherwise(limit)
    got = rows.where(rank < limit).select(F.col(text_col), F.col(lang_col), rank.alias("r")).collect()
    by: dict[str, list] = {}
    for t, y, _ in sorted(got, key=lambda r: (r[2], r[0])):
        if len(by.setdefault(y, [])) < per_lang:
            by[y].append((t, y))
    return fit([p for y in sorted(by) for p in by[y]])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` (string), ``score`` (double, 0 to 1) and ``rejected`` (boolean) for every whole text.

    A null text or one without letters is ``und`` with score 0 and rejected; otherwise a learned language is named and
    rejected only when its calibrated probability is below the model's threshold.  Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [model.predict(texts[i].as_py()) for i in range(len(texts))]
            own = [pa.array([y for y, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "lang_pred", "score"])

    rejected = (F.col("lang_pred") == "und") | (F.col("score") < model.reject_below)
    return docs.mapInArrow(lean(run), schema).withColumn("rejected", rejected)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
