"""Importance resampling towards a target text distribution, by hashed word n-grams.

Texts are read as chunks.  A chunk owns the starting positions of a stretch of words and carries the n - 1 words after it,
so that every n-gram is counted once, in the chunk that owns its first word.  Ordinary texts are one chunk and stay
where they are read; the chunks of long ones are written and dealt anew, so that one huge text is the work of many tasks.
Chunks count into hash buckets, a bounded table for each corpus; the buckets' gains then come back to the chunks, whose
counts and weights are summed by document.  Gumbel noise from the id turns the weights into a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import LOWER, UPPER, saved, scratch
from tabloom.llm.decontam import words_of

#: Words whose starting positions one chunk owns.
CHUNK_WORDS = 20_000
#: Texts of more bytes are dealt by chunks.
LONG = 200_000
_OWN = ["n_words", "n_features", "weight", "score", "rank"]


def features(words: list[bytes], n: int, owned: int, buckets: int) -> np.ndarray:
    """The buckets of all runs of 1 to ``n`` words that start at one of the first ``owned`` words.

    The checksum of a run goes on from that of the run without its last word, so each word is read n times and no run is built.
    """
    spaced = [b" " + w for w in words[1:]]
    sums, out = [crc32(w) for w in words[:owned]], []
    for k in range(n):
        out += sums
        sums = list(map(crc32, spaced[k:], sums))
    return np.array(out, np.uint32) % np.uint32(buckets)


def _chunks(text: bytes, n: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, owned words, words with the carried ones) of a text."""
    words = words_of(text)
    for number, low in enumerate(range(0, len(words), CHUNK_WORDS)):
        own = words[low : low + CHUNK_WORDS + n - 1]
        yield number, min(CHUNK_WORDS, len(words) - low), b" ".join(own)


def _split(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                for number, owned, own in _chunks(text, n):
                    yield pa.RecordBatch.from_pydict({"_row": [row], "_chunk": [number], "_owned": [owned], "_text": pa.array([own], pa.binary())})

    return run


def _count(n: int, buckets: int):
    """Bucket counts of a task's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text, owned in zip(batch.column("_text"), batch.column("_owned").to_pylist(), strict=True):
                words = words_of(text.as_py() or b"")
                total += np.bincount(features(words, n, len(words) if owned is None else owned, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": total[held]})

    return run


def _weigh(n: int, gains: np.ndarray):
    """Owned words, features and gains of each chunk, beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, (text, owned) in enumerate(zip(batch.column("_text"), batch.column("_owned").to_pylist(), strict=True)):
                words = words_of(text.as_py() or b"")
                owned = len(words) if owned is None else owned
                found = features(words, n, owned, len(gains))
                out[:, k] = owned, len(found), gains[found].sum()
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("_text", "_owned")]
            names = [*(batch.schema.names[i] for i in kept), "n_words", "n_features", "_gain"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *map(pa.array, out)], names)

    return run


def _noise(seed: int, id_name: str):
    """``weight`` and ``score`` from the sums of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.maximum(batch.column("n_features").to_numpy(), 1)
            weight = batch.column("_gain").to_numpy() // count
            noise = np.empty(batch.num_rows, np.int64)
            for k, i in enumerate(batch.column(id_name).cast(pa.string()).to_pylist()):
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                noise[k] = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_gain"]
            names = [*(batch.schema.names[i] for i in kept), "weight", "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(weight), pa.array(weight + noise)], names)

    return run


def _long(text: str) -> Column:
    return F.coalesce(F.octet_length(text) > LONG, F.lit(False))


def _spread(docs: DataFrame, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The long rows, numbered, and their chunks, dealt by document and chunk."""
    rows = saved(docs.where(_long(text_col)).withColumn("_row", F.monotonically_increasing_id()), "importance-long")
    text = rows.select("_row", F.col(text_col).cast("binary").alias("_text"))
    chunks = text.mapInArrow(_split(n), "_row long, _chunk long, _owned long, _text binary")
    return rows, saved(chunks.repartition("_row", "_chunk").drop("_chunk"), "importance-chunks")


def _whole(docs: DataFrame, text_col: str) -> DataFrame:
    """The other rows, each its own chunk, which owns all its words."""
    return docs.where(~_long(text_col)).withColumns({"_text": F.col(text_col).cast("binary"), "_owned": F.lit(None).cast("long")}).drop(text_col)


def _bucket_counts(docs: DataFrame, chunks: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    parts = [_whole(docs.select(text_col), text_col).select("_text", "_owned"), chunks.select("_text", "_owned")]
    counted = [p.mapInArrow(_count(n, buckets), "bucket long, n long") for p in parts]
    return counted[0].union(counted[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; both tables hold at most ``buckets`` rows."""
    counts = np.zeros((2, buckets), np.int64)
    for k, table in enumerate((raw, target)):
        for row in table.collect():
            counts[k, row["bucket"]] = row["n"]
    s, t = counts.tolist()
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], np.int64)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    n: int = 2,
    buckets: int = 10_000,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    with_text: bool = False,
) -> DataFrame:
    """Draw ``percent`` of the documents, the likelier the more their n-grams are those of the target.

    Returns one row for each row of ``docs``: its columns (the text only if wanted), and (long) ``n_words``,
    ``n_features`` (runs of 1 to ``n`` words, repeats counted), ``weight`` (mean gain, rounded down), ``score``
    (weight and Gumbel noise of seed and id) and ``rank`` of the drawn ones, by descending score and ascending id; null
    for those not drawn.  Only documents of ``min_words`` words or more are drawn, ``percent`` of them, rounded down.
    Texts that are null or without words have no features and weight 0.  A null id has the noise of an empty id
    and comes last among ties.  Repeated rows count, and are drawn, as often as they come; ties beyond the id have any
    order.  Texts of any length are read whole, those above ``LONG`` bytes by chunks.  An empty table gives no rows, an
    empty target makes gains of the corpus's own counts.  Columns of these names are replaced, others kept.
    """
    docs = docs.drop(*_OWN, "_row", "_text", "_owned", "_gain", "_before", "_chunk")
    spark = docs.sparkSession
    with scratch(spark):
        long, chunks = _spread(docs, text_col, n)
        _, target_chunks = _spread(target.select(target_text), target_text, n)
        gains = _gains(_bucket_counts(docs, chunks, text_col, n, buckets), _bucket_counts(target, target_chunks, target_text, n, buckets), buckets)
        weigh = _weigh(n, gains)
        names = [c for c in docs.columns if with_text or c != text_col]
        own = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "_gain")]
        whole = _whole(docs.withColumn("_kept_text", F.col(text_col)) if with_text else docs, text_col)
        kept = [f for f in whole.schema.fields if f.name not in ("_text", "_owned")]
        whole = whole.mapInArrow(weigh, T.StructType(kept + own)).withColumnRenamed("_kept_text", text_col)
        sums = chunks.mapInArrow(weigh, "_row long, n_words long, n_features long, _gain long")
        sums = sums.groupBy("_row").agg(*[F.sum(f.name).alias(f.name) for f in own])
        # a long text without a word has no chunk
        summed = long.join(sums, "_row", "left").na.fill(0, [f.name for f in own])
        weighed = whole.select(*names, *[f.name for f in own]).union(summed.select(*names, *[f.name for f in own]))
        fields = [f for f in weighed.schema.fields if f.name != "_gain"]
        scored = weighed.mapInArrow(_noise(seed, id_col), T.StructType(fields + [T.StructField(c, T.LongType()) for c in ("weight", "score")]))
        scored = saved(scored, "importance-scored", keep=True)
    return _drawn(scored, id_col, min_words, percent)


def _drawn(scored: DataFrame, id_col: str, min_words: int, percent: int) -> DataFrame:
    """Ranks of the drawn rows.

    Scores are whole numbers, and as many differ as gains and noise allow (some ten thousands): rows are counted by
    score, the counts added up once, and only rows of one score are numbered together.
    """
    may = F.col("n_words") >= min_words
    counts = scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("score").alias("_score"), (F.sum("_n").over(Window.orderBy(F.desc("score"))) - F.col("_n")).alias("_before"))
    most = (scored.where(may).count() * percent) // 100
    above = before.where(F.col("_before") < most)
    met = scored.join(above, may & (F.col("score") == F.col("_score")), "left").drop("_score")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    drawn = met.where("_before IS NOT NULL").withColumn("rank", rank.cast("long")).drop("_before")
    rest = met.where("_before IS NULL").withColumn("rank", F.lit(None).cast("long")).drop("_before")
    return drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).union(rest)


def op11_importance_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH RECURSIVE w AS (
  SELECT 'd' AS side, doc_id AS id, {_WORDS} AS w FROM documents
  UNION ALL SELECT 'b', NULL, {_WORDS} FROM benchmark
), f AS (
  SELECT side, id, unnest(w) AS f FROM w
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i)
), distinct_f AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)
), steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), bytes AS (
  SELECT b, c FROM steps WHERE k = 8
), crc(f, x, k, c) AS (
  SELECT f, x, 0, 4294967295 FROM distinct_f
  UNION ALL SELECT f, x, k + 1, xor(crc.c >> 8, bytes.c)
  FROM crc JOIN bytes ON bytes.b = xor(crc.c, ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) & 255 WHERE 2 * k < length(x)
), hashed AS (
  SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * k = length(x)
), n AS (
  SELECT side, id, bucket, count(*) AS n FROM f JOIN hashed USING (f) GROUP BY ALL
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM n GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM s
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM n JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (id) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored
)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= (25 * n) // 100 THEN r END::BIGINT AS rank FROM ranked
"""
