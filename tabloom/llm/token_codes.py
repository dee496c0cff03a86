"""Token-id output as directly addressable codes.

An id is cut into 8-bit chunks.  Level 0 holds the lowest chunk of every id; its continuation bitmap marks the ids
that have more, whose next chunks form level 1, and so on.  A rank directory counts the marks before each block of 512
bits, so the chunk of any id on the next level is found by one directory entry and one partial count: random access
without decoding a block.  Segments of whole documents are rows of a Parquet table with binary columns, which any
executor can write and read; each carries a directory of its documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabloom.llm.common import lean, shared_folder
from tabloom.llm.tokens import encoder

_BLOCK = 512
#: Ids after which a segment is closed at the next document end.
_SEGMENT = 1 << 18
_CHUNK = 1000

_LEVEL = pa.struct([("chunks", pa.binary()), ("marks", pa.binary()), ("ranks", pa.binary())])


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of unsigned ids; the last level has no marks."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        if not more.any():
            levels.append({"chunks": chunks.tobytes(), "marks": b"", "ranks": b""})
            return levels
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32)
        ranks = (np.cumsum(counts) - counts).astype("<u4")
        levels.append({"chunks": chunks.tobytes(), "marks": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, levels: list[dict[str, bytes]]) -> None:
        self.levels = [
            (np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["marks"], np.uint8), np.frombuffer(x["ranks"], "<u4"))
            for x in levels
        ]

    def _rank(self, level: int, i: int) -> int:
        _, marks, ranks = self.levels[level]
        block = min(i // _BLOCK, len(ranks) - 1)
        part = np.unpackbits(marks[block * _BLOCK // 8 : -(-i // 8)], bitorder="little", count=i - block * _BLOCK)
        return int(ranks[block]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, marks, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not len(marks) or not marks[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b (exclusive)."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level, (chunks, marks, _) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            if not len(marks) or a == b:
                break
            bits = np.unpackbits(marks[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            where = where[bits]
            a = self._rank(level, a)
            b = a + len(where)
        return out


def write_codes(
    docs: DataFrame, tokenizer: str, path: str, text_col: str = "text", order_col: str = "doc_id", end_id: int = 0
) -> None:
    """Encode every whole text, append ``end_id`` and write the segments in the order of ``order_col`` to ``path``.

    A null text is empty.  Rows of equal order are ordered by their texts' hashes.  An empty table gives an empty one.
    """
    key = docs.schema[order_col]
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("keys", T.ArrayType(key.dataType)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField(
                "levels",
                T.ArrayType(T.StructType([T.StructField(c, T.BinaryType()) for c in ("chunks", "marks", "ranks")])),
            ),
        ]
    )
    rows = docs.select(order_col, text_col)
    ordered = rows.repartitionByRange(order_col, F.xxhash64(text_col)).sortWithinPartitions(order_col, F.xxhash64(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False).encode
        context = TaskContext.get()
        part, segment = context.partitionId() if context else 0, 0
        keys: list = []
        parts: list[np.ndarray] = []
        size, kind = 0, None

        def out() -> pa.RecordBatch:
            columns = [
                pa.array([part], pa.int32()),
                pa.array([segment], pa.int64()),
                pa.array([size], pa.int64()),
                pa.array([keys], pa.list_(kind)),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                pa.array([encode_levels(np.concatenate(parts))], pa.list_(_LEVEL)),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                ids, ends, _ = encode(batch.column(1))
                begins = np.concatenate(([0], ends[:-1])).tolist()
                for k, a, b in zip(batch.column(0).to_pylist(), begins, ends.tolist(), strict=True):
                    keys.append(k)
                    parts.append(np.append(ids[a:b], np.uint32(end_id)))
                    size += len(parts[-1])
                    if size >= _SEGMENT:
                        yield out()
                        keys, parts, size, segment = [], [], 0, segment + 1
        if keys:
            yield out()

    ordered.mapInArrow(lean(run, keeps=True), schema).write.option("compression", "zstd").parquet(path)


def read_codes(spark: SparkSession, path: str, key_name: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each document of the segments at ``path``: its key, ``start`` (the number of ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` and ``ids`` (or null).  Segments are decoded where they lie; only the
    narrow result is joined to the segments' running totals."""
    segments = spark.read.parquet(path)
    key = segments.schema["keys"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.LongType()),
            T.StructField(key_name, key),
            T.StructField("_at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                part, segment, keys, sizes, levels = (c[at] for c in whole.columns)
                sizes, codes = sizes.as_py(), Codes(levels.as_py())
                starts = (np.cumsum(sizes) - sizes).tolist()
                found = [codes.range(a, a + n) for a, n in zip(starts, sizes, strict=True)]
                columns = [
                    pa.array([part.as_py()] * len(sizes), pa.int32()),
                    pa.array([segment.as_py()] * len(sizes), pa.int64()),
                    keys.values,
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array(found if with_ids else [None] * len(found), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    # one row for each written partition, then a window inside each of them
    sums = segments.select("part", "segment", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    within = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_base")).join(parts, "part")
    found = segments.select("part", "segment", "keys", "sizes", "levels").mapInArrow(run, schema)
    out = found.join(bases, ["part", "segment"])
    return out.select(key_name, (F.col("_before") + F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_codes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(docs, byte_vocabulary(), path)
    return read_codes(spark, path, with_ids=False).drop("ids")
