"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents are tokenised in id order and laid end to end.  Cuts may fall at document ends (free), at sentence ends (a
small truncation penalty) and, inside very long sentences, at a grid of positions (a larger one).  The cost of a
sequence is its padding plus the penalty of the cut that ends it.  With f(j) the least cost up to position c(j),

    f(j) = penalty(j) + L - c(j) + min { f(i) + c(i) : c(j) - c(i) <= L },

so the minimum slides over a window and a monotone queue gives it in constant time.  Sequences whose length is a power
of two are not padded and are tried beside it.  Ranges of ids are packed in parallel; within a range the stream is
solved a bounded stretch at a time, and the open sequence at a stretch's end is carried into the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabloom.llm.common import lean, saved
from tabloom.llm.tokens import encoder

SENTENCE_PENALTY, INSIDE_PENALTY = 8, 64
#: Distance of cut positions inside a sentence that is longer than this.
_GRID = 256
#: The shortest unpadded sequence inside a stream, a power of two.
_SHORT = 256
#: Tokens that are solved at once.
_STRETCH = 1 << 18
_CHUNK = 1000

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def candidates(ends: np.ndarray, stops: np.ndarray, last: bool, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) where the stream may be cut: 0, document ends, sentence ends, and a grid in long gaps.

    ``last``: the stream ends here, so any position of its last sequence is a candidate.
    """
    free = np.union1d([0], ends)
    some = np.union1d(free, stops)
    gap = np.diff(some)
    wide = np.flatnonzero(gap > _GRID)
    grid = [np.arange(some[k] + _GRID, some[k + 1], _GRID) for k in wide]
    if last:
        grid.append(np.arange(max(0, int(ends[-1]) - limit), int(ends[-1])))
    at = np.union1d(some, np.concatenate(grid)) if grid else some
    penalty = np.where(np.isin(at, free), 0, np.where(np.isin(at, stops), SENTENCE_PENALTY, INSIDE_PENALTY))
    return at.astype(np.int64), penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int, least_power: int = 1) -> tuple[list[int], int]:
    """The cuts of least cost from the first to the last candidate, both included, and that cost.

    Unpadded sequences of a power of two are tried from ``least_power`` tokens on.
    """
    n = len(at)
    exact: dict[int, list[int]] = {}
    power = least_power
    while power < limit:
        i = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[np.minimum(i, n - 1)] == at - power)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        power *= 2
    c, pen = at.tolist(), penalty.tolist()
    f, before = [0] * n, [0] * n
    # the monotone queue: candidates by ascending f + c from `head` on
    queue: list[int] = []
    worth: list[int] = []
    head = 0
    for j in range(1, n):
        new = f[j - 1] + c[j - 1]
        while len(worth) > head and worth[-1] >= new:
            worth.pop()
            queue.pop()
        worth.append(new)
        queue.append(j - 1)
        low = c[j] - limit
        while c[queue[head]] < low:
            head += 1
        i = queue[head]
        cost = worth[head] - low
        if j in exact:
            for k in exact[j]:
                if f[k] < cost:
                    cost, i = f[k], k
        f[j], before[j] = cost + pen[j], i
    cuts, j = [c[-1]], n - 1
    while j:
        j = before[j]
        cuts.append(c[j])
    return cuts[::-1], f[-1]


class _Stream:
    """The open stretch of one range of documents."""

    def __init__(self, limit: int, with_ids: bool) -> None:
        self.limit, self.sequence, self.with_ids = limit, 0, with_ids
        self.docs: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # row, position in it, its tokens, ids, stops
        self.tokens = 0

    def add(self, row: int, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append((row, 0, len(ids), ids, stops))
        self.tokens += len(ids)

    def solve(self, last: bool) -> Iterator[tuple]:
        """Pieces (row, start, length, crc, doc_tokens, sequence, offset, ids); the open sequence stays unless last."""
        size = np.array([len(d[3]) for d in self.docs])
        end = np.cumsum(size)
        begin = end - size
        ids = np.concatenate([d[3] for d in self.docs])
        stops = np.concatenate([d[4] + b for d, b in zip(self.docs, begin.tolist(), strict=True)])
        # short sequences are worth trying only where the stream ends
        cuts, _ = best_cuts(*candidates(end, stops, last, self.limit), self.limit, 1 if last else _SHORT)
        if not last:
            cuts = cuts[:-1]
        done = cuts[-1]
        starts = np.union1d(begin[begin < done], np.array(cuts[:-1], np.int64))
        which = np.searchsorted(begin, starts, "right") - 1
        seq = np.searchsorted(cuts, starts, "right") - 1
        wide = ids.astype("<u4")
        for a, b, d, s in zip(starts.tolist(), [*starts[1:].tolist(), done], which.tolist(), seq.tolist(), strict=True):
            row, at, total, _, _ = self.docs[d]
            raw = wide[a:b].tobytes()
            yield row, at + a - int(begin[d]), b - a, zlib.crc32(raw), total, self.sequence + s, a - cuts[s], raw if self.with_ids else None
        self.sequence += len(cuts) - 1
        rest = []
        for d, (row, at, total, own, marks) in enumerate(self.docs):
            skip = max(0, done - int(begin[d]))
            if skip < len(own):
                rest.append((row, at + skip, total, own[skip:], marks[marks > skip] - skip))
        self.docs, self.tokens = rest, int(end[-1]) - done


def pack(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    order_col: str = "doc_id",
    limit: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """Pack the documents, in the order of ``order_col``, into sequences of at most ``limit`` tokens.

    A document is its ids and ``end_id``; a null text is empty, so every row has a piece.  Returns one row for each
    piece: the input columns without the text, and ``start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``
    (little-endian unsigned 32-bit; null unless wanted).  Rows of equal order keep the order of their texts' hashes.
    Sequence ids ascend in document order, gapless from 0.  The pieces are written to the shared folder once.  Input columns of these names are replaced.
    """
    docs = docs.drop(*[c for c in PIECES.names if c != order_col])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    ordered = docs.repartitionByRange(order_col, F.xxhash64(text_col)).sortWithinPartitions(order_col, F.xxhash64(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        stream = _Stream(limit, with_ids)
        open_rows: dict[int, dict] = {}
        n = 0

        def out(last: bool) -> pa.RecordBatch:
            pieces = list(stream.solve(last))
            rows = [open_rows[p[0]] for p in pieces]
            for k in set(open_rows) - {d[0] for d in stream.docs}:
                del open_rows[k]
            types = [pa.int64()] * 6 + [pa.binary()]
            own = [pa.array([p[k + 1] for p in pieces], types[k]) for k in range(7)]
            other = [pa.array([r[f.name] for r in rows], keep.field(f.name).type) for f in kept]
            parts = pa.array([part] * len(pieces), pa.int32())
            return pa.RecordBatch.from_arrays([*other, *own, parts], [*(f.name for f in kept), *PIECES.names, "_part"])

        keep = None
        for whole in batches:
            keep = whole.schema
            for at in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(at, _CHUNK)
                ids, ends, stops = encode(batch.column(keep.get_field_index(text_col)))
                begins = np.concatenate(([0], ends[:-1])).tolist()
                cuts = np.searchsorted(stops, ends, "right").tolist()
                rows = batch.drop_columns([text_col]).to_pylist() if kept else [{}] * batch.num_rows
                seen = 0
                for row, a, b, cut in zip(rows, begins, ends.tolist(), cuts, strict=True):
                    open_rows[n] = row
                    stream.add(n, np.append(ids[a:b], np.uint32(end_id)), stops[seen:cut] - a)
                    seen = cut
                    n += 1
                    if stream.tokens >= _STRETCH:
                        yield out(False)
        if stream.docs:
            yield out(True)

    schema = T.StructType([*kept, *PIECES.fields, T.StructField("_part", T.IntegerType())])
    pieces = saved(ordered.mapInArrow(lean(run, keeps=True), schema), "pieces")
    # one row for each range: the sequences of the ranges before it
    counts = pieces.groupBy("_part").agg((F.max("sequence_id") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.join(counts.select("_part", before.alias("_before")), "_part")
    placed = placed.withColumn("sequence_id", F.col("sequence_id") + F.col("_before"))
    return placed.select(*[f.name for f in kept], *PIECES.names)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, word_vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
