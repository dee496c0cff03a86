"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  A long run of one symbol is cut into phrases of three, a short one counts as one symbol; deterministic coin tossing (the lowest bit in which
a symbol differs from the one before it) shrinks the symbols in four rounds to six colours, and those to three; phrases
begin where a colour is larger than both neighbours; and a phrase's name is the symbol of the next level.  Where a
phrase begins depends on a few symbols around it only, so equal substrings have equal phrases but for some at their
edges, wherever they stand.  A fingerprint samples the names of three levels (the first, second, third time of
a name are names of their own), each in ``SLOTS`` slots, and the likeness of two fingerprints is the share of phrases
they have in common.  All steps are whole-array numpy on a block of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import saved, scratch

LEVELS = 3
SLOTS = 64
#: The value of a slot without a name; a slot is spelt with four hex digits.
EMPTY = 0xFFFF
#: Slots that both must have filled before a level is compared; the level of the longest phrases that has them counts.
FILLED = 12
#: A run of so many equal symbols is cut into phrases by itself.
LONG_RUN = 4
#: Code points that are parsed at once, if no single text has more.
BLOCK = 400_000
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: The number of the lowest set bit of 16-bit numbers.
_LOWEST = np.array([16] + [(x & -x).bit_length() - 1 for x in range(1, 1 << 16)], np.uint8)


def _toss(colour: int, before: int) -> int:
    """2 k + bit k of a colour, with k the lowest bit in which it differs from the one before."""
    low = (colour ^ before) & -(colour ^ before)
    return 2 * (low.bit_length() - 1) + bool(colour & low)


#: By 128 * colour + colour before.
_TOSSED = np.array([_toss(c, b) if c != b else 0 for c in range(128) for b in range(128)], np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + _ODD[2]
    x ^= x >> np.uint64(30)
    x *= _ODD[0]
    x ^= x >> np.uint64(27)
    x *= _ODD[1]
    x ^= x >> np.uint64(31)
    return x


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol within a text as one symbol, the repeated symbols, their numbers and the places where texts begin."""
    start = np.empty(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=start[1:])
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(at, append=len(names))
    own = names[at]
    names = own.copy()
    several = np.flatnonzero(size > 1)
    names[several] = _mixed(own[several] ^ (size[several].astype(np.uint64) * _ODD[2]))
    return names, own, size, np.searchsorted(at, first)


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Colours below 6 in which neighbours differ, by four rounds of coin tossing; a text's first symbol counts its lowest bit."""
    differs = np.empty_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=differs[1:])
    differs[first] = 1
    k = _LOWEST[(differs & np.uint64(0xFFFF)).astype(np.uint16)]
    for at in np.flatnonzero(k == 16).tolist():  # one in 65,536
        k[at] = (int(differs[at]) & -int(differs[at])).bit_length() - 1
    colour = 2 * k + ((names >> k.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        pair = colour.astype(np.uint16) << np.uint16(7)
        pair[1:] |= colour[:-1]
        begun = colour[first] & 1
        colour = _TOSSED[pair]
        colour[first] = begun
    return colour


def _beside(colour: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The colours before and after each symbol in its text, 9 where there is none."""
    before, after = np.full(len(colour), 9, np.uint8), np.full(len(colour), 9, np.uint8)
    before[1:], after[:-1] = colour[:-1], colour[1:]
    before[first] = 9
    after[first[1:] - 1] = 9
    return before, after


def _parsed(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level and the places where texts begin among them."""
    names, own, run, first = _runs(names, first)
    colour = _tossed(names, first)
    for high in (5, 4, 3):
        before, after = _beside(colour, first)
        at = np.flatnonzero(colour == high)
        b, a = before[at], after[at]
        colour[at] = np.where((b != 0) & (a != 0), 0, np.where((b != 1) & (a != 1), 1, 2))
    before, after = _beside(colour, first)
    start = ((colour > before) | (before == 9)) & ((colour > after) | (after == 9))
    start[first] = True
    long = np.flatnonzero(run >= LONG_RUN)
    start[long] = True
    start[long[long + 1 < len(start)] + 1] = True
    at = np.flatnonzero(start)
    size = np.diff(at, append=len(names))
    sums = names[at] * _ODD[0]
    for place in range(1, int(size.max())):
        some = np.flatnonzero(size > place)
        sums[some] += names[at[some] + place] * _ODD[place]
    first = np.searchsorted(at, first)
    if not len(long):
        return _mixed(sums), first
    # a long run is as many phrases of three symbols as fit, and one of the rest
    phrase, n, base = np.searchsorted(at, long), run[long], own[long] * _ODD[5]
    sums[phrase] = base + np.uint64(3)
    times = np.ones(len(at), np.int64)
    times[phrase] = -(-n // 3)
    end = np.cumsum(times)
    sums = np.repeat(sums, times)
    rest = np.flatnonzero(n % 3)
    sums[end[phrase[rest]] - 1] = base[rest] + (n[rest] % 3).astype(np.uint64)
    return _mixed(sums), (end - times)[first]


def _slots(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A value of the least name in each slot of each text; a name that comes again in a text is a name of its own."""
    least = np.full(len(first) * SLOTS, 1 << 63, np.uint64)
    doc = np.repeat(np.arange(len(first)), np.diff(first, append=len(names)))
    key = names ^ (doc.astype(np.uint64) * _ODD[3])
    by = np.argsort(key)
    key = key[by]
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(fresh, append=len(key))
    if len(fresh) < len(key):
        times = np.arange(len(key)) - np.repeat(fresh, count)
        again = np.flatnonzero(times)
        names = names.copy()
        names[by[again]] = _mixed(names[by[again]] + times[again].astype(np.uint64) * _ODD[4])
    np.minimum.at(least, doc * SLOTS + (names & np.uint64(SLOTS - 1)).astype(np.int64), names >> np.uint64(6))
    values = np.minimum(_mixed(least) & np.uint64(EMPTY), np.uint64(EMPTY - 1)).astype(np.uint16)
    values[least == 1 << 63] = EMPTY
    return values.reshape(len(first), SLOTS)


def sketches(texts: list[str]) -> np.ndarray:
    """Slots of each text and level: an array of texts x ``LEVELS`` x ``SLOTS``."""
    out = np.full((len(texts), LEVELS, SLOTS), EMPTY, np.uint16)
    size = np.array([len(t) for t in texts], np.int64)
    held = np.flatnonzero(size)
    if not len(held):
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = (np.cumsum(size) - size)[held]
    for level in range(LEVELS):
        names, first = _parsed(names, first)
        out[held, level] = _slots(names, first)
    return out


def spelt(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16).reshape(LEVELS, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common phrases among the phrases of both (twice the common by the sum), of sketches in the last two axes.

    Compared is the highest level in which both have ``FILLED`` slots, else the lowest.  Equal slots estimate the share j of
    common phrases among all, and 2 j / (1 + j) is the share that each has in common.  Two empty sketches are alike.
    """
    filled = (np.minimum((a < EMPTY).sum(-1), (b < EMPTY).sum(-1)) >= FILLED).astype(np.int64)
    level = np.where(filled.any(-1), LEVELS - 1 - np.argmax(filled[..., ::-1], -1), 0)[..., None, None]
    a, b = (np.take_along_axis(x, level, -2)[..., 0, :] for x in (a, b))
    either = ((a < EMPTY) | (b < EMPTY)).sum(-1)
    common = ((a == b) & (a < EMPTY)).sum(-1)
    j = np.where(either > 0, common / np.maximum(either, 1), 1.0)
    return 2 * j / (1 + j)


def _by_size(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``BLOCK`` code points or one text."""
    low = total = 0
    for k, text in enumerate(texts):
        if k > low and total + len(text) > BLOCK:
            yield low, k
            low, total = k, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)


def _fingerprint(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "").to_pylist()
            found = [spelt(s) for low, high in _by_size(texts) for s in sketches(texts[low:high])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "fingerprint"])

    return run


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input columns and ``fingerprint``, a string of ``LEVELS * SLOTS * 4`` hex digits.

    Equal texts have equal fingerprints; null and empty texts have the fingerprint of nothing.  Texts are read whole
    whatever their length; one text is one task's work.  Rows are independent of each other, so repeated rows and
    ids change nothing, and an empty table gives no rows.  A column ``fingerprint`` is replaced.
    """
    docs = docs.drop("fingerprint")
    return docs.mapInArrow(_fingerprint(text_col), T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Row(NamedTuple):
    doc: int | None
    text: str
    guest: bool
    sketch: np.ndarray


_NEAR = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _told(rows: list[_Row], following: list[_Row]) -> Iterator[pa.RecordBatch]:
    """The columns of ``rows``, with the document after each of them."""
    texts = [edited(r.text, f.text) for r, f in zip(rows, following, strict=True)]
    for low, high in _by_size(texts):
        changed = sketches(texts[low:high])
        own = np.stack([r.sketch for r in rows[low:high]])
        after = np.stack([r.sketch for r in following[low:high]])
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.array([r.doc for r in rows[low:high]], pa.int64()),
                "n_chars": pa.array([len(r.text) for r in rows[low:high]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts[low:high]],
                "fingerprint": [spelt(s) for s in own],
                "edited_fingerprint": [spelt(s) for s in changed],
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, after),
            }
        )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document with the row after it; each part ends with a guest, which is a follower only."""
    held: list[_Row] = []
    for batch in batches:
        ids, guests = batch.column("id").to_pylist(), batch.column("guest").to_pylist()
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        for low, high in _by_size(texts):
            found = zip(ids[low:high], texts[low:high], guests[low:high], sketches(texts[low:high]), strict=True)
            rows = held + [_Row(*r) for r in found]
            pairs = [(r, f) for r, f in zip(rows, rows[1:], strict=False) if not r.guest]
            if pairs:
                yield from _told(*map(list, zip(*pairs, strict=True)))
            held = rows[-1:]


def _bounds(keyed: DataFrame, parts: int) -> list[tuple[int, int]]:
    """At most ``parts - 1`` keys that deal the rows about evenly, from the ``64 * parts`` rows of least hash."""
    sample = keyed.orderBy(F.xxhash64("k", "h", F.monotonically_increasing_id())).limit(64 * parts).select("k", "h").collect()
    keys = sorted((r["k"], r["h"]) for r in sample)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _part(bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds at or before a row's key, by binary search in two constant arrays."""
    if not bounds:
        return F.lit(0)
    ks, hs = (F.split(F.lit(",".join(map(str, side))), ",").cast("array<bigint>") for side in zip(*bounds, strict=True))
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        k, h = F.get(ks, at + step - 1), F.get(hs, at + step - 1)
        return F.when((k < F.col("k")) | ((k == F.col("k")) & (h <= F.col("h"))), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document beside an edited copy of it and beside the next document, by descending id (whole numbers).

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many (or all) of the next
    document; after the last document comes the first.  Returns one row for each row of ``docs``: the id, ``n_chars`` (code
    points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` (see ``likeness``).
    Null texts are empty; null ids come last; rows of one id are ordered by a hash of their text, so that even a
    third of all rows may share one, and equal rows follow each other.  A single document follows itself; an empty
    table gives no rows.  Texts are read whole whatever their length.  Other columns, whatever their names, are left out.

    Rows are dealt by ranges of id and hash into ``parts`` (``spark.sql.shuffle.partitions``), which is the only time that
    texts cross the network.  The first document of each part goes to the part before as well, as the follower of its
    last one.  A row's part depends on the row alone, so lost tasks come out the same when they run again.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the complement turns the order of whole numbers round
    key = F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1))
    rows = rows.withColumns({"k": key, "h": F.coalesce(F.xxhash64("text"), F.lit(0))})
    rows = rows.withColumn("part", _part(_bounds(rows, parts)))
    with scratch(spark):
        # at most one row for each part
        first = rows.groupBy("part").agg(F.min(F.struct("k", "h")).alias("_first")).select(F.col("part").alias("_part"), "_first.*")
        first = saved(first, "parsing-first").toDF("_part", "_k", "_h")
        heads = rows.join(F.broadcast(first), (F.col("part") == F.col("_part")) & (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")))
        heads = saved(heads.dropDuplicates(["part"]).select("id", "text", "k", "h", "part"), "parsing-heads", keep=True)
    by = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(by), F.max("part").over(Window.partitionBy(F.lit(0))))
    guests = heads.withColumn("part", before).withColumn("guest", F.lit(True))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartitionById(parts, "part")
    dealt = dealt.sortWithinPartitions("part", "guest", "k", "h").select("id", "text", "guest")
    return dealt.mapInArrow(_in_order, _NEAR).withColumnRenamed("id", id_col)


def op13_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edit_likeness(docs)
