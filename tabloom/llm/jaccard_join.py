"""Exact Jaccard self-join of word n-gram sets in their metric space.

Distance d = 1 - J is a metric, and two sets within r of each other share one of the first floor(r n) + 1 shingles of
each, whatever order of shingles is fixed.  Two proofs of "further apart than r" follow from that, and the join uses both:

1.  Equal sets become one point.
2.  Voronoi regions.  Points that share least hashes elect the least id as pivot; a point within r joins the nearest
    pivot.  Each region has its covering radius R; a point that no pivot reached is a region of its own.
3.  Meeting.  Every point shows the least hashes of its set, a little more than floor(r n) + 1 of them, without the very
    frequent shingles.  Regions that meet in a shingle of at most ``_CROWD`` regions become a pair, which goes on if the
    shingles they share allow a link.  In a crowded shingle no pairs are made; each region is only told so.  A region
    whose points all keep floor(r n) + 1 uncrowded shingles is settled: whatever lies within r of it met it there.  The
    others show as many more hashes as they lack and meet in these by the same rule: those who showed a hash before are
    crowded apart from those who show it now.  What is still not settled then is the crowd.  A set within r of another
    has few hashes below the other's last one that the other lacks, so the crowd shows the settled regions its hashes up
    to a bound, not whole sets.
4.  Recursion.  The centres of the crowd are joined by the same steps with the radius r + R + R'; while they stay
    crowded, pivots of a doubled radius are elected among them, and so on.
5.  Windows.  Where two centres are no further apart than r + R + R', the boundary documents - those that the triangle
    inequality cannot keep from the other region - are replicated into a join of the two regions, in bounded blocks.

All distances are computed exactly on whole sets (of 63-bit shingle hashes).  Pairs are made only in shingles of at most
``_CROWD`` regions, so their number grows with the rows; a group of near copies costs one distance a document, and only
where all its links are asked for is it compared block by block, which leaves one count a document and block.
The table of very frequent shingles and the one of the crowd's shingles have a fixed size.  They decide cost, never results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import buckets, lean, packed, saved, scratch
from tabloom.llm.components import components

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words that are hashed at once, bits of the table of frequent shingles, and of the table of the crowd's shingles.
_WORDS, _SLOT_BITS, _CROWD_BITS = 1 << 15, 20, 24
#: Shingles that are counted at once, and the count in such a stretch from which one counts as frequent there; a shingle
#: is frequent if that is so in one of ``_PART`` stretches.
_STRETCH, _OFTEN, _PART = 1 << 21, 4, 8
#: Regions of one shingle beyond which it is crowded, and regions of one list of a crowded shingle.
_CROWD, _LISTED = 12, 64
#: Least hashes by which a point meets others in an election, and rounds of elections.
_KEYS, _ROUNDS = 4, 2
#: Points that are compared in blocks at once, without more steps.
_LEAF = 1024
#: Points and shingles of one side of a block, and points that one task compares with one pivot.
_BLOCK, _BLOCK_SHINGLES = 128, 1 << 20

#: Columns of a set but for its id, as no rows have them.
_SET_COLUMNS = ("CAST(NULL AS INT) n", "CAST(NULL AS INT) hot", "CAST(NULL AS ARRAY<BIGINT>) keys", "CAST(NULL AS BINARY) shingles")

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        steps = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
        for s in steps:
            s[0] = 1
        _powers = (np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1]))
    return _powers


def shingle_hashes(text: bytes | None, k: int = 5) -> np.ndarray:
    """The set of 63-bit hashes of the k-word shingles of a text, ascending; fewer words make one shingle.

    Words are what ASCII white space parts, with A-Z lower-cased.  All windows of a stretch come from one running
    polynomial sum over its bytes, so the work is a few passes over the text.
    """
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    parts = []
    for at in range(0, len(words) - k + 1, _WORDS):
        raw = np.frombuffer(b" ".join(words[at : at + _WORDS + k - 1]), np.uint8)
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        gaps = np.flatnonzero(raw == 32)
        begin = np.concatenate(([0], gaps + 1))
        end = np.concatenate((gaps, [len(raw)]))
        begin, end = begin[: len(begin) - k + 1], end[k - 1 :]
        v = (total[end] - total[begin]) * inverse[begin]
        v ^= v >> np.uint64(33)
        v *= np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xC4CEB9FE1A85EC53)
        v ^= v >> np.uint64(32)
        parts.append(v >> np.uint64(1))
    return np.unique(np.concatenate(parts))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _small(batches: Iterator[pa.RecordBatch], n: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _table(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of 2**bits slots, the lowest first: whether it occurs in the column ``slot``.

    At most 2**bits / 32768 rows of 4 KB reach the driver, and the bits stay packed there.
    """
    one = F.col("slot") + 1  # Spark's positions begin at 1
    rows = slots.groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        at = (r["b"] - 1) << 12
        out[at : at + (1 << 12)] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(out) - at]
    return out


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(63 - bits)).astype(np.int64)


def frequent_slots(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """A table of hash slots that hold a shingle found in several documents of many stretches; all texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            slots = np.unique(_slots(values[counts >= _OFTEN], _SLOT_BITS))
            return pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1))], ["slot"])  # -1 counts the stretch

        for batch in _small(batches):
            for text in _texts(batch, 0):
                held.append(shingle_hashes(text, k))
                n += len(held[-1])
                if n >= _STRETCH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    counts = saved(docs.select(text_col).mapInArrow(lean(run), "slot long").groupBy("slot").count(), "frequent-slots")
    stretches = counts.where("slot = -1").agg(F.sum("count")).first()[0] or 0
    often = _table(counts.where((F.col("slot") >= 0) & (F.col("count") * _PART >= stretches)), _SLOT_BITS)
    return np.unpackbits(often, bitorder="little").astype(bool)


def _points(docs: DataFrame, k: int, percent: int, often: np.ndarray) -> DataFrame:
    """(id, text, n, f1, f2, keys, shown, window) of each (id, text): size, fingerprint, keys of elections, hashes shown to others."""
    schema = "id long, text string, n int, f1 long, f2 long, keys array<long>, shown int, window binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n, f1, f2, keys, shown, window = [], [], [], [], [], []
            for text in _texts(batch, 1):
                h = shingle_hashes(text, k)
                n.append(len(h))
                if not len(h):
                    for c in (f1, f2, keys, shown, window):
                        c.append(None)
                    continue
                f = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                f1.append(int(f[0]))
                f2.append(int(f[1]))
                rare = h[~often[_slots(h, _SLOT_BITS)]]
                keys.append(h[:_KEYS].view(np.int64).tolist())
                h = rare[: _first_shown(n[-1], percent)]
                shown.append(len(h))
                window.append(h.tobytes())
            columns = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in ((n, pa.int32()), (f1, pa.int64()), (f2, pa.int64()), (keys, pa.list_(pa.int64())), (shown, pa.int32()), (window, pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n", "f1", "f2", "keys", "shown", "window"])

    return docs.mapInArrow(lean(run), schema)


def _first_shown(n: int, percent: int) -> int:
    return n * (100 - percent) // 100 + n // 20 + 2


def _far_enough(n: int, percent: int, times: int = 1) -> int:
    """How many least hashes of a set of ``n`` reach past the last hash that any set within the distance shows.

    A set of m hashes shows m * f + 2 at first, m is at most n * 100 / percent, and of the hashes up to that end the
    other has at most the same ones and those that the first lacks, (100 - percent) / 100 of n.  ``times`` = 2: past what
    those show who were allowed to show so many themselves.
    """
    q, f = percent / 100, (100 - percent) / 100 + 0.05
    for _ in range(times):
        f = f / q + 1 - q
    return int(f * n) + 2 + 2 * times


def _further(docs: DataFrame, wanted: DataFrame, k: int, percent: int, often: np.ndarray, times: int) -> DataFrame:
    """(id, n, shown, window) of the ``wanted`` (id, seen, more): ``more`` hashes after the first ``seen`` (null: those
    shown at first), up to the bound of ``times``, and how many are shown in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n, shown, window = [], [], []
            for text, seen, more in zip(_texts(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                h = shingle_hashes(text, k)
                n.append(len(h))
                h = h[~often[_slots(h, _SLOT_BITS)]]
                seen = _first_shown(n[-1], percent) if seen is None else seen
                h = h[: max(seen, min(seen + more, _far_enough(n[-1], percent, times)))]
                shown.append(len(h))
                window.append(h[seen:].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(shown, pa.int32()), pa.array(window, pa.binary())], ["id", "n", "shown", "window"])

    return docs.join(wanted, "id").select("id", "text", "seen", "more").mapInArrow(lean(run), "id long, n int, shown int, window binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, often: np.ndarray) -> DataFrame:
    """(id, n, hot, keys, shingles) of the ``wanted`` ids: size, frequent shingles, least hashes, the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            made = [shingle_hashes(t, k) for t in _texts(batch, 1)]
            hot = [int(often[_slots(h, _SLOT_BITS)].sum()) for h in made]
            keys = pa.array([h[:_KEYS].view(np.int64).tolist() for h in made], pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array([len(h) for h in made], pa.int32()), pa.array(hot, pa.int32()), keys, pa.array([h.tobytes() for h in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "hot", "keys", "shingles"])

    chosen = docs.join(wanted, "id", "left_semi").select("id", "text")
    return chosen.mapInArrow(lean(run), "id long, n int, hot int, keys array<long>, shingles binary").where("n > 0")


class _Sets:
    """The whole sets of the documents that were asked for, each made once.

    Texts (``docs``) and sets are bucketed by id: what asks for them is shuffled, they are not.
    """

    def __init__(self, docs: DataFrame, k: int, often: np.ndarray) -> None:
        self.docs, self.k, self.often = docs, k, often
        self.asked, self.parts = _none(docs.sparkSession, "id"), []

    def of(self, ids: DataFrame) -> _Sets:
        missing = saved(ids.distinct().join(self.asked, "id", "left_anti"), "missing-sets")
        if not missing.isEmpty():
            self.asked = self.asked.union(missing)
            self.parts.append(saved(_sets(self.docs, missing, self.k, self.often), "sets", key="id"))
        return self

    def beside(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with ``columns`` of the set of their ``id``."""
        empty = _none(self.docs.sparkSession, "id", *_SET_COLUMNS)
        joined = [rows.join(part.select("id", *columns), "id") for part in self.parts or [empty]]
        return reduce(DataFrame.union, joined)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _rows(points: DataFrame, skip: np.ndarray | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(s, id, n): a row for each hash in the binary column of ``points`` (id, n, hashes), but for slots in ``skip``;
    with ``only``, of slots whose bit in it is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 200):
            sets = [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
            size = [len(h) for h in sets]
            s = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ids, n = (np.repeat(batch.column(c).to_numpy(), size) for c in (0, 1))
            keep = np.ones(len(s), bool) if skip is None else ~skip[_slots(s, _SLOT_BITS)]
            if only is not None:  # the bits stay packed, as the driver and each worker hold them
                at = _slots(s, _CROWD_BITS)
                keep &= (only[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(ids[keep]), pa.array(n[keep])], ["s", "id", "n"])

    return points.mapInArrow(lean(run), "s long, id long, n int")


def _counted(a: list[np.ndarray], b: list[np.ndarray], times: list[np.ndarray] | None = None) -> pa.RecordBatch:
    x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
    if times is None or not len(x):
        count = np.diff(np.append(first, len(x)))
    else:
        count = np.add.reduceat(np.concatenate(times)[order], first)
    return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(count.astype(np.int32))], ["a", "b", "c"])


def _alike(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes allow a similarity of ``least``; a negative size is one of a region of points that are as similar to its centre."""
    least = least ** (1.0 + (n < 0) + (m < 0))
    n, m = np.abs(n), np.abs(m)
    return np.minimum(n, m) >= np.maximum(n, m) * least - 1e-6


def _once(rows: np.ndarray) -> np.ndarray:
    """Sorted rows without those that repeat the hash and the region (and side) of the row before."""
    kept = rows[[k for k in range(len(rows)) if k != 2]]
    return rows[:, np.concatenate(([True], (kept[:, 1:] != kept[:, :-1]).any(axis=0)))] if rows.shape[1] else rows


def _meet(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, c): pairs that share c uncrowded shingles and may be as similar as ``least``; (a, null, c): a is in c crowded ones.

    A passage that several regions share is many shingles with the same regions.  Such shingles are counted together,
    under the list of their regions, before any pairs are made, so a passage costs its pairs once and not for every shingle.
    Regions of crowded shingles are told in the same way, by lists of at most ``_LISTED``.
    """
    most = _CROWD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_ = np.zeros((3, 0), np.int64), -1

        def told(ids: np.ndarray) -> pa.RecordBatch:
            values, counts = np.unique(ids, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.nulls(len(values), pa.binary()), pa.nulls(len(values), pa.bool_()), pa.array(counts.astype(np.int32))], ["a", "g", "many", "c"])

        def listed(raw: bytes, first: np.ndarray, size: np.ndarray, wide: int, many: bool) -> pa.RecordBatch:
            """Runs of ``wide`` bytes an entry, each list with how often it came."""
            step = _LISTED if many else most
            spans = ((f + at, f + min(at + step, k)) for f, k in zip(first.tolist(), size.tolist(), strict=True) for at in range(0, k, step))
            lists = Counter(raw[wide * low : wide * high] for low, high in spans)
            n = len(lists)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(list(lists), pa.binary()), pa.array([many] * n, pa.bool_()), pa.array(list(lists.values()), pa.int32())], ["a", "g", "many", "c"])

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            s, ids, n = rows
            if not len(s):
                return
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(first, len(s)))
            crowded = np.repeat(size > most, size)
            if crowded.any():
                yield listed(ids.tobytes(), first[size > most], size[size > most], 8, True)
            keep = ~crowded & np.repeat(size > 1, size)
            s, ids, n = s[keep], ids[keep], n[keep]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(s)))
            group = np.repeat(np.arange(len(first)), size)
            alive = np.zeros(len(first), bool)
            for step in range(1, min(most, len(s))):
                at = np.flatnonzero(s[step:] == s[:-step])
                if not len(at):
                    break
                ok = _alike(n[at], n[at + step], least) & (ids[at] != ids[at + step])
                alive[group[at[ok]]] = True
            if alive.any():
                yield listed(np.stack((ids, n), axis=1).tobytes(), first[alive], size[alive], 16, False)

        for batch in batches:
            rows = _once(np.concatenate((rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])), axis=1))
            if not rows.shape[1]:
                continue
            goes_on = np.searchsorted(rows[0], open_, "right")
            if goes_on:
                yield told(rows[1, :goes_on])
                rows = rows[:, goes_on:]
            cut = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
            yield from settle(rows[:, :cut])
            rest = rows[:, cut:]
            if rest.shape[1] > most:  # a crowded shingle is not held, however many points it has
                yield told(rest[1])
                rest, open_ = rest[:, :0], int(rest[0, 0])
        yield from settle(rest)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 20_000):
            a, b, times = [], [], []
            for raw, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, n = np.frombuffer(raw, np.int64).reshape(-1, 2).T
                i, j = np.triu_indices(len(ids), 1)
                ok = _alike(n[i], n[j], least) & (ids[i] != ids[j])
                x, y = ids[i[ok]], ids[j[ok]]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                times.append(np.full(len(x), c, np.int64))
            if a:
                yield _counted(a, b, times)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 20_000):
            ids = [np.frombuffer(raw, np.int64) for raw in batch.column(0).to_pylist()]
            if ids:
                values, at = np.unique(np.concatenate(ids), return_inverse=True)
                times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(at, weights=times).astype(np.int32))], ["a", "c"])

    dealt = rows.repartition("s").sortWithinPartitions("s", "id")
    met = saved(dealt.mapInArrow(lean(run), "a long, g binary, many boolean, c int"), "shared-shingles")
    lists = met.where("g IS NOT NULL").groupBy("g", "many").agg(F.sum("c").alias("c"))
    crowded = lists.where("many").select("g", "c").mapInArrow(lean(regions), "a long, c int").union(met.where("g IS NULL").select("a", "c"))
    crowded = crowded.select("a", F.lit(None).cast("long").alias("b"), "c")
    return lists.where("NOT many").select("g", "c").mapInArrow(lean(pairs), "a long, b long, c int").union(crowded)


def _meet_more(rounds: list[DataFrame], least: float) -> DataFrame:
    """(a, b, c): regions of the last of ``rounds`` (s, id, n) and of any that share c uncrowded shingles.

    Each round is crowded by itself: a shingle has pairs with the regions of a round if they are at most ``_CROWD``.
    (a, null, c): a is of the last round and in c shingles that are crowded in any.
    """
    most, last = _CROWD, len(rounds) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, open_ = np.zeros((4, 0), np.int64), -1

        def told(ids: np.ndarray) -> pa.RecordBatch:
            values, counts = np.unique(ids, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.nulls(len(values), pa.int64()), pa.array(counts.astype(np.int32))], ["a", "b", "c"])

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            t, y, m = rows[:3, rows[3] == last]
            crowded = np.zeros(len(t), bool)
            a, b = [], []
            for k in range(last + 1):
                s, x, n = rows[:3, rows[3] == k]
                start = np.searchsorted(s, t)
                count = np.searchsorted(s, t, "right") - start
                crowded |= count > most
                count[count > most] = 0
                for step in range(count.max(initial=0)):
                    at = np.flatnonzero(count > step)
                    to = start[at] + step
                    ok = _alike(n[to], m[at], least) & (x[to] < y[at] if k == last else x[to] != y[at])
                    a.append(np.minimum(x[to], y[at])[ok])
                    b.append(np.maximum(x[to], y[at])[ok])
            if a:
                yield _counted(a, b)
            if crowded.any():
                yield told(y[crowded])

        for batch in batches:
            rows = _once(np.concatenate((rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])), axis=1))
            if not rows.shape[1]:
                continue
            goes_on = np.searchsorted(rows[0], open_, "right")
            if goes_on:  # only the last round's rows of this shingle are left
                yield told(rows[1, :goes_on])
                rows = rows[:, goes_on:]
            cut = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
            yield from settle(rows[:, :cut])
            rest = rows[:, cut:]
            if (rest[3] == last).sum() > most:
                yield from settle(rest)
                rest, open_ = rest[:, :0], int(rest[0, 0])
            else:  # rounds that are crowded already are not held whole
                rest = np.concatenate([rest[:, rest[3] == k][:, : most + 1] for k in range(last + 1)], axis=1)
        yield from settle(rest)

    both = reduce(DataFrame.union, [rows.select("s", "id", "n", F.lit(k).alias("round")) for k, rows in enumerate(rounds)])
    return both.repartition("s").sortWithinPartitions("s", "round", "id").mapInArrow(lean(run), "a long, b long, c int")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))


def _measured(pairs: DataFrame, sets: _Sets) -> DataFrame:
    """(a, b, common, na, nb) of each row of ``pairs`` (a, b); a b with many a is dealt to several tasks."""
    n = pairs.count()
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("long").alias("salts"))
    salts = saved(packed(salts, n), "pivot-salts")
    asks = pairs.join(salts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"))
    gives = salts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    requests = saved(packed(asks.union(gives), 2 * n), "set-requests")
    rows = sets.beside(requests, "shingles").select("b", "salt", "kind", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in _small(batches, 2000):
            out = []
            for p, salt, kind, x, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (p, salt):
                    at, pivots = (p, salt), []
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    pivots.append(s)
                else:
                    out += [(x, p, _common(s, q), len(s), len(q)) for q in pivots]
            columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "na", "nb"])

    dealt = packed(rows.repartition("b", "salt"), 2 * n, 1000).sortWithinPartitions("b", "salt", "kind")
    return dealt.mapInArrow(lean(run), "a long, b long, common long, na long, nb long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``left`` has in common with each of ``right``, by products of 0/1 matrices."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), 1 << 13):
        part = both[at : at + (1 << 13)]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                to = np.searchsorted(part, s)
                m[i, to[part[to] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column of a link matrix is joined to within it."""
    left, right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], top).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _blocks(edge: DataFrame, sets: _Sets, percent: int, tally: bool) -> DataFrame:
    """Joins the two sides of each (a, b) of ``edge`` (a, b, side, id, n, radius) in blocks of bounded size.

    Two points are near where their distance is at most r and both their radii; a = b joins a table with itself, each
    pair once.  With ``tally`` (id, label, links): a row for each point and block in which it is near any, with the
    least id it is joined to there and how many; else the near pairs, as (id, label, links) with id < label.
    """
    side_of = lambda c, k: F.when(F.col("side") == k, c)
    blocks = lambda k: F.ceil(F.greatest(F.count(side_of(F.lit(1), k)) / _BLOCK, F.sum(side_of(F.col("n").cast("long"), k)) / _BLOCK_SHINGLES)).cast("long")
    sizes = saved(edge.groupBy("a", "b").agg(blocks(0).alias("na"), blocks(1).alias("nb")).where("na > 0 AND nb > 0"), "block-sizes")
    edge = edge.join(sizes, ["a", "b"])
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    left = edge.where("side = 0").select("a", "b", own("na").alias("i"), upto("nb").alias("j"), "side", "id", "radius")
    right = edge.where("side = 1").select("a", "b", upto("na").alias("i"), own("nb").alias("j"), "side", "id", "radius")
    keys = ["a", "b", "i", "j"]
    # within one table the block (j, i) would repeat (i, j)
    requests = saved(left.union(right).where("a <> b OR i <= j"), "block-requests")
    n = requests.count()
    rows = sets.beside(requests, "shingles").select(*keys, "side", "id", "radius", "shingles")
    r = 1 - percent / 100

    def compare(at: tuple, sides: list[list[tuple]]) -> Iterator[tuple]:
        if not sides[0] or not sides[1]:
            return
        (x, rx, left), (y, ry, right) = (zip(*side, strict=True) for side in sides)
        x, y, rx, ry = np.array(x), np.array(y), np.array(rx), np.array(ry)
        common = _overlaps(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
        near = common * 100 >= union * percent
        if rx.any() or ry.any():
            near |= 1 - common / union <= r + rx[:, None] + ry[None, :] + 1e-9
        near &= x[:, None] != y[None, :]
        if at[0] == at[1] and at[2] == at[3]:
            near &= x[:, None] < y[None, :]
        if not tally:
            for i, j in np.argwhere(near).tolist():
                yield int(min(x[i], y[j])), int(max(x[i], y[j])), 1
            return
        to_x, to_y = _labels(near, x, y)
        for ids, to, links in ((x, to_x, near.sum(axis=1)), (y, to_y, near.sum(axis=0))):
            for i in np.flatnonzero(links).tolist():
                yield int(ids[i]), int(to[i]), int(links[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, [[], []]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in range(3)], ["id", "label", "links"])

        for batch in _small(batches, 500):
            for a, b, i, j, side, x, radius, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (a, b, i, j):
                    if at:
                        yield batch_of(list(compare(at, sides)))
                    at, sides = (a, b, i, j), [[], []]
                sides[side].append((x, radius, np.frombuffer(raw, np.uint64)))
        if at:
            yield batch_of(list(compare(at, sides)))

    dealt = packed(rows.repartition(*keys), n, 1000).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(lean(run), "id long, label long, links long")


def _asked(windows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The rows (s, id, n) of ``windows``, and the packed table of their slots."""
    rows = _rows(windows)
    return rows, _table(rows.select(F.shiftright("s", 63 - _CROWD_BITS).alias("slot")), _CROWD_BITS)


def _none(spark: SparkSession, *columns: str) -> DataFrame:
    """No rows of long columns, or of other columns with an expression."""
    return spark.range(0).where("false").selectExpr(*[c if " " in c else f"id AS {c}" for c in columns])


class _Crowd:
    """The join of points that show their whole sets, by meeting, Voronoi regions and recursion on their centres."""

    def __init__(self, sets: _Sets, percent: int, often: np.ndarray, mode: str) -> None:
        self.sets, self.percent, self.often, self.mode = sets, percent, often, mode
        self.r = 1 - percent / 100
        self.spark = sets.docs.sparkSession

    def elect(self, points: DataFrame, radius: float) -> DataFrame:
        """(x, p, d) of the points that joined a pivot's region, by rounds of elections."""
        share = 1 - radius
        standing = points.select("id", "n", "keys")
        homes = _none(self.spark, "x", "p", "CAST(NULL AS DOUBLE) d")
        for _ in range(_ROUNDS):
            ballots = standing.select("id", "n", F.explode("keys").alias("key"))
            heads = ballots.groupBy("key").agg(F.min(F.struct("id", "n")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
            elected = saved(heads.select("key", F.col("m.id").alias("p"), F.col("m.n").alias("np")), "elected")
            met = ballots.join(elected, "key").where("id <> p").where(F.least("n", "np") >= F.greatest("n", "np") * share - 1e-6)
            # one common hash out of several seldom means a near copy
            met = met.groupBy(F.col("id").alias("a"), F.col("p").alias("b"), "n").agg(F.count(F.lit(1)).alias("c"))
            pairs = saved(met.where(F.col("c") >= F.least(F.lit(2), F.col("n"))).select("a", "b").distinct(), "pivot-pairs")
            if pairs.isEmpty():
                break
            near = saved(_measured(pairs, self.sets.of(_ends(pairs))).withColumn("d", _distance()).where(F.col("d") <= radius + 1e-9).select("a", "b", "d"), "pivot-distances")
            # a pivot is the centre of its own region, so it joins no other
            pivots = elected.select(F.col("p").alias("a")).distinct()
            joined = near.join(pivots, "a", "left_anti").groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
            home = saved(joined.select(F.col("a").alias("x"), F.col("m.b").alias("p"), F.col("m.d").alias("d")), "homes")
            homes = homes.union(home)
            settled = home.select(F.col("x").alias("id")).union(home.select(F.col("p").alias("id"))).distinct()
            standing = saved(standing.join(settled, "id", "left_anti"), "standing")
        return saved(homes, "region-homes")

    def near(self, points: DataFrame, level: int = 0) -> tuple[DataFrame, DataFrame]:
        """``points``: id, n, hot, keys, shingles, radius.  All pairs with d <= r + both radii, each once: in the first
        table (a, b, common, na, nb), or, at level 0 only, within the tallies (id, label, links) of the second."""
        pairs, tallies = _none(self.spark, "a", "b", "common", "na", "nb"), _none(self.spark, "id", "label", "links")
        widest = points.agg(F.max("radius")).first()[0]
        if widest is None:
            return pairs, tallies
        reach = self.r + 2 * widest
        if reach >= 1 - 1e-6 or points.count() <= _LEAF:
            return self.flat(points, level, pairs, tallies)
        size = F.when(F.col("radius") > 0, -F.col("n")).otherwise(F.col("n")).cast("int").alias("n")
        rows = _rows(points.select("id", size, "shingles"), skip=self.often)
        met = saved(_meet(rows, 1 - self.r if widest <= self.r + 1e-9 else 1 - reach), "crowd-meetings")
        told = met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("told"))
        info = points.select("id", "n", "hot", "radius").join(told, "id", "left")
        info = info.select("id", "n", "radius", (F.col("hot") + F.coalesce("told", F.lit(0))).alias("hidden"))
        unsettled = F.col("n") - F.col("hidden") <= F.floor((self.r + F.col("radius") + widest) * F.col("n") + 1e-6)
        info = saved(info.withColumn("dense", unsettled), "crowd-points")
        a, b = (info.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in info.columns[1:]]) for side in ("a", "b"))
        need = 1 - self.r - F.col("radius_a") - F.col("radius_b")
        need = need / (1 + need) * (F.col("n_a") + F.col("n_b")) - 1e-6
        counted = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("c").alias("c")).join(a, "a").join(b, "b")
        # pairs of two dense points come from the steps below
        counted = counted.where((F.col("c") + F.least("hidden_a", "hidden_b") >= need) & ~(F.col("dense_a") & F.col("dense_b")))
        chosen = saved(counted.select("a", "b", (F.col("radius_a") + F.col("radius_b")).alias("apart")).distinct(), "crowd-pairs")
        pairs = pairs.union(self.within(chosen))
        dense = saved(info.where("dense").select("id").distinct(), "crowded")
        if dense.isEmpty():
            return pairs, tallies
        crowd = saved(points.join(dense, "id", "left_semi"), "crowded-points")
        if crowd.count() <= _LEAF or (homes := self.elect(crowd, self.r * 2**level)).isEmpty():
            return self.flat(crowd, level, pairs, tallies)
        covers = homes.join(crowd.select(F.col("id").alias("x"), "radius"), "x").groupBy(F.col("p").alias("id")).agg(F.max(F.col("d") + F.col("radius")).alias("covers"))
        centres = crowd.join(homes.select(F.col("x").alias("id")).distinct(), "id", "left_anti").join(covers, "id", "left")
        centres = saved(centres.withColumn("many", F.col("covers").isNotNull()).withColumn("radius", F.greatest("radius", F.coalesce("covers", F.lit(0.0)))).drop("covers"), "centres")
        apart, _ = self.near(centres.drop("many"), level + 1)
        return self.members(crowd, homes, centres, apart, level, pairs, tallies)

    def within(self, chosen: DataFrame) -> DataFrame:
        """Pairs of ``chosen`` (a, b, apart) with d <= r + apart, measured."""
        got = saved(_measured(chosen.select("a", "b").distinct(), self.sets.of(_ends(chosen))), "pair-distances")
        near = F.when(F.col("apart") > 0, _distance() <= self.r + F.col("apart") + 1e-9).otherwise(_linked(self.percent))
        return got.join(chosen, ["a", "b"]).where(near).drop("apart")

    def joined(self, edge: DataFrame, level: int, pairs: DataFrame, tallies: DataFrame) -> tuple[DataFrame, DataFrame]:
        tally = level == 0 and self.mode != "pairs"
        got = saved(_blocks(edge, self.sets.of(edge.select("id")), self.percent, tally), "block-links")
        if tally:
            return pairs, tallies.union(got)
        found = got.select(F.col("id").alias("a"), F.col("label").alias("b")).distinct()
        if level == 0:  # links already, whatever their distance
            return pairs.union(found.select("a", "b", *[F.lit(None).cast("long")] * 3)), tallies
        return pairs.union(saved(_measured(found, self.sets.of(_ends(found))), "block-distances")), tallies

    def flat(self, points: DataFrame, level: int, pairs: DataFrame, tallies: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All against all in bounded blocks, for what neither shingles nor pivots part."""
        zero = F.lit(0).cast("long")
        edge = points.select(zero.alias("a"), zero.alias("b"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "id", "n", "radius")
        return self.joined(edge, level, pairs, tallies)

    def members(self, crowd: DataFrame, homes: DataFrame, centres: DataFrame, apart: DataFrame, level: int, pairs: DataFrame, tallies: DataFrame) -> tuple[DataFrame, DataFrame]:
        """From near centres (``apart``) to near members: boundary documents of both regions, joined in blocks."""
        of = centres.select("id", "radius", "many").distinct()
        at = [of.select(*[F.col(c).alias(f"{c}_{side}") for c in of.columns]) for side in ("a", "b")]
        apart = apart.withColumn("d", F.coalesce(_distance(), F.lit(0.0))).join(at[0], F.col("a") == F.col("id_a")).join(at[1], F.col("b") == F.col("id_b"))
        apart = saved(apart.select("a", "b", "common", "na", "nb", "d", "radius_a", "radius_b", (F.col("many_a") | F.col("many_b")).alias("many")), "near-centres")
        lone = apart.where("NOT many")
        if level == 0:
            lone = lone.where(_linked(self.percent))
        pairs = pairs.union(lone.select("a", "b", "common", "na", "nb"))
        wide = apart.where("many").select("a", "b", "d", F.col("radius_a").alias("ra"), F.col("radius_b").alias("rb"))
        if level == 0 and self.mode == "components":
            # the links inside a region and of regions that are one component already add nothing
            links = homes.select(F.col("x").alias("a"), F.col("p").alias("b")).union(apart.where(_linked(self.percent)).select("a", "b"))
            label = components(links)
            label_a, label_b = (label.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
            wide = wide.join(label_a, "a", "left").join(label_b, "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "d", "ra", "rb")
            tallies = tallies.union(links.select("a", "b", F.lit(0).cast("long")))
        else:
            wide = wide.union(of.where("many").select(F.col("id"), F.col("id"), F.lit(0.0), "radius", "radius"))
        wide = saved(wide, "near-regions")
        if wide.isEmpty():
            return pairs, tallies
        size = crowd.select(F.col("id").alias("x"), "n", "radius").distinct()
        inside = homes.select("x", "p", "d").union(of.select("id", "id", F.lit(0.0))).join(size, "x")
        inside = saved(inside.select(F.col("x").alias("id"), F.col("p").alias("region"), F.col("d").alias("own"), "n", "radius"), "region-members")
        row = ["a", "b", "side", "id", "n", "radius"]
        # a region is joined with itself, and with all the smaller regions near it at once
        itself = inside.join(wide.where("a = b"), F.col("region") == F.col("a")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(*row)
        sizes = inside.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        size_a, size_b = (sizes.select(F.col("region").alias(c), F.col("size").alias(f"size_{c}")) for c in ("a", "b"))
        pair = wide.where("a <> b").join(size_a, "a").join(size_b, "b").withColumn("first", F.col("size_a") >= F.col("size_b"))
        either = lambda x, y: F.when(F.col("first"), F.col(x)).otherwise(F.col(y))
        pair = saved(pair.select(either("a", "b").alias("a"), either("b", "a").alias("small"), "d", either("ra", "rb").alias("ra"), either("rb", "ra").alias("rb")), "oriented-regions")
        # documents nearer to their own centre are further from all of the other region than r
        beyond = self.r + F.col("radius") + 1e-9
        right = pair.join(inside, F.col("small") == F.col("region")).where(F.col("d") - F.col("own") <= F.col("ra") + beyond)
        least = pair.groupBy("a").agg(F.min(F.col("d") - F.col("rb")).alias("least"))
        left = least.join(inside, F.col("a") == F.col("region")).where(F.col("least") - F.col("own") <= beyond)
        edge = itself
        for k, side in enumerate((left, right)):
            edge = edge.union(side.select("a", F.bitwise_not("a").alias("b"), F.lit(k).alias("side"), "id", "n", "radius").distinct())
        return self.joined(saved(edge, "region-boundaries"), level, pairs, tallies)


def _near_centres(points: DataFrame, live: DataFrame, copies: DataFrame, placed: DataFrame, regions: DataFrame, by_region: Callable[[DataFrame, str], DataFrame], crowd_join: _Crowd, k: int) -> DataFrame:
    """(a, b, common, na, nb): the centres of ``regions`` that are near enough for a link of two members, by meeting."""
    sets, percent, often = crowd_join.sets, crowd_join.percent, crowd_join.often
    copied = copies.select(F.col("id").alias("copy"), F.col("f1").alias("c1"), F.col("f2").alias("c2"))
    # equal ids are the only join key, so that the buckets serve; equal fingerprints differ in no bit
    same = F.col("f1").bitwiseXOR(F.col("c1")).bitwiseOR(F.col("f2").bitwiseXOR(F.col("c2"))) == 0
    windows = live.join(copied, (F.col("id") == F.col("copy")) & same, "left_anti").select("id", "n", "window")
    windows = by_region(windows, "window")
    least = percent / 100
    met = saved(_meet(_rows(windows), least), "meetings")
    crowds = lambda met: met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("told"))
    regions = regions.join(crowds(met), "id", "left").withColumn("told", F.coalesce("told", F.lit(0).cast("long")))
    regions = saved(regions.withColumn("dense", F.col("margin") <= F.col("told")), "told-regions")
    crowd = saved(regions.where("dense").select("id"), "crowd")
    met = met.where("b IS NOT NULL")
    crowded = None
    if not crowd.isEmpty():
        # what they lack, at the rate at which their hashes were crowded, and as much again
        rate = 1 - F.least(F.lit(0.8), F.col("told") / F.greatest("shown", F.lit(1)))
        lack = regions.where("dense").select(F.col("id").alias("region"), (F.ceil(2 * (F.col("told") - F.col("margin") + 1) / rate) + 4).cast("int").alias("more"))
        wanted = placed.join(lack, "region").select("id", F.lit(None).cast("int").alias("seen"), "more").distinct()
        texts = points.select("id", "text")
        second = saved(_further(texts, saved(wanted, "second-wanted"), k, percent, often, 1), "second-windows")
        again, slots = _asked(by_region(second, "window"))
        met_again = saved(_meet_more([_rows(windows, only=slots), again], least), "second-meetings")
        shown = second.join(placed.select("id", "region").distinct(), "id").groupBy(F.col("region").alias("id")).agg(
            F.max(F.col("n") - F.col("shown")).alias("tail2"), F.min(F.col("shown") - F.floor(F.col("n") * (100 - percent) / 100)).alias("margin2")
        )
        regions = regions.join(shown, "id", "left").join(crowds(met_again).withColumnRenamed("told", "told2"), "id", "left")
        regions = regions.withColumn("told", F.col("told") + F.coalesce("told2", F.lit(0)))
        regions = regions.withColumn("dense", F.col("dense") & (F.col("margin2") <= F.col("told"))).withColumn("tail", F.coalesce("tail2", "tail"))
        regions = saved(regions.drop("tail2", "margin2", "told2"), "settled-regions")
        met = met.union(met_again.where("b IS NOT NULL"))
        crowd = saved(regions.where("dense").select("id"), "crowd-left")
        if not crowd.isEmpty():
            inside = saved(placed.join(crowd.withColumnRenamed("id", "region"), "region", "left_semi").select("id").distinct(), "crowd-members")
            wanted = second.join(inside, "id", "left_semi").select("id", F.col("shown").alias("seen"), F.col("n").alias("more"))
            third = saved(_further(texts, saved(wanted, "third-wanted"), k, percent, often, 2), "third-windows")
            at_last, slots = _asked(by_region(third, "window"))
            settled = [_rows(df.join(crowd, "id", "left_anti"), only=slots) for df in (windows, by_region(second, "window"))]
            met = met.union(saved(_meet_more([*settled, at_last], least), "third-meetings").where("b IS NOT NULL"))
            have = sets.of(crowd).beside(crowd, "n", "hot", "keys", "shingles")
            crowded = saved(have.join(regions.select("id", "radius"), "id"), "crowd-centres")
    # what the crowd has in common with a settled region was seen, or the settled one was told
    known = F.when(F.col("dense"), F.lit(1 << 40)).otherwise(F.col("told"))
    bounds = regions.select("id", "least", "radius", "tail", known.alias("told"), "dense")
    a, b = (bounds.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in bounds.columns[1:]]) for side in ("a", "b"))
    need = F.ceil((F.col("least_a") + F.col("least_b")) * percent / F.lit(100.0 + percent) - 1e-6)
    counted = met.groupBy("a", "b").agg(F.sum("c").alias("c")).join(a, "a").join(b, "b")
    # hashes up to the lesser end of two windows were seen, but for crowded ones; pairs within the crowd come later
    unseen = F.least("told_a", "told_b") + F.greatest("tail_a", "tail_b")
    pairs = counted.where((F.col("c") + unseen >= need) & ~(F.col("dense_a") & F.col("dense_b")))
    pairs = pairs.select("a", "b", (F.col("radius_a") + F.col("radius_b")).alias("apart"))
    near = crowd_join.within(saved(pairs.distinct(), "pairs"))
    return near if crowded is None else near.union(crowd_join.near(crowded, 1)[0])


def _join(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, mode: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points (id, n), members (id, rep), links (a, b) between representatives, tallies (id, label, links)).

    ``mode``: "pairs": ``links`` are all links and there are no tallies; "tallies": every link is in ``links`` or in the
    tallies, never in both; "components": as many as make the components.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    often = frequent_slots(docs, "text", k)
    # texts cross the network once, here; rows without an id take no part in the join
    dealt = docs.where("id IS NOT NULL").repartition(buckets(docs.sparkSession), "id")
    points = saved(_points(dealt, k, percent, often), "points", key="id")
    live = points.where("n > 0")
    equal = saved(live.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "equal-sets")
    members = live.select("id", "n", "shown", "keys", "f1", "f2").join(equal, ["f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    members = saved(members, "members")
    copies = saved(members.where("id <> rep").select("id", "f1", "f2").distinct(), "copies")
    reps = saved(members.where("id = rep").select("id", "n", "shown", "keys", F.lit(0.0).alias("radius")).distinct(), "representatives")
    sets = _Sets(points.select("id", "text"), k, often)
    crowd_join = _Crowd(sets, percent, often, mode)
    homes = crowd_join.elect(reps, 1 - percent / 100)

    # tail: hashes that no point of the region leaves unshown more of; margin: uncrowded hashes that all can spare
    placed = reps.join(homes.withColumnRenamed("x", "id"), "id", "left").withColumn("region", F.coalesce("p", "id"))
    tail, margin = F.col("n") - F.col("shown"), F.col("shown") - F.floor(F.col("n") * (100 - percent) / 100)
    regions = placed.groupBy(F.col("region").alias("id")).agg(
        F.count_distinct("id").alias("size"), F.coalesce(F.max("d"), F.lit(0.0)).alias("radius"), F.min("n").alias("least"), F.max(tail).alias("tail"), F.min(margin).alias("margin"), F.max("shown").alias("shown")
    )
    regions = saved(regions.withColumn("many", F.col("size") > 1), "regions")
    moved = homes.select(F.col("x").alias("id"), F.col("p").alias("region")).union(homes.select(F.col("p").alias("id"), F.col("p").alias("region"))).distinct()
    moved = saved(moved, "moved")
    by_region = lambda df, hashes: df.join(moved, "id", "left").select(
        F.coalesce("region", "id").alias("id"), F.when(F.col("region").isNotNull(), -F.col("n")).otherwise(F.col("n")).alias("n"), hashes
    )
    count, shingles = regions.agg(F.count(F.lit(1)), F.sum(F.col("least").cast("long"))).first()
    if 0 < count <= _LEAF and shingles <= _BLOCK_SHINGLES:
        # the centres of few regions need not meet before they are compared
        have = sets.of(regions.select("id")).beside(regions.select("id", "radius"), "n", "hot", "keys", "shingles")
        near, _ = crowd_join.near(saved(have, "few-centres"), 1)
    else:
        near = _near_centres(points, live, copies, placed, regions, by_region, crowd_join, k)
    none = _none(docs.sparkSession, "a", "b", "common", "na", "nb"), _none(docs.sparkSession, "id", "label", "links")
    near, tallies = crowd_join.members(reps, homes, regions.select("id", "radius", "many"), near, 0, *none)
    links = near.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nameless = _points(docs.where("id IS NULL"), k, percent, often)
    return points.union(nameless).select("id", "n"), members.select("id", "rep").distinct(), links, tallies


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), members (id, rep)): every pair a < b of different sets with 100 * common >= percent * union.

    A set stands for all documents that have it, under the least of their ids: ``rep`` of each ``id``.  Documents link
    if they have one ``rep`` or their ``rep``s link.  Ids are unique; null ids and empty sets are in neither table.
    A group of g sets that are all near each other has g * g / 2 links; ``jaccard_join`` counts them without a row each.
    """
    with scratch(docs.sparkSession):
        _, members, links, _ = _join(docs, id_col, text_col, k, percent, "pairs")
        return saved(links, "all-links", keep=True), saved(members, "all-members", keep=True)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row: its set size, the least id it is linked to over any path,
    and the number of other sets that its set links to (rows with an equal set are in the same component, not counted).

    Two documents link when 100 * common >= percent * union.  Ids are long integers, meant to be unique; of rows that
    share an id each gets the least component found for any of them.  Null and blank texts have empty sets and link
    with nothing.  A row with a null id keeps its set size and has a null component.  Repeated rows stay; texts of any
    length are read whole; an empty table gives an empty one.  Other columns of the input are not looked at.  Without
    ``count_links`` n_links is null, and links inside one component are not looked for.
    """
    with scratch(docs.sparkSession):
        points, members, links, tallies = _join(docs, id_col, text_col, k, percent, "tallies" if count_links else "components")
        links, tallies = saved(links, "all-links"), saved(tallies, "all-tallies")
        label = components(links.union(tallies.where("id <> label").select("id", "label")))
        ends = links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("links"))
        counts = ends.union(tallies.select("id", "links")).groupBy("rep").agg(F.sum("links").alias("n_links"))
        out = members.join(label.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "rep", "left")
        out = out.groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
        out = points.join(out, "id", "left")
        n_links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)
        return saved(
            out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), n_links.cast("long").alias("n_links")),
            "jaccard-join",
            keep=True,
        )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, every: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of ``jaccard_join``; links inside components are looked for with ``every`` only."""
    return jaccard_join(docs, id_col, text_col, k, percent, count_links=every).drop("n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id is the least of their component, with the input's columns; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col, **options)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op9_jaccard_join(spark, sf_dir):
    """The classes of all ``documents``, from the join that finds and counts every link."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("n_links")
