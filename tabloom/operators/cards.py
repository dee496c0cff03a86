"""Cards on pages: their boxes from drawn rectangles and lines, and one id for each card from several places.

Everything is keyed by (doc_id, page).  Lines are chained clusters of edges, what a line really covers is the union of its
edges, and a cell is closed only if all four sides are covered; no page is ever one group in Python but for small ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import epic_normalize
from tabloom.operators.segment import gap_clusters

PAGE = ("doc_id", "page")
#: Fixed shares of the page: the least and most width and height of a card drawn as a rectangle.
CARD_WIDTH, CARD_HEIGHT = (0.15, 0.5), (0.035, 0.2)
#: Fixed shares of the page that an edge must be longer than: across and down.
EDGE_LENGTH = (0.1, 0.03)
#: An edge is straight up to this slant; edges this near to the next are one line.
SLANT, LINE_STEP = 2.0, 8.0
#: Column bounds of the learned grid are chained up to this step.
GRID_STEP = 5.0
#: Fixed pattern of an id, and of an id in which letters stand for digits.
EPIC, LOOSE_EPIC = "(?<![A-Z0-9])[A-Z]{3}[0-9]{7}(?![0-9])", "(?<![A-Z0-9])[A-Z]{3}[0-9OIlSBZG]{7}(?![A-Z0-9])"


def _mean(value: Column, over=None) -> Column:
    """The mean, whatever order the values come in: they are added as decimals of 12 places, the sum is taken to 9.

    Sums of doubles differ by their order in the last place, which decides whether a card that ends with its page is one.
    Values beyond 1e14 are added as they are.
    """
    exact = value.try_cast("decimal(26,12)")
    total, n, n_exact, plain = F.sum(exact), F.count(value), F.count(exact), F.avg(value)
    if over is not None:
        total, n, n_exact, plain = (c.over(over) for c in (total, n, n_exact, plain))
    return F.when(n == n_exact, F.round(total, 9).cast("double") / F.nullif(n, F.lit(0))).otherwise(plain)


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts.

    A coalesce to more partitions than there are moves nothing.  It keeps the union from taking its parts as dealt alike,
    which fails where the runtime planner has given one of them other partitions.
    """
    first, *others = (p.coalesce(1 << 20) for p in parts)
    for other in others:
        first = first.unionByName(other)
    return first


def rect_cards(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """Rectangles of a card's size, on pages that have three or more of them."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    fits = w.between(F.col("width") * CARD_WIDTH[0], F.col("width") * CARD_WIDTH[1]) & h.between(
        F.col("height") * CARD_HEIGHT[0], F.col("height") * CARD_HEIGHT[1]
    )
    found = rects.select(*PAGE, "x0", "top", "x1", "bottom").join(pages, list(PAGE)).where(fits)
    found = found.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).where("_n >= 3")
    return found.select(*PAGE, "x0", "top", "x1", "bottom")


def ruled_lines(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, page, axis, line, pos, lo, hi): long straight edges, ``h`` across and ``v`` down, with the line each lies on.

    ``pos`` is the mean of the edges of a line, which are chained up to ``LINE_STEP``; ``lo`` and ``hi`` are the ends of the edge.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("bottom") - F.col("top"))
    across = (dy <= SLANT) & (dx > F.col("width") * EDGE_LENGTH[0])
    down = ~across & (dx <= SLANT) & (dy > F.col("height") * EDGE_LENGTH[1])
    e = edges.join(pages, list(PAGE)).withColumn("axis", F.when(across, "h").when(down, "v")).where("axis IS NOT NULL")
    flat = F.col("axis") == "h"

    def pick(a: str, b: str, fold) -> Column:
        return F.when(flat, fold(F.col(a), F.col(b))).otherwise(fold(*(F.col({"x0": "top", "x1": "bottom", "top": "x0", "bottom": "x1"}[c]) for c in (a, b))))

    e = e.select(
        *PAGE,
        "axis",
        pick("top", "bottom", lambda a, b: (a + b) / 2).alias("_at"),
        pick("x0", "x1", F.least).alias("lo"),
        pick("x0", "x1", F.greatest).alias("hi"),
    )
    lined = gap_clusters(e, [*PAGE, "axis"], "_at", LINE_STEP).withColumnRenamed("cluster", "line")
    return lined.withColumn("pos", _mean(F.col("_at"), W.partitionBy(*PAGE, "axis", "line"))).drop("_at")


def interval_union(intervals: DataFrame, keys: Sequence[str], slack: float = 0.0) -> DataFrame:
    """(keys, lo, hi) of what the intervals of each key cover together; gaps up to ``slack`` are closed."""
    w = W.partitionBy(*keys).orderBy("lo", "hi")
    so_far = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("lo") > so_far + slack).cast("int"), F.lit(1))
    islands = intervals.select(*keys, "lo", "hi").withColumn("_new", new)
    islands = islands.withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def lattice_cells(pages: DataFrame, lines: DataFrame, slack: float = LINE_STEP) -> DataFrame:
    """(doc_id, page, x0, top, x1, bottom, closed): cells between neighbouring lines of pages with 4 down and 2 across.

    A cell is closed if the edges of each of its four lines cover its side, up to ``slack`` at both ends.
    """
    at = W.partitionBy(*PAGE, "axis")
    spans = lines.groupBy(*PAGE, "axis", "line").agg(F.first("pos").alias("pos"))
    spans = spans.withColumn("_n", F.count(F.lit(1)).over(at)).withColumn("to", F.lead("pos").over(at.orderBy("pos")))
    spans = spans.where(F.col("to").isNotNull() & (F.col("_n") >= F.when(F.col("axis") == "v", 4).otherwise(2)))
    columns = spans.where("axis = 'v'").select(*PAGE, F.col("line").alias("col"), F.col("pos").alias("x0"), F.col("to").alias("x1"))
    rows = spans.where("axis = 'h'").select(*PAGE, F.col("line").alias("row"), F.col("pos").alias("top"), F.col("to").alias("bottom"))
    cells = columns.join(rows, list(PAGE)).join(pages, list(PAGE))
    big = (F.col("x1") - F.col("x0") >= F.col("width") * CARD_WIDTH[0]) & (F.col("bottom") - F.col("top") >= F.col("height") * CARD_HEIGHT[0])
    covers = interval_union(lines, [*PAGE, "axis", "line"], slack)
    # a line covers sides of the spans of the other axis: each is a side of the cells before and after the line
    other = spans.select(*PAGE, F.col("axis").alias("_other"), F.col("line").alias("_span"), F.col("pos").alias("_a"), F.col("to").alias("_b"))
    met = covers.join(other, list(PAGE)).where((F.col("axis") != F.col("_other")) & (F.col("lo") <= F.col("_a") + slack) & (F.col("hi") >= F.col("_b") - slack))
    beside = F.explode(F.array(F.col("line"), F.col("line") - 1)).alias("_at")
    met = met.select(*PAGE, "axis", "_span", beside)
    flat = F.col("axis") == "h"
    met = met.select(*PAGE, F.when(flat, F.col("_at")).otherwise(F.col("_span")).alias("row"), F.when(flat, F.col("_span")).otherwise(F.col("_at")).alias("col"))
    count = met.groupBy(*PAGE, "row", "col").agg(F.count(F.lit(1)).alias("_sides"))
    joined = cells.where(big).join(count, [*PAGE, "row", "col"], "left")
    return joined.select(*PAGE, "x0", "top", "x1", "bottom", (F.coalesce("_sides", F.lit(0)) == 4).alias("closed"))


def learned_cards(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of pages that have none, on the grid of the first page of their document with three or more.

    Columns are that page's chained card sides (4 at least), rows repeat its mean card height (10 at least) from half a
    height down; the last row ends with the page.  Only pages after the learned one are filled.
    """
    by = W.partitionBy("doc_id")
    counted = cards.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).where("_n >= 3")
    first = counted.withColumn("_first", F.min("page").over(by)).where("page = _first")
    height = first.groupBy("doc_id", F.col("page").alias("_learned")).agg(_mean(F.col("bottom") - F.col("top")).alias("_h")).where("_h >= 10")
    xs = first.select("doc_id", F.explode(F.array("x0", "x1")).alias("_x")).distinct()
    bounds = gap_clusters(xs, ["doc_id"], "_x", GRID_STEP).groupBy("doc_id", "cluster").agg(_mean(F.col("_x")).alias("x0"))
    spans = bounds.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("x1", F.lead("x0").over(by.orderBy("x0")))
    spans = spans.where("_n >= 4 AND x1 IS NOT NULL").select("doc_id", "x0", "x1")
    bare = pages.join(cards.select(*PAGE).distinct(), list(PAGE), "left_anti").join(height, "doc_id").where("page > _learned")
    h, end = F.col("_h"), F.col("height")
    # tops stand at (k + 1/2) h as long as a tenth of h is left below them
    last = F.ceil((end - h * 0.1) / h - 0.5).cast("int")
    bare = bare.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))))
    top, below = h * (F.col("_k") + 0.5), h * (F.col("_k") + 1.5)
    whole = F.col("_k") < last - 1
    bare = bare.withColumn("top", top).withColumn("bottom", F.when(whole, below).otherwise(F.least(below, end)))
    bare = bare.where((last >= 1) & (whole | (below <= end + h * 0.5)) & (F.col("bottom") - F.col("top") >= end * CARD_HEIGHT[0]))
    out = bare.join(spans, "doc_id").where(F.col("x1") - F.col("x0") >= F.col("width") * CARD_WIDTH[0])
    return out.select(*PAGE, "x0", "top", "x1", "bottom")


def card_boxes(pages: DataFrame, rects: DataFrame, edges: DataFrame, closed_only: bool = False) -> DataFrame:
    """(doc_id, page, card_idx, x0, top, x1, bottom, source, closed): the cards of each page, in reading order.

    ``pages``: doc_id, page, width, height; ``rects`` and ``edges``: doc_id, page, x0, top, x1, bottom.  A page's cards are
    its rectangles of a card's size (three or more), else the cells between its lines, else those of the grid learned
    from its document; ``source`` says which.  ``closed``: all four sides are drawn (null for learned ones); with
    ``closed_only`` other cells of lines are left out, and pages without any other learn.  Rows without a box or
    page size are no cards; pages without any card have no rows.
    """
    box = ["x0", "top", "x1", "bottom"]
    pages = pages.select(*PAGE, "width", "height")
    by_rect = rect_cards(pages, rects).withColumn("closed", F.lit(True))
    lines = ruled_lines(pages.join(by_rect.select(*PAGE).distinct(), list(PAGE), "left_anti"), edges)
    by_line = lattice_cells(pages, lines)
    if closed_only:
        by_line = by_line.where("closed")
    drawn = _stacked([by_rect.withColumn("source", F.lit("rects")), by_line.withColumn("source", F.lit("lines"))])
    learned = learned_cards(pages, drawn.select(*PAGE, *box)).withColumn("source", F.lit("learned")).withColumn("closed", F.lit(None).cast("boolean"))
    every = _stacked([drawn, learned])
    order = W.partitionBy(*PAGE).orderBy(F.bround("top", 0), "x0", "top", "x1", "bottom")
    return every.select(*PAGE, (F.row_number().over(order) - 1).alias("card_idx"), *box, "source", "closed")


def header_strips(cards: DataFrame) -> DataFrame:
    """Cards with ``strip``, the top of the band above them that belongs to them: the gap to the row above and 10 more.

    The first row's band is 80 high, if the page has that much; the rows are the cards with one rounded top.
    """
    rows = cards.groupBy(*PAGE, F.bround("top", 0).alias("_row")).agg(F.max("bottom").alias("_end"))
    rows = rows.withColumn("_above", F.lag("_end").over(W.partitionBy(*PAGE).orderBy("_row"))).drop("_end")
    with_row = cards.withColumn("_row", F.bround("top", 0)).join(rows, [*PAGE, "_row"])
    extend = F.when(F.col("_above").isNull(), F.least(F.lit(80.0), F.col("top") - 2)).otherwise(F.greatest(F.lit(0.0), F.col("top") - F.col("_above") + 10))
    return with_row.withColumn("strip", F.greatest(F.lit(0.0), F.col("top") - extend)).drop("_row", "_above")


def _first_id(text: Column) -> Column:
    """The first id in a text, else the first that its look-alike letters allow; null without one."""
    strict = F.nullif(F.regexp_extract(text, EPIC, 0), F.lit(""))
    return F.coalesce(strict, F.nullif(epic_normalize(F.regexp_extract(text, LOOSE_EPIC, 0)), F.lit("")))


def id_candidates(cards: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page, card_idx, rung, rank, epic): where an id of a card might be found, in six rungs.

    Rung 0: in the card's own text; 1: beside its serial number in the page's text; 2: a word over the top of the
    card, in its column; 3: in the wider strip above it; 4: in its body; 5: glued to its serial number in the page's text.
    ``cards``: doc_id, page, card_idx, box, serial, text; ``words``: doc_id, page, text, box; ``texts``: doc_id, page, text.
    Within rungs 2 to 4 words come in reading order.
    """
    key = [*PAGE, "card_idx"]
    own = cards.select(*key, F.lit(0).alias("rung"), F.lit(0.0).alias("rank"), _first_id(F.col("text")).alias("epic")).where("epic IS NOT NULL")
    found = words.select(*PAGE, F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.col("top").alias("_t"), _first_id(F.col("text")).alias("epic"))
    near = header_strips(cards).join(found.where("epic IS NOT NULL"), list(PAGE))
    middle = (F.col("_l") + F.col("_r")) / 2

    def within(side: float, low: Column, high: Column) -> Column:
        return middle.between(F.col("x0") - side, F.col("x1") + side) & F.col("_t").between(low, high)

    rungs = F.array(
        F.when(within(10, F.col("strip") - 15, F.col("top") + 25), 2),
        F.when(within(15, F.col("strip") - 5, F.col("top") + 25), 3),
        F.when(within(5, F.col("top"), F.col("bottom")), 4),
    )
    placed = near.select(*key, F.explode(F.array_compact(rungs)).alias("rung"), "_t", "_l", "epic")
    reading = F.row_number().over(W.partitionBy(*key, "rung").orderBy("_t", "_l", "epic"))
    placed = placed.select(*key, "rung", reading.cast("double").alias("rank"), "epic")
    numbered = cards.where(F.coalesce("serial", F.lit("")) != "").select(*key, F.ltrim(F.col("serial"), F.lit("0")).alias("_serial"))

    def beside(rung: int, rank: int, pattern: str, serial: int) -> DataFrame:
        whole = F.regexp_extract_all("text", F.lit(pattern), 0)
        pairs = texts.select(*PAGE, F.posexplode(whole).alias("_n", "_m"))
        part = [F.regexp_extract("_m", pattern, i) for i in (serial, 3 - serial)]
        pairs = pairs.select(*PAGE, F.ltrim(part[0], F.lit("0")).alias("_serial"), (F.col("_n") + rank * 1e6).alias("rank"), part[1].alias("epic"))
        return numbered.join(pairs, [*PAGE, "_serial"]).select(*key, F.lit(rung).alias("rung"), "rank", "epic")

    spaced = beside(1, 0, r"(?<!\S)([0-9]{1,4})\s+([A-Z]{3}[0-9]{7})(?!\S)", 1)
    glued = _stacked([beside(5, 0, r"(?<!\S)([0-9]{1,4})([A-Z]{3}[0-9]{7})(?!\S)", 1), beside(5, 1, r"([A-Z]{3}[0-9]{7})\s*([0-9]{1,4})(?![0-9])", 2)])
    return _stacked([own, spaced, placed, glued])


def _climb(page: np.ndarray, rung: np.ndarray, card: np.ndarray, epic: np.ndarray, rungs: int) -> np.ndarray:
    """Places of the candidates that are taken, in whole pages sorted by page, rung, card, rank and id (cards and ids as codes)."""
    cards = np.unique(page * (card.max() + 1) + card, return_inverse=True)[1]
    ids = np.unique(page * (epic.max() + 1) + epic, return_inverse=True)[1]
    served, used, out = np.zeros(len(cards), bool), np.zeros(len(ids), bool), []
    for r in range(rungs):
        at = np.flatnonzero(rung == r)
        at = at[~served[cards[at]] & ~used[ids[at]]]
        named = at[np.diff(cards[at], prepend=-1) != 0]
        # of the cards that name one id, the first comes first
        won = named[np.unique(ids[named], return_index=True)[1]]
        served[cards[won]] = used[ids[won]] = True
        out.append(won)
    return np.sort(np.concatenate(out))


class _LongPage:
    """A page in parts: of what came before, only the cards that are served and the ids that are used are held."""

    def __init__(self, key: tuple) -> None:
        self.key, self.at, self.served, self.used, self.named = key, (None, None), set(), set(), set()

    def climb(self, rows: pa.Table) -> np.ndarray:
        out = []
        for i, (rung, card, epic) in enumerate(zip(*(rows[c].to_pylist() for c in ("rung", "card_idx", "epic")), strict=True)):
            if rung != self.at[0]:
                self.used |= self.named
                self.named, self.at = set(), (rung, None)
            if card == self.at[1] or card in self.served or epic in self.used:
                continue
            self.at = (rung, card)
            if epic not in self.named:
                self.named.add(epic)
                self.served.add(card)
                out.append(i)
        return np.array(out, "int64")


def id_ladder(candidates: DataFrame, rungs: int = 6, most: int = 1 << 18) -> DataFrame:
    """(doc_id, page, card_idx, epic, rung): the id of each card that gets one; no id serves two cards of a page.

    ``candidates``: doc_id, page, card_idx, rung (from 0), rank, epic.  Rung by rung, each card without an id names the
    best (rank, then id) of its candidates that no card has yet, and an id named by several cards goes to the first of them;
    the others go on to the next rung.  Repeated candidates change nothing; null ids and cards are left out.

    Candidates are shuffled and sorted once, by page, rung, card, rank and id; in that order one pass is enough.  The whole
    pages of a batch are worked out together; of a page with more than ``most`` candidates only what is settled is held,
    so a page may have any number of candidates.
    """
    order = [*PAGE, "rung", "card_idx", "rank", "epic"]
    kept = candidates.select(*order).where((F.col("rung") >= 0) & (F.col("rung") < rungs) & F.col("epic").isNotNull() & F.col("card_idx").isNotNull())
    dealt = kept.repartition(*PAGE).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    columns = [*PAGE, "card_idx", "epic", "rung"]

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None
        for batch in chain(batches, [None]):
            new = [] if batch is None else [pa.Table.from_batches([batch])]
            parts = new if held is None else [held, *new]
            rows = pa.concat_tables(parts).combine_chunks() if parts else None
            if rows is None or not rows.num_rows:
                continue
            n = rows.num_rows
            codes = {c: pc.dictionary_encode(rows[c].chunk(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype("int64") for c in columns[:4]}
            fresh = np.zeros(n, bool)
            for c in PAGE:
                fresh[1:] |= codes[c][1:] != codes[c][:-1]
            starts, begin = np.flatnonzero(fresh), 0
            if long is not None:
                if long.key == tuple(rows[c][0].as_py() for c in PAGE):
                    begin = int(starts[0]) if len(starts) else n
                    yield from rows.take(long.climb(rows.slice(0, begin))).to_batches()
                if begin < n:
                    long = None
            # the last page may go on in the next batch
            end = n if batch is None else max(begin, int(starts[-1]) if len(starts) else 0)
            if end > begin:
                at = slice(begin, end)
                taken = _climb(np.cumsum(fresh)[at], rows["rung"].to_numpy()[at], codes["card_idx"][at], codes["epic"][at], rungs)
                yield from rows.take(taken + begin).to_batches()
            held = rows.slice(end) if end < n else None
            if held is not None and held.num_rows > most:
                long = _LongPage(tuple(held[c][0].as_py() for c in PAGE))
                yield from held.take(long.climb(held)).to_batches()
                held = None

    return dealt.select(*columns).mapInArrow(climb, kept.select(*columns).schema)
