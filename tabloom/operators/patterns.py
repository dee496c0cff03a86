"""Rows that repeat a pattern, corrections by what a column holds, and sampled cells against their source.

``rows``: table_id, page, row_idx, cells array<string>; ``patterns``: pattern_id, cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import numeric_cell_ocr, squeeze

#: Fixed rule of a pattern match: so many cells of text to compare, and this share of them equal.
LEAST_CELLS, LEAST_SHARE = 5, 0.8
#: Any match has so many equal cells, as 0.8 of five are four.
OVERLAP = 4
#: Fixed words in the headers of columns of numbers.
NUMERIC_WORDS = ("votes", "count", "total", "no.", "sl", "station")
ROW = ("table_id", "page", "row_idx")


def _plain(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))


def _number(cell: Column) -> Column:
    return F.translate(cell, ",.", "").rlike("^[0-9]+$")


def _form(cells: Column) -> Column:
    """Plain cells, with every number as ``0``: all that a comparison looks at."""
    return F.transform(_plain(cells), lambda c: F.when(_number(c), F.lit("0")).otherwise(c))


def _same_form(a: Column, b: Column) -> Column:
    """``same_pattern`` of two forms, in one pass: a place counts 1, and an equal one 2^32 more."""
    one = lambda x, y: F.when((x == "0") | (y == "0") | x.isNull() | y.isNull(), 0).when(x != y, 1).when(x == "", 0).otherwise((1 << 32) + 1)
    both = F.aggregate(F.zip_with(a, b, one), F.lit(0).cast("long"), lambda s, x: s + x)
    n, equal = both.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(both, 32)
    return (F.coalesce(F.get(a, F.lit(0)), F.lit("")) != "0") & (n >= LEAST_CELLS) & (equal >= n * LEAST_SHARE)


def same_pattern(row: Column, pattern: Column) -> Column:
    """Whether a row is a pattern: of the places in both where neither holds a number and not both are empty, five or more,
    at least 0.8 are equal without regard to case.  A row that begins with a number never is."""
    return _same_form(_form(row), _form(pattern))


def _together(n: Column) -> Column:
    """How many cells at a time are indexed where ``n`` cells might be equal: at most 84, 153 or n - 3 sets of them."""
    return F.when(n <= 10, 3).when(n <= 20, 2).otherwise(1)


def _sets(order: Column, k: int) -> Column:
    """Hashes of all sets of ``k`` among all but the last ``OVERLAP - k`` of some hashes, which come in a fixed order."""
    head = F.slice(order, 1, F.greatest(F.size(order) - OVERLAP + k, F.lit(0)))
    after = lambda i: F.slice(head, i + 2, F.size(head))
    if k == 1:
        return head
    if k == 2:
        return F.flatten(F.transform(head, lambda a, i: F.transform(after(i), lambda b: F.xxhash64(a, b))))
    return F.flatten(F.transform(head, lambda a, i: F.flatten(F.transform(after(i), lambda b, j: F.transform(after(i + j + 1), lambda c: F.xxhash64(a, b, c))))))


def _matching_forms(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_f, _p): each distinct form of a row (``_f``) with each distinct form of a pattern (``_p``) that it repeats.

    They meet in an inverted index of sets of (place, cell).  A match has at least four equal cells, so with the cells in
    one order, the rarest among the forms first, its k rarest equal cells are among all but the last 4 - k of each side: sets
    of k of those are indexed, and a cell that nearly every form holds leads to no pairs.  k is 3 for forms of few cells
    and less for wide ones, which would have too many sets; a pair meets by the smaller k of its two sides.  Pairs that meet are
    compared whole.  Cells that the other side has nowhere can be equal in none and are left out of the order.
    """
    filled = lambda f: F.filter(F.transform(f, lambda c, i: F.struct(i.alias("pos"), c.alias("cell"))), lambda t: (t["cell"] != "") & (t["cell"] != "0"))
    forms = forms.where(F.coalesce(F.get("_f", F.lit(0)), F.lit("")) != "0").withColumn("_i", F.xxhash64("_f"))
    wanted = wanted.withColumn("_j", F.xxhash64("_p"))
    known = wanted.select("_j", F.explode(filled(F.col("_p"))).alias("t")).select("_j", "t.pos", "t.cell")
    told = forms.select("_i", F.explode(filled(F.col("_f"))).alias("t")).select("_i", "t.pos", "t.cell").join(known.select("pos", "cell").distinct(), ["pos", "cell"])
    counts = told.groupBy("pos", "cell").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame, key: str, width: str) -> DataFrame:
        order = F.transform(F.array_sort(F.collect_list(F.struct("n", "pos", "cell"))), lambda t: F.xxhash64(t["pos"], t["cell"]))
        ordered = df.join(counts, ["pos", "cell"]).groupBy(key).agg(order.alias("_o")).where(F.size("_o") >= OVERLAP)
        return ordered.withColumn(width, _together(F.size("_o")))

    def indexed(df: DataFrame, key: str, width: str, also: Column) -> DataFrame:
        none = F.array().cast("array<bigint>")
        sets = [F.struct(F.lit(k).alias("_k"), F.when((F.col(width) >= k) & F.exists(also, lambda w: F.least(w, F.col(width)) == k), _sets(F.col("_o"), k)).otherwise(none).alias("_s")) for k in (1, 2, 3)]
        sets = df.select(key, width, F.explode(F.array(*sets)).alias("_e")).select(key, width, "_e._k", F.explode("_e._s").alias("_s"))
        return sets.distinct()

    patterned, ordered = rarest(known, "_j", "_wj"), rarest(told, "_i", "_wi")
    widths = patterned.agg(F.collect_set("_wj").alias("_all"))
    shown = indexed(patterned, "_j", "_wj", F.array(F.lit(1), F.lit(2), F.lit(3)))
    mine = indexed(ordered.crossJoin(F.broadcast(widths)), "_i", "_wi", F.col("_all"))
    met = mine.join(shown, ["_k", "_s"]).where(F.col("_k") == F.least("_wi", "_wj")).select("_i", "_j").distinct()
    return met.join(forms, "_i").join(wanted, "_j").where(_same_form(F.col("_f"), F.col("_p"))).select("_f", "_p")


def pattern_matches(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(table_id, page, row_idx, cells, pattern_id): rows with each pattern that they repeat.

    Rows and patterns that are alike but for case, white space at the ends and their numbers are compared once, however many
    they are.  Null cells are empty; rows with fewer than four cells of text match nothing.
    """
    formed = rows.select(*ROW, "cells", _form(F.col("cells")).alias("_f"))
    named = patterns.select("pattern_id", _form(F.col("cells")).alias("_p")).distinct()
    found = _matching_forms(formed.select("_f").distinct(), named.select("_p").distinct())
    return formed.join(found.join(named, "_p").select("_f", "pattern_id"), "_f").select(*ROW, "cells", "pattern_id")


def drop_pattern_rows(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows that repeat no pattern, with all their columns."""
    found = _matching_forms(rows.select(_form(F.col("cells")).alias("_f")).distinct(), patterns.select(_form(F.col("cells")).alias("_p")).distinct())
    found = found.select("_f").distinct()
    return rows.join(found, _form(rows["cells"]) == found["_f"], "left_anti")


def mostly_digits(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    return F.char_length(F.regexp_replace(v, "[^0-9]", "")) > F.char_length(v) * 0.5


def correct_number(value: Column) -> Column:
    """Letters read for digits become digits; spaces go where only digits, commas and points are left."""
    v = numeric_cell_ocr(F.trim(value))
    return F.when(v.rlike(r"^[0-9,.\s]*$"), F.replace(v, F.lit(" "), F.lit(""))).otherwise(v)


def correct_text(value: Column) -> Column:
    """Long dashes to ``-``, middle dots to ``.``, white space squeezed."""
    return squeeze(F.translate(value, "—–·", "--."))


def correct_by_column(cells: DataFrame, headers: DataFrame, least: float = 0.5) -> DataFrame:
    """Cells (table_id, page, row_idx, col_idx, value) corrected by what their column holds, with ``numeric`` beside them.

    A column holds numbers if its header (table_id, col_idx, header) has a word for them, or if more than ``least`` of its
    filled cells are mostly digits; a single cell that is mostly digits is a number in any column.  Null values stay null.

    Two passes: one aggregate of columns, summed up before its shuffle, and one join of its few rows back to the cells.
    """
    named = F.lit(False)
    for word in NUMERIC_WORDS:
        named = named | F.contains(F.lower("header"), F.lit(word))
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    share = cells.where(filled).groupBy("table_id", "col_idx").agg(F.avg(mostly_digits(F.col("value")).cast("int")).alias("_share"))
    kinds = headers.groupBy("table_id", "col_idx").agg(F.max(F.coalesce(named, F.lit(False))).alias("_named"))
    kinds = share.join(kinds, ["table_id", "col_idx"], "full")
    joined = cells.join(kinds, ["table_id", "col_idx"], "left")
    numeric = F.coalesce("_named", F.lit(False)) | F.coalesce(F.col("_share") > least, F.lit(False)) | mostly_digits(F.col("value"))
    joined = joined.withColumn("numeric", numeric)
    value = F.when(F.col("numeric"), correct_number(F.col("value"))).otherwise(correct_text(F.col("value")))
    return joined.withColumn("value", value).select(*cells.columns, "numeric")


def sample_cells(cells: DataFrame, keys: Sequence[str] = ("table_id",), place: Sequence[str] = ("page", "row_idx", "col_idx"), size: int = 64, seed: str = "") -> DataFrame:
    """At most ``size`` cells of each table, chosen by a hash of their place.

    The hash deals cells into ``size`` slots, and each slot keeps the cell of least hash: one aggregate of minima, so
    samples of parts of a table merge to that of the whole, and no table is sorted or held.  A table of n cells
    gives about size * (1 - exp(-n / size)) of them.  Repeated places count once.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in (*keys, *place)]).cast("binary"))
    slot = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % size
    others = [c for c in cells.columns if c not in keys]
    least = F.min_by(F.struct(*others), key)
    return cells.groupBy(*keys, slot.alias("_slot")).agg(least.alias("_s")).select(*keys, "_s.*")


def sample_accuracy(cells: DataFrame, source: DataFrame, size: int = 64, seed: str = "") -> DataFrame:
    """(table_id, n_sampled, n_equal, n_differ, n_missing, accuracy) of sampled cells against the same places of ``source``.

    Values are compared without white space at their ends; null is empty.  Both tables: table_id, page, row_idx, col_idx, value.
    """
    at = ["table_id", "page", "row_idx", "col_idx"]
    sampled = sample_cells(cells.select(*at, "value"), size=size, seed=seed)
    there = source.select(*at, F.col("value").alias("_v")).withColumn("_there", F.lit(True)).dropDuplicates(at)
    joined = sampled.join(there, at, "left")
    text = [F.trim(F.coalesce(c, F.lit(""))) for c in ("value", "_v")]
    equal = F.col("_there").isNotNull() & (text[0] == text[1])
    counts = [F.count(F.lit(1)).alias("n_sampled"), F.count_if(equal).alias("n_equal"), F.count_if(F.col("_there").isNotNull() & ~equal).alias("n_differ"), F.count_if(F.col("_there").isNull()).alias("n_missing")]
    return joined.groupBy("table_id").agg(*counts).withColumn("accuracy", F.col("n_equal") / F.col("n_sampled"))
