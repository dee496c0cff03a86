"""Union, de-duplication, numbering and header agreement of the pages and files of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import numeric, sanitize
from tabloom.model import fit_width


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order.  One shuffle; the row goes through a partial ``min_by``, so a key
    with very many rows is combined before it moves."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in zip(names, keys, strict=True)})
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return keyed.groupBy(*names).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


#: The column that holds how often a row of ``counted`` occurs.
COPIES = "_copies"


def counted(df: DataFrame) -> DataFrame:
    """Each row once with its number of ``COPIES``, so that later groups of whole rows can be ``repeated``."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def repeated(df: DataFrame) -> DataFrame:
    """The rows of ``counted`` as often as they were, without the count."""
    return df.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("long"), COPIES))).drop(COPIES)


def page_key(cells: Column) -> Column:
    """The key of page merging: the non-empty ones of the first three cells, else the whole row."""
    first = F.filter(F.slice(cells, 1, 3), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return F.when(F.size(first) > 0, F.array_join(first, "\x1f")).otherwise(F.array_join(cells, "\x1e"))


def merge_pages(rows: DataFrame, width: int | None = None) -> DataFrame:
    """All pages of each table under its first page's width, cleaned, repeats dropped, renumbered from 0."""
    w = W.partitionBy("table_id")
    if width is None:
        wide = F.first(F.size("cells")).over(w.orderBy("page", "row_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    else:
        wide = F.lit(width)
    fitted = rows.withColumn("_w", wide).withColumn("cells", F.transform(fit_width(F.col("cells"), F.col("_w")), sanitize)).drop("_w")
    kept = keep_first(fitted, ["table_id", page_key(F.col("cells"))], ["page", "row_idx"])
    return kept.withColumn("row_idx", (F.row_number().over(w.orderBy("page", "row_idx")) - 1).cast("int"))


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables by column name; missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def modal_width(rows: DataFrame) -> DataFrame:
    """(table_id, width): the most common row width, the smaller of equals."""
    counts = rows.groupBy("table_id", F.size("cells").alias("width")).count()
    best = counts.groupBy("table_id").agg(F.max(F.struct("count", (-F.col("width")).alias("w"))).alias("b"))
    return best.select("table_id", (-F.col("b.w")).alias("width"))


def align(rows: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of each table at its modal width; new headers are ``Column k``."""
    width = modal_width(rows)
    fitted = rows.join(width, "table_id").withColumn("cells", fit_width(F.col("cells"), F.col("width"))).drop("width")
    made = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1),
        lambda i: F.coalesce(F.nullif(F.get("headers", i), F.lit("")), F.format_string("Column %d", i + 1)),
    )
    named = headers.join(width, "table_id").where("width > 0").withColumn("headers", made).drop("width")
    return fitted, named


def to_master(cells: DataFrame, page_headers: DataFrame, master: DataFrame) -> DataFrame:
    """Cells under the positions of the master header with the same name, without case and ends; others are left out.

    ``page_headers``: table_id, page, col_idx, header; ``master``: table_id, pos, header.
    """
    def name(c: str) -> Column:
        return F.lower(F.trim(c))

    there = page_headers.select("table_id", "page", "col_idx", name("header").alias("_h"))
    placed = there.join(master.select("table_id", "pos", name("header").alias("_h")), ["table_id", "_h"]).select("table_id", "page", "col_idx", "pos")
    first = placed.groupBy("table_id", "page", "pos").agg(F.min("col_idx").alias("col_idx"))
    return cells.join(first, ["table_id", "page", "col_idx"]).select("table_id", "page", "row_idx", F.col("pos").alias("col_idx"), "value")


def master_headers(page_headers: DataFrame, share: float = 0.5, least: int = 3, fill_to: int = 10) -> DataFrame:
    """(table_id, pos, header, score): headers that most pages agree on, in order of their mean position.

    A header scores ten a page, with bonuses for station, vote and party patterns and a penalty for numbers.  Those on
    at least ``share`` of the pages are taken; fewer than ``least`` are filled up by score.
    """
    pages = page_headers.groupBy("table_id").agg(F.count_distinct("page").alias("pages"))
    h = page_headers.where(F.trim("header") != "").groupBy("table_id", F.trim("header").alias("header"))
    votes = h.agg(F.count_distinct("page").alias("n"), F.avg("col_idx").alias("mean")).join(pages, "table_id")
    low = F.lower("header")
    bonus = F.when(low.rlike("polling|station|votes|total|nota"), 20).otherwise(0) + F.when(F.col("header").rlike("^[A-Z]{2,8}$|\\([A-Z()]+\\)"), 10).otherwise(0)
    penalty = F.when(F.col("header").rlike("^[0-9.,\\s]+$"), 50).otherwise(0)
    scored = votes.withColumn("score", F.col("n") * 10 + bonus - penalty)
    taken = scored.withColumn("_major", (F.col("n") >= share * F.col("pages")) & (F.col("score") > 0))
    count = F.sum(F.col("_major").cast("int")).over(W.partitionBy("table_id"))
    rank = F.row_number().over(W.partitionBy("table_id").orderBy(F.desc("_major"), F.desc("score"), "mean", "header"))
    taken = taken.withColumn("_c", count).withColumn("_r", rank).where(F.col("_major") | ((F.col("_c") < least) & (F.col("_r") <= fill_to)))
    pos = F.row_number().over(W.partitionBy("table_id").orderBy("mean", "header")) - 1
    return taken.select("table_id", pos.cast("int").alias("pos"), "header", "score")


def carry_header(pages: DataFrame) -> DataFrame:
    """The first header of a table on every page: table_id, page, headers (null where a page has none)."""
    w = W.partitionBy("table_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return pages.withColumn("headers", F.first("headers", ignorenulls=True).over(w))


#: Ranges of a global numbering; their bounds are constants of the plan.
MOST_RANGES = 400


def _range_of(key: Column, bounds: list[Column], wide: int) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, looked up in two steps of ``wide``."""
    below = lambda of: F.size(F.filter(of, lambda b: b <= key))
    groups = [bounds[at : at + wide] for at in range(0, len(bounds), wide)]
    group = below(F.array(*[g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * wide + below(F.element_at(F.array(*[F.array(*g) for g in groups]), F.greatest(group, F.lit(1)))))


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "serial", start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in a total order (nulls first), without gathering it.

    A uniform sample of the order's values, 64 for each range, gives fixed bounds of ranges.  A row's range follows from its
    values alone, so the counts of the ranges and the numbers within them agree however Spark deals the rows out.  Rows
    with equal values are ordered by a hash of the whole row (but for maps), so that many of them are several ranges.
    There are as many ranges as shuffle partitions, at most ``MOST_RANGES``.  The order's columns are of plain types.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order) + 1)]
    tie = F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    keyed = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, (*order, tie), strict=True)})
    parts = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = keyed.select(*names).orderBy(F.rand(7)).limit(64 * parts).orderBy(*names).collect()
    types = [keyed.schema[n].dataType for n in names]
    cuts = dict.fromkeys(sample[64 * i] for i in range(1, parts) if 64 * i < len(sample))
    bounds = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(r, types, names, strict=True)]) for r in cuts]
    part = _range_of(F.struct(*names), bounds, max(1, round(len(bounds) ** 0.5))) if bounds else F.lit(0)
    dealt = keyed.withColumn("_part", part)
    numbered = dealt.withColumn("_in_part", F.row_number().over(W.partitionBy("_part").orderBy(*names)))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row for each range
    out = numbered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_in_part") + F.col("_before") + (start - 1)).cast("long"))
    return out.drop("_part", "_in_part", "_before", *names)


def roll_order(df: DataFrame, legacy_sort: bool = False) -> list[Column]:
    """Constituency, part, input position (numbers; others count 0); ``legacy_sort``: part and position only."""
    ac, part = (F.coalesce(numeric(F.col(c)), F.lit(0.0)) for c in ("ac_no", "part_no"))
    return [part, F.col("position")] if legacy_sort else [ac, part, F.col("position")]


def booth_order(part: Column) -> Column:
    """Booths by number: a missing one first, one that is no number last."""
    p = F.trim(F.coalesce(part, F.lit("")))
    return F.when(p == "", 0).otherwise(F.coalesce(p.try_cast("int"), F.lit(999999)))


def consolidate(voters: DataFrame, rolls: DataFrame) -> dict[str, DataFrame]:
    """The bulk job: ``voters`` numbered over all booths, ``booths`` with offsets, ``failed`` files.

    ``rolls``: pdf_index, filename, ac_no, part_no, error; ``voters``: pdf_index, pos and the voter's columns.
    """
    counts = voters.groupBy("pdf_index").agg(F.count(F.lit(1)).alias("n"))
    all_ = rolls.join(counts, "pdf_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    good = all_.where(F.col("error").isNull() & (F.col("n") > 0)).withColumn("booth_order", booth_order(F.col("part_no")))
    order = W.orderBy("booth_order", "pdf_index")  # one row for each file
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    booths = good.withColumn("start_row", ahead).withColumn("end_row", F.col("start_row") + F.col("n") - 1)
    in_booth = F.row_number().over(W.partitionBy("pdf_index").orderBy("pos"))
    numbered = voters.withColumn("_i", in_booth).join(booths.select("pdf_index", "start_row"), "pdf_index").withColumn("serial", F.col("start_row") + F.col("_i"))
    failed = all_.where(F.col("error").isNotNull()).select("pdf_index", "filename", "error", F.lit(0).alias("kind")).union(
        all_.where(F.col("error").isNull() & (F.col("n") == 0)).select("pdf_index", "filename", F.lit("No voters extracted"), F.lit(1))
    )
    return {"voters": numbered.drop("_i", "start_row"), "booths": booths, "failed": failed.orderBy("kind", "pdf_index").drop("kind")}


def paginate(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """The page of every row when ``size`` rows make a page."""
    return number_rows(df, order, "_n").withColumn("page", F.floor((F.col("_n") - 1) / size)).drop("_n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either side only, with ``side``."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("left")).union(b.exceptAll(a).distinct().withColumn("side", F.lit("right")))


def ordered_distinct(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Each value once, at its first position."""
    return keep_first(df, [value], order)
