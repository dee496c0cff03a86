"""Features and predicates of table rows (``cells array<string>``), all inside whole-stage expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed words of headers, of footers and of voter-page furniture.
HEADER_WORDS = ("polling station", "sl. no", "sl.no", "serial no", "name of", "candidate", "total of valid", "valid votes", "rejected", "tendered", "nota", "party")
PARTIES_IN_ROW = "(?i)\\b(DMK|AIADMK|BJP|INC|PMK|NTK|VCK|CPI|CPI\\(M\\)|DMDK|MDMK|BSP|NOTA|IND|INDEPENDENT)\\b"
PAGE_LINES = ("(?i)^\\s*page\\s+[0-9]+", "(?i)^\\s*[0-9]+\\s*/\\s*[0-9]+\\s*$", "(?i)list\\s+of\\s+polling\\s+stations", "(?i)^\\s*sl\\.?\\s*no", "(?i)assembly\\s+constituency")


def filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def text_share(cells: Column) -> Column:
    """The share of filled cells that are not numbers; 0 for an empty row."""
    f = filled(cells)
    return F.when(F.size(f) > 0, F.size(F.filter(f, lambda c: ~c.rlike("^[-0-9.,\\s]+$"))) / F.size(f)).otherwise(0.0)


def _steps(numbers: Column) -> Column:
    return F.zip_with(
        F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: b - a
    )


def is_column_number_row(cells: Column) -> Column:
    """Three integers or more, one apart, the first at most 5 and the last at most 20."""
    n = F.transform(filled(cells), lambda c: c.try_cast("int"))
    return (
        (F.size(n) >= 3) & F.forall(n, lambda x: x.isNotNull()) & F.forall(_steps(n), lambda s: s == 1)
        & (F.try_element_at(n, F.lit(1)) <= 5) & (F.try_element_at(n, F.lit(-1)) <= 20)
    )


def is_number_sequence_row(cells: Column) -> Column:
    """The first five cells have one or two digits and rise by 0 or 1."""
    f = F.slice(filled(cells), 1, 5)
    n = F.transform(f, lambda c: c.try_cast("int"))
    return (F.size(f) >= 3) & F.forall(f, lambda c: c.rlike("^[0-9]{1,2}$")) & F.forall(_steps(n), lambda s: s.isin(0, 1))


def is_station_row(cells: Column, column: int) -> Column:
    return F.trim(F.get(cells, F.lit(column))).rlike("^[0-9]+$")


def has_header_word(cells: Column) -> Column:
    low = F.lower(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "))
    hit = F.lit(False)
    for w in HEADER_WORDS:
        hit = hit | low.contains(w)
    return hit


def is_structured_data_row(cells: Column) -> Column:
    """A station id (``1``, ``1A``, ``1(A)``) in the first two cells, two integers after it, no header word."""
    c = F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    station = F.exists(F.slice(c, 1, 2), lambda x: x.rlike("^[1-9][0-9]{0,3}\\s*(\\(?[A-Za-z]\\)?)?$"))
    counts = F.size(F.filter(F.slice(c, 2, F.greatest(F.size(c), F.lit(0))), lambda x: F.replace(x, F.lit(","), F.lit("")).rlike("^[0-9]+$")))
    return station & (counts >= 2) & ~has_header_word(cells)


def header_overlap(cells: Column, headers: Column) -> Column:
    """The share of filled cells that are some header, without case."""
    f = F.transform(filled(cells), lambda c: F.lower(c))
    h = F.transform(headers, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.when(F.size(f) > 0, F.size(F.filter(f, lambda c: F.array_contains(h, c))) / F.size(f)).otherwise(0.0)


def is_repeated_header(cells: Column, headers: Column, share: float = 0.6, least: int = 3) -> Column:
    """A header word, or at least ``share`` of at least ``least`` text cells equal to headers."""
    texts = F.filter(filled(cells), lambda c: ~c.rlike("^[-0-9.,\\s]+$"))
    return has_header_word(cells) | ((F.size(texts) >= least) & (header_overlap(texts, headers) >= share))


def is_data_only_row(cells: Column, headers: Column, match: float = 0.4, text: float = 0.7) -> Column:
    """Begins with a digit, has no header word, is not mostly text and does not repeat the header."""
    first = F.try_element_at(filled(cells), F.lit(1))
    return F.coalesce(first.rlike("^[0-9]"), F.lit(False)) & ~has_header_word(cells) & (text_share(cells) < text) & (header_overlap(cells, headers) <= match)


def is_party_header_row(cells: Column) -> Column:
    f = filled(cells)
    return (F.size(F.filter(f, lambda c: c.rlike("\\([^)]+\\)"))) >= 3) | ((text_share(cells) > 0.7) & (F.size(f) > 3))


def is_party_row(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(c, F.lit("")).rlike(PARTIES_IN_ROW))


def is_total_row(cells: Column) -> Column:
    return F.coalesce(F.try_element_at(filled(cells), F.lit(1)).rlike("(?i)^(grand\\s+|sub\\s*-?\\s*)?total\\b"), F.lit(False))


def is_page_line(text: Column) -> Column:
    hit = F.lit(False)
    for p in PAGE_LINES:
        hit = hit | text.rlike(p)
    return hit


def looks_like_data(header: Column) -> Column:
    """Headers that are numbers or long texts rather than names."""
    h = F.trim(F.coalesce(header, F.lit("")))
    return h.rlike("^[-0-9.,\\s]+$") | (F.length(h) > 100)


def fingerprints(header_rows: DataFrame) -> DataFrame:
    """(table_id, print) of header rows: their filled cells, lower-cased, joined."""
    low = F.transform(filled(F.col("cells")), lambda c: F.lower(c))
    return header_rows.select("table_id", F.array_join(low, "|").alias("print")).where("print <> ''").distinct()


def drop_repeated_headers(rows: DataFrame, header_rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows that neither equal a header row of their table nor, with three filled cells or more, share half of them with one."""
    prints = fingerprints(header_rows).groupBy("table_id").agg(F.collect_set("print").alias("_p"))
    low = F.transform(filled(F.col("cells")), lambda c: F.lower(c))
    joined = rows.join(prints, "table_id", "left")
    same = F.exists("_p", lambda p: (p == F.array_join(low, "|")) | ((F.size(low) >= 3) & (F.size(F.filter(low, lambda c: F.array_contains(F.split(p, "\\|"), c))) >= share * F.size(low))))
    return joined.where(F.col("_p").isNull() | ~same).drop("_p")


def split_header(rows: DataFrame, most: int = 5) -> DataFrame:
    """Rows with ``is_header``: the longest prefix of at most ``most`` rows of each table that look like a header."""
    first = W.partitionBy("table_id").orderBy("page", "row_idx")
    n = F.row_number().over(first)
    t = text_share(F.col("cells"))
    header = has_header_word(F.col("cells")) | (t >= 0.8) | ((n == 1) & (t >= 0.7)) | ((n == 2) & (t >= 0.75))
    marked = rows.withColumn("_n", n).withColumn("_h", header & (n <= most))
    stop = F.min(F.when(~F.col("_h"), F.col("_n"))).over(W.partitionBy("table_id"))
    return marked.withColumn("is_header", F.col("_n") < F.coalesce(stop, F.col("_n") + 1)).drop("_n", "_h")


def after_page_header(rows: DataFrame) -> DataFrame:
    """Rows after the first header row of their page (all of them on a page without one), sequences left out."""
    seen = F.max(has_header_word(F.col("cells")).cast("int")).over(W.partitionBy("table_id", "page").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0))
    any_ = F.max(has_header_word(F.col("cells")).cast("int")).over(W.partitionBy("table_id", "page"))
    marked = rows.withColumn("_seen", seen).withColumn("_any", any_)
    kept = marked.where(((F.col("_any") == 0) | (F.col("_seen") == 1)) & ~has_header_word(F.col("cells")) & ~is_number_sequence_row(F.col("cells")))
    return kept.drop("_seen", "_any")
