"""Whole ways from cells to a checked table: pages under one master header, station tables, titles, and what to report of them.

``rows``: table_id, page, row_idx, cells.  Each chain is a composition of the operators beside it and stays one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import sanitize, squeeze
from tabloom.model import fit_width, to_cells, to_rows
from tabloom.operators.merge import master_headers, to_master
from tabloom.operators.rows import filled, has_header_word, is_number_sequence_row, looks_like_data, split_header

#: Fixed words of columns that hold no votes, and of those that hold no candidate.
NO_VOTES = ("sl.", "polling", "station", "rejected", "total", "tender")
NO_CANDIDATE = (*NO_VOTES, "nota")
#: Fixed patterns of title lines and of the line that ends them; they are looked for in the first 15 lines.
TITLES = r"(?i)form\s*20|final\s*result\s*sheet|election|lok\s*sabha|assembly|constituency|electors?|total\s*no\.?\s*of"
TITLE_END, TITLE_LINES = r"(?i)sl\.|polling station|sl\. no", 15


def page_tables(rows: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """((table_id, page, col_idx, header), data rows): what each page's own header rows say, and its rows below them.

    A column's header is the text of its header cells from above.  Headers that look like data are left out, unless a page
    has no others.  Data rows have some text and are no row of column numbers.
    """
    by_page = rows.withColumns({"_t": F.col("table_id"), "table_id": F.struct("table_id", "page")})
    split = split_header(by_page, most).withColumn("table_id", F.col("_t")).drop("_t")
    parts = to_cells(split.where("is_header")).withColumn("value", sanitize(F.col("value"))).where("value <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]), " ")
    heads = parts.groupBy("table_id", "page", "col_idx").agg(text.alias("header")).withColumn("_name", ~looks_like_data(F.col("header")))
    named = F.max("_name").over(W.partitionBy("table_id", "page"))
    heads = heads.withColumn("_any", named).where(F.col("_name") | ~F.col("_any")).select("table_id", "page", "col_idx", "header")
    data = split.where(~F.col("is_header")).drop("is_header").where((F.size(filled(F.col("cells"))) > 0) & ~is_number_sequence_row(F.col("cells")))
    return heads, data


def carried_headers(heads: DataFrame, pages: DataFrame) -> DataFrame:
    """The headers of each page (table_id, page), and on pages without any those of the last page before that has some."""
    own = heads.groupBy("table_id", "page").agg(F.collect_list(F.struct("col_idx", "header")).alias("_h"))
    every = pages.select("table_id", "page").distinct().join(own, ["table_id", "page"], "left")
    so_far = W.partitionBy("table_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    every = every.withColumn("_h", F.last("_h", ignorenulls=True).over(so_far))
    return every.select("table_id", "page", F.explode("_h").alias("h")).select("table_id", "page", "h.*")


def merged_table(rows: DataFrame, most: int = 5, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(master headers, rows): all pages of each table under one header, whatever the order of a page's columns.

    The master (table_id, pos, header, score) holds the headers that most pages agree on (see ``merge.master_headers``); rows
    (table_id, page, row_idx, cells) are as wide, with empty cells where their page lacks a column.  Columns that the
    master lacks are left out, and so are pages without a header, unless ``carry`` gives them that of the page before; rows
    keep their page and number.
    """
    heads, data = page_tables(rows, most)
    master = master_headers(heads)
    heads = carried_headers(heads, rows) if carry else heads
    placed = to_rows(to_master(to_cells(data), heads, master))
    width = master.groupBy("table_id").agg((F.max("pos") + 1).alias("_w"))
    return master, placed.join(width, "table_id").withColumn("cells", fit_width(F.col("cells"), F.col("_w"))).drop("_w")


def _first_place(headers: Column, *words: str) -> Column:
    def fits(h: Column) -> Column:
        low = F.lower(squeeze(F.coalesce(h, F.lit(""))))
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(low, F.lit(w))
        return hit

    return F.array_min(F.filter(F.transform(headers, lambda h, i: F.when(fits(h), i)), lambda i: i.isNotNull()))


def _integer(cell: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def _names_any(header: Column, words: tuple[str, ...]) -> Column:
    low, hit = F.lower(F.coalesce(header, F.lit(""))), F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def station_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): each table's first row as its headers, and the rows with a whole number as polling station.

    Rows are as wide as the headers and have ``station``, ``stated`` (total valid votes, null if it is no whole number),
    ``computed`` (the sum of the vote columns; other cells count 0) and ``valid`` (both are equal).  Tables without a
    column of polling stations have no rows; without one of total valid votes, ``valid`` is false.
    """
    first = F.row_number().over(W.partitionBy("table_id").orderBy("page", "row_idx")) == 1
    heads = rows.withColumn("_first", first).where("_first").select("table_id", F.col("cells").alias("headers"))
    named = heads.select("table_id", "headers", _first_place(F.col("headers"), "polling", "station").alias("_s"), _first_place(F.col("headers"), "total", "valid", "vote").alias("_t"))
    body = rows.withColumn("_first", first).where(~F.col("_first")).drop("_first").join(named, "table_id")
    body = body.withColumn("cells", fit_width(F.col("cells"), F.size("headers"))).withColumn("station", _integer(F.get("cells", F.col("_s")))).where("station IS NOT NULL")
    votes = F.zip_with("headers", "cells", lambda h, c: F.when(_names_any(h, NO_VOTES), F.lit(0)).otherwise(F.coalesce(_integer(c), F.lit(0))))
    body = body.withColumn("stated", F.when(F.col("_t").isNotNull(), _integer(F.get("cells", F.col("_t")))))
    body = body.withColumn("computed", F.aggregate(votes, F.lit(0).cast("long"), lambda s, v: s + v))
    valid = F.coalesce(F.col("stated") == F.col("computed"), F.lit(False))
    return heads, body.withColumn("valid", valid).drop("headers", "_s", "_t")


def candidate_columns(headers: DataFrame) -> DataFrame:
    """(table_id, col_idx, candidate, party) of the headers that name candidates; the party stands in the last parentheses."""
    each = headers.select("table_id", F.posexplode("headers").alias("col_idx", "header"))
    each = each.where(~_names_any(F.col("header"), NO_CANDIDATE))
    h = F.coalesce("header", F.lit(""))
    with_party = h.rlike(r"(?s)\(.*\)")
    name = F.when(with_party, F.trim(F.regexp_extract(h, r"(?s)^(.*)\([^(]*$", 1))).otherwise(h)
    party = F.when(with_party, F.trim(F.regexp_extract(h, r"(?s)\(([^()]*)\)[^)]*$", 1))).otherwise("")
    return each.select("table_id", "col_idx", name.alias("candidate"), party.alias("party"))


def title_lines(text: Column) -> Column:
    """array<string>: the title lines of a page, among its first 15, up to the line with the table's column names."""
    lines = F.filter(F.transform(F.slice(F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), "\n"), 1, TITLE_LINES), sanitize), lambda s: s != "")
    end = F.array_min(F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(TITLE_END), i)), lambda i: i.isNotNull()))
    return F.filter(F.slice(lines, 1, F.coalesce(end, F.size(lines))), lambda s: s.rlike(TITLES))


def document_titles(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no, title): the title lines of each document's first page (doc_id, page, text)."""
    first = pages.groupBy("doc_id").agg(F.min_by("text", "page").alias("_text"))
    return first.select("doc_id", F.posexplode(title_lines(F.col("_text"))).alias("line_no", "title"))


def verification(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, n_columns, n_rows, n_wrong_width, n_header_like, n_empty, n_errors, status) of tables, by one aggregate.

    ``headers``: table_id, headers.  Wrong widths and rows that look like headers are errors; the latter make the status
    ``warning``.  Tables without rows have zeros.
    """
    joined = headers.join(rows.select("table_id", "cells"), "table_id", "left")
    there = F.col("cells").isNotNull()
    like = F.coalesce(has_header_word(F.col("cells")), F.lit(False))
    counted = joined.groupBy("table_id").agg(
        F.max(F.size("headers")).alias("n_columns"),
        F.count_if(there).alias("n_rows"),
        F.count_if(there & (F.size("cells") != F.size("headers"))).alias("n_wrong_width"),
        F.count_if(there & like).alias("n_header_like"),
        F.count_if(there & (F.size(filled(F.col("cells"))) == 0)).alias("n_empty"),
    )
    errors = F.col("n_wrong_width") + F.col("n_header_like")
    return counted.withColumn("n_errors", errors).withColumn("status", F.when(F.col("n_header_like") > 0, "warning").otherwise("success"))


def mapping_coverage(headers: DataFrame, mapping: DataFrame, most: float = 0.95) -> DataFrame:
    """One row (n_headers, n_mapped, coverage, confidence): the share of distinct headers that a mapping (standard, variant) names.

    Empty and null headers do not count; variants that are no header do not either.  Without headers both shares are 0.
    """
    known = mapping.select(F.col("variant").alias("header"), F.lit(True).alias("_in")).distinct()
    joined = headers.select("header").where("header <> ''").distinct().join(known, "header", "left")
    out = joined.agg(F.count(F.lit(1)).alias("n_headers"), F.count("_in").alias("n_mapped"))
    share = F.coalesce(F.col("n_mapped") / F.nullif(F.col("n_headers"), F.lit(0)), F.lit(0.0))
    return out.withColumn("coverage", share).withColumn("confidence", F.least(F.col("coverage"), F.lit(most)))
