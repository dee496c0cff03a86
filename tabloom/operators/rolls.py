"""Roll workbooks: sheets of many files to one numbered table of voters, with what to report of them.

``cells``: table_id (the file), sheet, row_idx and col_idx from 1, value.  A sheet is one booth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import numeric
from tabloom.operators.lookup import range_lookup, section_ranges
from tabloom.operators.merge import number_rows

#: Fixed names of sheets that hold no voters, and where metadata and headers are looked for.
NO_VOTERS = ("summary", "errors")
META_ROWS, META_COLUMNS, VALUE_COLUMN, HEADER_ROWS = 8, 7, 4, 14
#: Fixed patterns of a number in its label's cell, of labels beside a number, and of a sheet's title.
AC_NO, PART_NO = r"(?i)(?:AC\s*No|சட்டமன்றத்\s*தொகுதி\s*எண்)[^:]*:\s*([0-9]+)", r"(?i)(?:Booth\s*No|பகுதி\s*எண்)[^:]*:\s*([0-9]+)"
AC_LABEL, PART_LABEL, TITLE = "AC No|தொகுதி எண்", "Booth No|பகுதி எண்|Part No", r"^AC\s*([0-9]+)\s*-\s*([0-9]+)"
#: Fixed columns of a booth's sheet, and of the merged table.
SHEET_COLUMNS = ("serial_no", "name", "relation", "relation_type", "house_no", "age", "gender", "voter_id", "street_name")
MERGED = (
    "Serial No", "voter_name", "voter_name_tamil", "relation_name", "relation_name_tamil", "relation_type", "epic_number", "gender",
    "age", "house_number", "street_name", "section_name", "section_name_tamil", "part_number", "ac_number", "district_code",
)
SHEET = ("table_id", "sheet")


def voter_sheets(cells: DataFrame) -> DataFrame:
    """The cells of sheets that hold voters, values trimmed, empty ones left out."""
    value = F.trim(F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit(" \t\r\n"))
    return cells.where(~F.lower(F.trim("sheet")).isin(*NO_VOTERS)).withColumn("value", value).where("value <> ''")


def sheet_metadata(cells: DataFrame) -> DataFrame:
    """(table_id, sheet, ac_no, part_no) of each sheet; empty where nothing tells.

    A number is taken from the first cell, by row and column, that holds its label and the number, else from column 4 of
    the first row whose first cell is such a label, else from the sheet's title (``AC 149 - 51``).
    """
    top = voter_sheets(cells).where(F.col("row_idx").between(1, META_ROWS) & F.col("col_idx").between(1, META_COLUMNS))
    beside = F.first(F.when(F.col("col_idx") == VALUE_COLUMN, F.col("value")), ignorenulls=True).over(W.partitionBy(*SHEET, "row_idx"))
    top = top.withColumn("_beside", beside)
    place = F.struct("row_idx", "col_idx")

    def found(pattern: str, label: str, name: str) -> tuple[Column, Column]:
        inside = F.nullif(F.regexp_extract("value", pattern, 1), F.lit(""))
        right = F.when((F.col("col_idx") == 1) & F.col("value").rlike(label), F.nullif(F.regexp_extract("_beside", "([0-9]+)", 1), F.lit("")))
        return tuple(F.min_by(c, F.when(c.isNotNull(), place)).alias(f"_{k}_{name}") for k, c in enumerate((inside, right)))

    told = top.groupBy(*SHEET).agg(*found(AC_NO, AC_LABEL, "ac_no"), *found(PART_NO, PART_LABEL, "part_no"))
    sheets = voter_sheets(cells).select(*SHEET).distinct().join(told, list(SHEET), "left")
    title = lambda i: F.nullif(F.regexp_extract("sheet", TITLE, i), F.lit(""))
    return sheets.select(*SHEET, *[F.coalesce(f"_0_{n}", f"_1_{n}", title(i), F.lit("")).alias(n) for i, n in ((1, "ac_no"), (2, "part_no"))])


def sheet_voters(cells: DataFrame) -> DataFrame:
    """(table_id, sheet, row_idx, ``SHEET_COLUMNS``): the rows of voters below each sheet's header.

    The header is the first of rows 1 to 14 whose first cell has the word serial; data begin two rows below, after the header in
    Tamil.  Rows without a serial number, or with a header's, are voters only if they have a name or an id.
    """
    filled = voter_sheets(cells)
    head = filled.where(F.col("row_idx").between(1, HEADER_ROWS) & (F.col("col_idx") == 1) & F.lower("value").contains("serial"))
    head = head.groupBy(*SHEET).agg(F.min("row_idx").alias("_head"))
    body = filled.where(F.col("col_idx").between(1, len(SHEET_COLUMNS))).join(head, list(SHEET)).where(F.col("row_idx") >= F.col("_head") + 2)
    at = [F.coalesce(F.max(F.when(F.col("col_idx") == i, F.col("value"))), F.lit("")).alias(c) for i, c in enumerate(SHEET_COLUMNS, 1)]
    rows = body.groupBy(*SHEET, "row_idx").agg(*at)
    return rows.where(~F.lower("serial_no").isin("serial no", "வ.எண்", "") | (F.col("name") != "") | (F.col("voter_id") != ""))


def merge_rolls(cells: DataFrame) -> DataFrame:
    """The ``MERGED`` columns of all voters, numbered from 1 by constituency, part, file, sheet and row.

    Numbers order constituencies and parts, and those that are no number come first.  Names stand in both name columns, as
    sheets hold one; section names in both scripts come from the part's number; the district code is empty.
    """
    spark = cells.sparkSession
    joined = sheet_voters(cells).join(sheet_metadata(cells), list(SHEET))
    found = range_lookup(joined, "part_no", section_ranges(spark))
    empty = F.lit("")
    columns = {
        "voter_name": "name", "voter_name_tamil": "name", "relation_name": "relation", "relation_name_tamil": "relation", "relation_type": "relation_type",
        "epic_number": "voter_id", "gender": "gender", "age": "age", "house_number": "house_no", "street_name": "street_name", "part_number": "part_no", "ac_number": "ac_no",
    }
    out = found.select(
        *SHEET, "row_idx", *[F.col(c).alias(n) for n, c in columns.items()],
        F.coalesce("section", empty).alias("section_name"), F.coalesce("section_tamil", empty).alias("section_name_tamil"), empty.alias("district_code"),
    )
    order = [F.coalesce(numeric(F.col(c)), F.lit(-1.0)) for c in ("ac_number", "part_number")]
    return number_rows(out, [*order, *SHEET, "row_idx"], "Serial No").select(*MERGED)


def roll_report(voters: DataFrame, rolls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, errors) of a bulk job, as tables.

    ``rolls``: pdf_index, filename, ac_no, part_no, error; ``voters``: pdf_index and the voter's columns.  The summary has a
    row for each file with voters (level ``booth``), one for each constituency and one for all, with files, voters and the
    share of all voters, by one ``rollup`` of the files' counts; errors are the files without voters and why.
    """
    counts = voters.groupBy("pdf_index").agg(F.count(F.lit(1)).alias("voters"))
    files = rolls.join(counts, "pdf_index", "left").withColumn("voters", F.coalesce("voters", F.lit(0)))
    good = files.where(F.col("error").isNull() & (F.col("voters") > 0))
    level = F.when(F.grouping("ac_no") == 1, "all").when(F.grouping("pdf_index") == 1, "constituency").otherwise("booth")
    rolled = good.rollup("ac_no", "pdf_index").agg(level.alias("level"), F.max("part_no").alias("part_no"), F.max("filename").alias("filename"), F.count(F.lit(1)).alias("files"), F.sum("voters").alias("voters"))
    total = good.agg(F.sum("voters")).first()[0]  # one number
    rolled = rolled.withColumn("share", F.col("voters") / F.nullif(F.lit(total).cast("long"), F.lit(0)))
    booth = F.col("level") == "booth"
    summary = rolled.withColumns({c: F.when(booth, F.col(c)) for c in ("part_no", "filename")})
    errors = files.where(F.col("error").isNotNull() | (F.col("voters") == 0))
    return summary, errors.select("pdf_index", "filename", F.coalesce("error", F.lit("No voters extracted")).alias("error"))


def write_report(voters: DataFrame, rolls: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Voters by constituency and part, the summary, and the errors if there are any, each in a folder of ``path``."""
    summary, errors = roll_report(voters, rolls)
    numbered = voters.join(rolls.select("pdf_index", "ac_no", "part_no"), "pdf_index")
    numbered.write.partitionBy("ac_no", "part_no").mode("overwrite").format(fmt).save(f"{path}/voters")
    summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")
    if not errors.isEmpty():
        errors.write.mode("overwrite").format(fmt).save(f"{path}/errors")
