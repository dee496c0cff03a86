"""Validation of tables: issue rows, penalties, a confidence score and a grade, for all tables of a corpus at once.

Input is rows (``model.ROWS``), headers (``model.HEADERS``) and methods (``table_id, method``).  Order-dependent checks
use windows over ``(page, row_idx)`` of one table; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import numeric

#: Base confidence of methods, penalties of severities, keywords, bounds.
METHODS = {"pdfplumber": 0.95, "ocr": 0.75, "azure_di": 0.90, "azure_di_fallback": 0.90, "constituency_azure_di": 0.90, "structured": 0.90}
UNKNOWN_METHOD = 0.80
PENALTIES = {
    "structure": {"critical": 0.3, "error": 0.1, "warning": 0.02, "info": 0.01},
    "types": {"critical": 0.3, "error": 0.08, "warning": 0.02, "info": 0.01},
    "consistency": {"critical": 0.3, "error": 0.08, "warning": 0.02, "info": 0.01},
}
NUMERIC_WORDS = ("vote", "count", "total", "valid", "rejected", "nota")
STATION_WORDS = ("polling", "station", "sl", "serial", "no", "booth", "ps")
NOTA_WORDS = ("nota", "none of the above")
COLUMNS, ROWS_RANGE = (8, 30), (30, 500)
OCR_PATTERNS = ("[0-9][OoIl]", "[OoIl][0-9]", "[0-9][SBZ]|[SBZ][0-9]")
MOST_DETAIL = {"INVALID_NUMERIC": 10, "NEGATIVE_NUMBER": 5, "LARGE_NUMBER": 3}
LARGE, VERY_LARGE = 50_000, 100_000
#: Row numbers of one block, within which a table's rows are put in order.
BLOCK = 4096


def _issue(df: DataFrame, severity: str, code: str, row: Column | None = None, col: Column | None = None, value: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "table_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"),
        (none if row is None else row).cast("int").alias("row_idx"), (none if col is None else col).cast("int").alias("col_idx"),
        (none if value is None else value).cast("string").alias("value"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``n``, their number from 0 within the table."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy("table_id").orderBy("page", "row_idx")) - 1)


def _with_word(headers: Column, words: tuple[str, ...]) -> Column:
    def hit(h: Column) -> Column:
        low = F.lower(F.trim(F.coalesce(h, F.lit(""))))
        return reduce(lambda a, b: a | b, [low.contains(w) | F.reverse(low).contains(w) for w in words])

    return F.exists(headers, hit)


def structure_issues(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Missing headers, an unlikely first column, widths and lengths out of range, no NOTA column."""
    o = ordered(rows)
    digits = F.get("cells", F.lit(0)).rlike("[0-9]")
    size = o.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("n") < 10) & digits).alias("numbered"))
    t = headers.join(size, "table_id", "left").fillna(0, ["rows", "numbered"])
    n = F.size("headers")
    has = t.where(n > 0)
    first_ok = _with_word(F.slice("headers", 1, 1), STATION_WORDS) | (F.col("numbered") >= 5)
    return _union(
        [
            _issue(t.where((n <= 0) | n.isNull()), "critical", "NO_HEADERS"),
            _issue(has.where(~first_ok), "warning", "INVALID_FIRST_COLUMN"),
            _issue(has.where(n < COLUMNS[0]), "warning", "FEW_COLUMNS", value=n),
            _issue(has.where(n > COLUMNS[1]), "info", "MANY_COLUMNS", value=n),
            _issue(has.where(~_with_word(F.col("headers"), NOTA_WORDS)), "warning", "NO_NOTA_COLUMN"),
            _issue(has.where(F.col("rows") < ROWS_RANGE[0]), "warning", "FEW_ROWS", value=F.col("rows")),
            _issue(has.where(F.col("rows") > ROWS_RANGE[1]), "info", "MANY_ROWS", value=F.col("rows")),
        ]
    )


def numeric_positions(headers: DataFrame) -> DataFrame:
    """(table_id, col_idx): columns but the first whose header says they count, else columns 2 to 16."""
    low = F.transform("headers", lambda h: F.lower(F.coalesce(h, F.lit(""))))
    named = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("headers") - 1, F.lit(0))),
        lambda i: (i > 0) & reduce(lambda a, b: a | b, [F.coalesce(F.get(low, i), F.lit("")).contains(w) for w in NUMERIC_WORDS]),
    )
    rest = F.when(F.size("headers") > 2, F.sequence(F.lit(2), F.least(F.lit(16), F.size("headers") - 1))).otherwise(F.array().cast("array<int>"))
    return headers.select("table_id", F.explode(F.when(F.size(named) > 0, named).otherwise(rest)).alias("col_idx"))


def type_issues(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """OCR letters, text, negative and very large numbers in counting columns, with capped detail and summaries."""
    cells = ordered(rows).select("table_id", "n", F.posexplode("cells").alias("col_idx", "value")).join(numeric_positions(headers), ["table_id", "col_idx"])
    v = F.trim(F.coalesce("value", F.lit("")))
    cells = cells.where(v != "").withColumn("x", numeric(v))
    letters = F.lit(False)
    for p in OCR_PATTERNS:
        letters = letters | v.rlike(p)
    # a lone letter for a digit is text here: only letters beside digits count as misread
    kind = (
        F.when(letters, "OCR_ERROR")
        .when(F.col("x").isNull() & numeric(F.reverse(v)).isNull(), "INVALID_NUMERIC")
        .when(F.col("x") < 0, "NEGATIVE_NUMBER")
        .when(F.col("x") > LARGE, "LARGE_NUMBER")
    )
    found = cells.withColumn("code", kind).where("code IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("table_id", "code").orderBy("col_idx", "n"))
    found = found.withColumn("r", rank)
    most = F.when(F.col("code") == "INVALID_NUMERIC", 10).when(F.col("code") == "NEGATIVE_NUMBER", 5).when(F.col("code") == "LARGE_NUMBER", 3).otherwise(1 << 30)
    shown = found.where((F.col("r") <= most) & ((F.col("code") != "LARGE_NUMBER") | (F.col("x") > VERY_LARGE)))
    severity = F.when(F.col("code") == "OCR_ERROR", "warning").when(F.col("code") == "LARGE_NUMBER", "info").otherwise("error")
    detail = shown.select("table_id", severity.alias("severity"), "code", F.col("n").cast("int").alias("row_idx"), "col_idx", F.col("value"))
    counts = found.groupBy("table_id", "code").agg(F.count(F.lit(1)).alias("c"))

    def many(code: str, over: int, severity: str, name: str) -> DataFrame:
        return _issue(counts.where((F.col("code") == code) & (F.col("c") > over)), severity, name, value=F.col("c"))

    none = headers.join(numeric_positions(headers), "table_id", "left_anti").where(F.size("headers") > 0)
    return _union(
        [
            detail,
            many("INVALID_NUMERIC", 10, "error", "MANY_INVALID_NUMERIC"),
            many("NEGATIVE_NUMBER", 5, "error", "MANY_NEGATIVE"),
            many("OCR_ERROR", 10, "warning", "MANY_OCR_ERRORS"),
            _issue(none, "warning", "NO_NUMERIC_COLUMNS"),
        ]
    )


def _capped(found: DataFrame, most: int, one: tuple[str, str], many: tuple[str, str]) -> DataFrame:
    """Up to ``most`` issues of a table in detail, else one that counts them."""
    counted = found.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("table_id")))
    detail = _issue(counted.where(F.col("_c") <= most), *one, row=F.col("n"), value=F.col("v"))
    total = counted.where(F.col("_c") > most).groupBy("table_id").agg(F.first("_c").alias("v"))
    return detail.unionByName(_issue(total, *many, value=F.col("v")))


def width_issues(rows: DataFrame, headers: DataFrame) -> DataFrame:
    wrong = ordered(rows).join(headers, "table_id").where(F.size("cells") != F.size("headers")).withColumn("v", F.size("cells"))
    return _capped(wrong, 5, ("warning", "COLUMN_MISMATCH"), ("error", "COLUMN_MISMATCH"))


def station_gaps(rows: DataFrame, over: int = 5) -> DataFrame:
    """(table_id, n, before, number, gap): steps of more than ``over`` between the numbers of the first column."""
    number = F.nullif(F.regexp_extract(F.get("cells", F.lit(0)), "([0-9]+)", 1), F.lit("")).try_cast("long")
    numbered = ordered(rows).withColumn("number", number).where("number IS NOT NULL")
    before = F.lag("number").over(W.partitionBy("table_id").orderBy("n"))
    return numbered.withColumn("before", before).withColumn("gap", F.col("number") - F.col("before")).where(F.col("gap") > over).select("table_id", "n", "before", "number", "gap")


def gap_issues(rows: DataFrame) -> DataFrame:
    return _capped(station_gaps(rows).withColumn("v", F.col("gap")), 3, ("info", "STATION_GAP"), ("warning", "LARGE_STATION_GAPS"))


def duplicate_stations(rows: DataFrame) -> DataFrame:
    """Rows whose first cell came before, blank cells included."""
    key = F.lower(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    again = F.row_number().over(W.partitionBy("table_id", "v").orderBy("n"))
    return ordered(rows).withColumn("v", key).withColumn("_r", again).where("_r > 1").drop("_r")


def duplicate_issues(rows: DataFrame) -> DataFrame:
    return _capped(duplicate_stations(rows), 5, ("error", "DUPLICATE_STATION"), ("error", "MANY_DUPLICATE_STATIONS"))


def column_total_check(rows: DataFrame, headers: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(table_id, col_idx, stated, computed): columns whose sum is not what the last total row states.

    All other rows are summed, earlier subtotals included.
    """
    o = ordered(rows).withColumn("_t", F.upper(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))).contains("TOTAL"))
    last = F.max(F.when(F.col("_t"), F.col("n"))).over(W.partitionBy("table_id"))
    cells = o.withColumn("_last", last).where("_last IS NOT NULL").select("table_id", "n", "_last", F.posexplode("cells").alias("col_idx", "value"))
    cells = cells.join(headers.select("table_id", F.size("headers").alias("_w")), "table_id").where("col_idx > 0 AND col_idx < _w")
    x, is_total = numeric(F.trim("value")), F.col("n") == F.col("_last")
    sums = cells.groupBy("table_id", "col_idx").agg(
        F.max(F.when(is_total, x)).alias("stated"), F.sum(F.when(~is_total, x)).alias("computed"), F.count(F.when(~is_total, x)).alias("valid")
    )
    return sums.where((F.col("valid") > 0) & (F.abs(F.col("stated") - F.col("computed")) > tolerance)).drop("valid")


def total_issues(rows: DataFrame, headers: DataFrame) -> DataFrame:
    return _issue(column_total_check(rows, headers), "warning", "TOTAL_MISMATCH", col=F.col("col_idx"), value=F.col("stated") - F.col("computed"))


def row_sum_check(rows: DataFrame, station: int, total: int, tolerance: float = 0.0) -> DataFrame:
    """Rows whose counts between two columns do not add up to the stated total: table_id, page, row_idx, stated, computed."""
    parts = F.slice("cells", station + 2, total - station - 1)
    summed = F.aggregate(parts, F.lit(0.0), lambda s, c: s + F.coalesce(numeric(F.trim(c)), F.lit(0.0)))
    stated = numeric(F.trim(F.get("cells", F.lit(total))))
    checked = rows.select("table_id", "page", "row_idx", stated.alias("stated"), summed.alias("computed"))
    return checked.where(F.abs(F.col("stated") - F.col("computed")) > tolerance)


def empty_ratio(rows: DataFrame) -> DataFrame:
    cell = F.explode("cells")
    blank = (F.trim(F.coalesce("c", F.lit(""))) == "").cast("int")
    return rows.select("table_id", cell.alias("c")).groupBy("table_id").agg(F.avg(blank).alias("empty_ratio"))


def type_consistency(rows: DataFrame, headers: DataFrame, least: float = 0.8) -> DataFrame:
    """The share of counting columns whose filled cells are numbers to more than ``least``."""
    cells = rows.select("table_id", F.posexplode("cells").alias("col_idx", "value")).join(numeric_positions(headers), ["table_id", "col_idx"])
    v = F.trim(F.coalesce("value", F.lit("")))
    share = cells.where(v != "").groupBy("table_id", "col_idx").agg(F.avg(numeric(v).isNotNull().cast("int")).alias("s"))
    return share.groupBy("table_id").agg(F.avg((F.col("s") >= least).cast("int")).alias("type_consistency"))


def scores(issues: DataFrame, tables: DataFrame, kind: str) -> DataFrame:
    """(table_id, score): 1 less the penalties of the issues, within 0 and 1; tables without issues have 1."""
    weight = reduce(lambda w, k: w.when(F.col("severity") == k, PENALTIES[kind][k]), PENALTIES[kind], F.when(F.lit(False), 0.0))
    summed = issues.groupBy("table_id").agg(F.sum(weight).alias("p"))
    return tables.join(summed, "table_id", "left").select("table_id", F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("p", F.lit(0.0))).alias("score"))


def confidence(method: Column, mean_score: Column, consistency: Column, empty: Column) -> Column:
    base = reduce(lambda w, m: w.when(F.lower(method) == m, METHODS[m]), METHODS, F.when(F.lit(False), 0.0)).otherwise(UNKNOWN_METHOD)
    value = (base * 0.4 + mean_score * 0.4 + consistency * 0.2) * (1 - 0.3 * empty)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def grade(conf: Column, errors: Column) -> Column:
    return (
        F.when((conf >= 0.95) & (errors == 0), "A").when((conf >= 0.85) & (errors <= 1), "B")
        .when((conf >= 0.70) & (errors <= 3), "C").when(conf >= 0.50, "D").otherwise("F")
    )


def _misread(v: Column) -> Column:
    """Whether a cell has a letter beside a digit that it may stand for: any of ``OCR_PATTERNS``."""
    return v.rlike("|".join(OCR_PATTERNS))


def column_profile(rows: DataFrame) -> DataFrame:
    """(table_id, col_idx, cells, blank, filled, numbers, misread, words, negative, plain_sum, plain_n): counts of each column.

    Of the first column, which never counts, only ``cells`` and ``blank`` are told.  ``plain_sum`` and ``plain_n`` are of the
    rows that state no total.  One pass, summed up before the shuffle, and no table is sorted.
    """
    cells = rows.select("table_id", _states_total().alias("_t"), F.posexplode("cells").alias("col_idx", "value"))
    v = F.trim(F.coalesce("value", F.lit("")))
    cells = cells.withColumn("_v", v).withColumn("_on", (F.col("_v") != "") & (F.col("col_idx") > 0))
    cells = cells.withColumn("_x", F.when(F.col("_on"), numeric(F.col("_v"))))
    number = F.col("_x").isNotNull()
    # most cells of letters beside digits are no numbers, and numbers have no such letters but an exponent's
    cells = cells.withColumn("_misread", F.col("_on") & F.when(F.col("_on"), _misread(F.col("_v"))))
    misread = F.col("_misread")
    text = F.col("_on") & ~number & ~misread
    text = text & F.when(text, numeric(F.reverse("_v")).isNull())
    return cells.groupBy("table_id", "col_idx").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("_v") == "").alias("blank"), F.count_if("_on").alias("filled"), F.count_if(number).alias("numbers"),
        F.count_if(misread).alias("misread"), F.count_if(text).alias("words"), F.count_if(~misread & (F.col("_x") < 0)).alias("negative"),
        F.sum(F.when(~F.col("_t"), F.col("_x"))).alias("plain_sum"), F.count(F.when(~F.col("_t"), F.col("_x"))).alias("plain_n"),
    )


def _states_total() -> Column:
    return F.upper(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))).contains("TOTAL")


def _wrong_totals(rows: DataFrame, headers: DataFrame, profile: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(table_id, totals): how many columns ``column_total_check`` finds, by the sums of the profile and the rows of totals."""
    stating = rows.where(_states_total())
    last = F.row_number().over(W.partitionBy("table_id").orderBy(F.desc_nulls_last("page"), F.desc_nulls_last("row_idx"))) == 1
    cells = stating.withColumn("_last", last).select("table_id", "_last", F.posexplode("cells").alias("col_idx", "value"))
    x, is_total = numeric(F.trim("value")), F.col("_last")
    own = cells.groupBy("table_id", "col_idx").agg(F.max(F.when(is_total, x)).alias("stated"), F.sum(F.when(~is_total, x)).alias("_sum"), F.count(F.when(~is_total, x)).alias("_n"))
    both = own.join(profile.select("table_id", "col_idx", "plain_sum", "plain_n"), ["table_id", "col_idx"])
    both = both.join(headers.select("table_id", F.size("headers").alias("_w")), "table_id").where("col_idx > 0 AND col_idx < _w")
    computed = F.coalesce("plain_sum", F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0))
    wrong = both.where((F.col("plain_n") + F.col("_n") > 0) & (F.abs(F.col("stated") - computed) > tolerance))
    return wrong.groupBy("table_id").agg(F.count(F.lit(1)).alias("totals"))


def _steps(rows: DataFrame, over: int = 5) -> DataFrame:
    """(table_id, rows, numbered, gaps): the length of each table, how many of its first ten rows have digits in the first cell,
    and how many ``station_gaps`` it has.

    Rows are ordered within blocks of ``BLOCK`` row numbers, so a long table is many groups; what goes on from block to
    block (the last number, the count of rows) is told by one row a block.
    """
    first = F.get("cells", F.lit(0))
    number = F.nullif(F.regexp_extract(first, "([0-9]+)", 1), F.lit("")).try_cast("long")
    told = rows.select("table_id", "page", F.floor(F.col("row_idx") / BLOCK).alias("_block"), "row_idx", number.alias("_x"), F.coalesce(first.rlike("[0-9]"), F.lit(False)).alias("_d"))
    within = W.partitionBy("table_id", "page", "_block").orderBy("row_idx")
    before = F.last("_x", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1))
    told = told.withColumn("_i", F.row_number().over(within)).withColumn("_gap", F.col("_x") - before > over)
    blocks = told.groupBy("table_id", "page", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_gap").alias("_gaps"), F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("_i"))).alias("_first"),
        F.max_by("_x", F.when(F.col("_x").isNotNull(), F.col("_i"))).alias("_last"), F.collect_list(F.when((F.col("_i") <= 10) & F.col("_d"), F.col("_i"))).alias("_ds"),
    )
    by = W.partitionBy("table_id").orderBy("page", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(by), F.lit(0))).withColumn("_up", F.last("_last", ignorenulls=True).over(by))
    ten = F.size(F.filter("_ds", lambda i: i + F.col("_offset") <= 10))
    return blocks.groupBy("table_id").agg(F.sum("_n").alias("rows"), F.sum(ten).alias("numbered"), (F.sum("_gaps") + F.count_if(F.col("_first") - F.col("_up") > over)).alias("gaps"))


def _large_shown(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """(table_id, large): how many of the first three large numbers of a table, by column and row, are very large."""
    x = numeric(F.trim(F.coalesce("value", F.lit(""))))
    cells = rows.select("table_id", "page", "row_idx", F.posexplode("cells").alias("col_idx", "value")).where("col_idx > 0")
    cells = cells.withColumn("_x", x).where((F.col("_x") > LARGE) & ~_misread(F.trim("value"))).drop("value")
    most = MOST_DETAIL["LARGE_NUMBER"]
    cells = cells.withColumn("_r", F.row_number().over(W.partitionBy("table_id", "col_idx").orderBy("page", "row_idx"))).where(F.col("_r") <= most)
    cells = cells.join(positions, ["table_id", "col_idx"]).withColumn("_r", F.row_number().over(W.partitionBy("table_id").orderBy("col_idx", "_r")))
    return cells.where((F.col("_r") <= most) & (F.col("_x") > VERY_LARGE)).groupBy("table_id").agg(F.count(F.lit(1)).alias("large"))


def issue_counts(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, empty_ratio, type_consistency, <check>_<severity>): how many issues each table with headers has.

    These are the counts of the issues that ``validate`` lists, without the list: columns and widths are summed up before they are shuffled,
    rows are shuffled twice, by block of their table and by first cell, and no table is one group.
    """
    profile, positions = column_profile(rows), numeric_positions(headers)
    zero, whole = F.lit(0), lambda c: F.coalesce(c.cast("long"), F.lit(0))
    blank = profile.groupBy("table_id").agg((F.sum("blank") / F.sum("cells")).alias("empty_ratio"))
    counted = profile.join(positions, ["table_id", "col_idx"])
    share = F.when(F.col("filled") > 0, (F.col("numbers") / F.col("filled") >= 0.8).cast("int"))
    counted = counted.groupBy("table_id").agg(F.avg(share).alias("type_consistency"), *[F.sum(c).alias(c) for c in ("misread", "words", "negative")])
    widths = rows.groupBy("table_id", F.size("cells").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    widths = widths.join(headers, "table_id").where(F.col("_c") != F.size("headers")).groupBy("table_id").agg(F.sum("_n").alias("widths"))
    key = F.lower(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    again = rows.groupBy("table_id", key.alias("_v")).agg((F.count(F.lit(1)) - 1).alias("_n")).groupBy("table_id").agg(F.sum("_n").alias("again"))
    t = headers.select("table_id", "headers").join(_steps(rows), "table_id", "left").fillna(0, ["rows", "numbered", "gaps"])
    n = F.size("headers")
    first_ok = _with_word(F.slice("headers", 1, 1), STATION_WORDS) | (F.col("numbered") >= 5)
    has = F.coalesce(n > 0, F.lit(False))
    t = t.withColumns(
        {
            "structure_critical": whole(~has),
            "structure_warning": F.when(has, whole(~first_ok) + whole(n < COLUMNS[0]) + whole(~_with_word(F.col("headers"), NOTA_WORDS)) + whole(F.col("rows") < ROWS_RANGE[0])).otherwise(zero),
            "structure_info": F.when(has, whole(n > COLUMNS[1]) + whole(F.col("rows") > ROWS_RANGE[1])).otherwise(zero),
        }
    )
    t = t.join(positions.select("table_id").distinct().withColumn("_some", F.lit(True)), "table_id", "left").withColumn("_none", whole(has & F.col("_some").isNull()))
    t = t.groupBy("table_id").agg(F.max("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in ("structure_critical", "structure_warning", "structure_info", "_none")])
    for part in (blank, counted, widths, again, _wrong_totals(rows, headers, profile), _large_shown(rows, positions)):
        t = t.join(part, "table_id", "left")
    t = t.fillna(0, ["misread", "words", "negative", "widths", "again", "totals", "large"])
    c = {x: F.col(x) for x in ("misread", "words", "negative", "widths", "again", "totals", "large", "gaps", "_none")}
    shown = lambda name, most: F.least(c[name], F.lit(most)) + whole(c[name] > most)
    few = lambda name, most: F.when(c[name] <= most, c[name]).otherwise(zero)
    return t.select(
        "table_id", "empty_ratio", "type_consistency", "structure_critical", zero.cast("long").alias("structure_error"), "structure_warning", "structure_info",
        zero.cast("long").alias("types_critical"), (shown("words", 10) + shown("negative", 5)).alias("types_error"), (c["misread"] + whole(c["misread"] > 10) + c["_none"]).alias("types_warning"), c["large"].alias("types_info"),
        zero.cast("long").alias("consistency_critical"), (whole(c["widths"] > 5) + F.when(c["again"] <= 5, c["again"]).otherwise(F.lit(1))).alias("consistency_error"),
        (few("widths", 5) + whole(c["gaps"] > 3) + c["totals"]).alias("consistency_warning"), few("gaps", 3).alias("consistency_info"),
    )


def validate(rows: DataFrame, headers: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, issues): one report row for each table with scores, counts, confidence, grade and ``passed``.

    The report counts issues by ``issue_counts``; only ``issues`` lists them.
    """
    parts = {
        "structure": structure_issues(rows, headers),
        "types": type_issues(rows, headers),
        "consistency": _union([width_issues(rows, headers), gap_issues(rows), duplicate_issues(rows), total_issues(rows, headers)]),
    }
    issues = _union([f.withColumn("check", F.lit(k)) for k, f in parts.items()])
    counts = issue_counts(rows, headers)
    for kind, weights in PENALTIES.items():
        lost = reduce(lambda a, b: a + b, [F.col(f"{kind}_{s}") * w for s, w in weights.items()])
        counts = counts.withColumn(kind, F.greatest(F.lit(0.0), F.lit(1.0) - lost))
    severities = ("critical", "error", "warning", "info")
    counts = counts.withColumns({s + "s": reduce(lambda a, b: a + b, [F.col(f"{k}_{s}") for k in PENALTIES]) for s in severities})
    counts = counts.select("table_id", "empty_ratio", "type_consistency", *PENALTIES, *[s + "s" for s in severities])
    report = headers.select("table_id").distinct().join(methods, "table_id", "left").join(counts, "table_id").fillna(0.0, ["empty_ratio"])
    mean = (F.col("structure") + F.col("types") + F.col("consistency")) / 3
    conf = confidence(F.coalesce("method", F.lit("unknown")), mean, F.coalesce("type_consistency", F.lit(1.0)), F.col("empty_ratio"))
    report = report.withColumn("confidence", conf)
    report = report.withColumn("grade", grade(F.col("confidence"), F.col("errors") + F.col("criticals")))
    return report.withColumn("passed", (F.col("criticals") == 0) & (F.col("confidence") >= 0.5)), issues


def capped_issues(issues: DataFrame, most: int, order: list[str] | None = None) -> DataFrame:
    """The first ``most`` issues of each table by severity and place."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    w = W.partitionBy("table_id").orderBy(*(order or [rank, "code", "row_idx", "col_idx"]))
    return issues.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def missing_profile(df: DataFrame) -> DataFrame:
    """For each column the number of blank and of all values, in long form."""
    blanks = [F.count_if(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == "").alias(c) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *blanks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("blank"), F.col("_n").alias("rows")) for c in df.columns])).alias("s")).select("s.*")


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected (key, expected, deleted) against the rows found: key, expected, found, missing, fill (share with an id)."""
    found = actual.groupBy(key).agg(F.count(F.lit(1)).alias("found"), F.avg((F.coalesce("voter_id", F.lit("")) != "").cast("int")).alias("fill"))
    return expected.join(found, key, "left").fillna(0, ["found"]).withColumn("missing", F.col("expected") - F.coalesce("deleted", F.lit(0)) - F.col("found"))


def workbook_quality(cells: DataFrame) -> DataFrame:
    """Counts of formulas, error values and empty cells for each table."""
    v = F.coalesce("value", F.lit(""))
    return cells.groupBy("table_id").agg(
        F.count_if(v.startswith("=")).alias("formulas"), F.count_if(v.rlike("^#(REF|DIV/0|VALUE|NAME|N/A|NUM|NULL)")).alias("errors"),
        F.count_if(F.trim(v) == "").alias("empty"), F.count(F.lit(1)).alias("cells"),
    )


def compare_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each table the sizes of two versions and whether they have the same shape; cells a and b."""
    def shape(d: DataFrame, side: str) -> DataFrame:
        return d.groupBy("table_id").agg((F.max("row_idx") + 1).alias("rows_" + side), (F.max("col_idx") + 1).alias("cols_" + side), F.count_if(F.trim("value") != "").alias("filled_" + side))

    both = shape(a, "a").join(shape(b, "b"), "table_id", "full")
    return both.withColumn("same", F.coalesce((F.col("rows_a") == F.col("rows_b")) & (F.col("cols_a") == F.col("cols_b")), F.lit(False)))


def batch_totals(files: DataFrame) -> DataFrame:
    """Files (pages, rows, seconds, ok) of a batch: sums, rates and cost at a cent a page."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("good"), F.sum("pages").alias("pages"), F.sum("rows").alias("rows"),
        F.try_divide(F.sum("seconds"), F.sum("pages")).alias("seconds_a_page"), (F.sum("pages") * F.lit(0.01)).alias("cost"),
    )


def best_grid(grids: DataFrame, expected_columns: int | None = None) -> DataFrame:
    """(page_id, pos, score) of the best grid of each page: capped line counts, a bonus for the expected width, evenness.

    ``grids``: page_id, pos, h array<double>, v array<double>; grids need three lines each way.
    """
    def even(lines: str) -> Column:
        gaps = F.zip_with(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda b, a: b - a)
        n = F.size(gaps)
        mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / n
        square = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) / n
        return F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / F.greatest(mean, F.lit(1e-9)))

    usable = grids.where((F.size("h") >= 3) & (F.size("v") >= 3))
    match = F.lit(0.0) if expected_columns is None else F.greatest(F.lit(0.0), 20 - 5 * F.abs(F.size("v") - 1 - expected_columns))
    score = F.least(F.size("h"), F.lit(50)) + F.least(F.size("v"), F.lit(30)) + match + 10 * even("h") + 10 * even("v")
    return usable.withColumn("score", score).groupBy("page_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b")).select("page_id", (-F.col("b.p")).alias("pos"), "b.score")


def classify_pages(pages: DataFrame, sample: int = 5) -> DataFrame:
    """(doc_id, kind, text_share): text, image or mixed, by evenly spaced sample pages of each document."""
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / sample))
    taken = pages.withColumn("_n", n).withColumn("_i", at).where(F.col("_i") % step == 0)
    is_text = (F.col("n_chars") >= 100) & ((F.coalesce("image_cover", F.lit(0.0)) < 0.7) | (F.col("n_chars") > 500))
    share = taken.groupBy("doc_id").agg(F.avg(is_text.cast("int")).alias("text_share"))
    return share.withColumn("kind", F.when(F.col("text_share") >= 0.8, "text").when(F.col("text_share") <= 0.2, "image").otherwise("mixed"))
