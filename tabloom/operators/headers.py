"""Headers of several rows to one name a column, numbered independents, and where folded columns go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import party_in_cell, sanitize
from tabloom.operators.lookup import NOT_CANDIDATES
from tabloom.operators.rows import drop_repeated_headers, filled

#: Fixed labels that span columns and name none, and words in the first cell of a row of parties.
SPANNING = ("NO. OF VALID VOTES CAST IN FAVOUR OF", "VALID VOTES", "PARTY ABBREVIATION")
PARTY_ROW = ("PARTY", "ABBREVIATION")
INDEPENDENT = ("IND", "INDEPENDENT")
#: Fixed words that headers have; a row with two of them is one.
INDICATORS = (
    "polling station", "sl. no", "sl no", "s.no", "serial", "candidate", "party", "nota", "valid votes", "total votes", "no. of valid votes", "favour of",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def combine_header_rows(header_rows: DataFrame) -> DataFrame:
    """(table_id, col_idx, header) of header rows (table_id, row_idx, cells), one above the other.

    A single row is taken as it stands.  Of several, spanning labels count for nothing.  If one has a first cell that says
    party or abbreviation, a column with two parts or more is named by its cell in that row, else by the parentheses of
    its last cell above it, else by that cell; all other columns by their last cell, and empty ones are ``Column k``.
    """
    value = sanitize(F.coalesce("value", F.lit("")))
    first = F.upper(sanitize(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    shape = header_rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.size("cells")).alias("_width"), F.min(F.when(_any(first, PARTY_ROW), F.col("row_idx"))).alias("_party_row")
    )
    parts = header_rows.select("table_id", "row_idx", F.posexplode("cells").alias("col_idx", "value")).join(shape, "table_id")
    parts = parts.withColumn("value", value)
    label = (F.col("col_idx") == 0) & _any(F.upper("value"), PARTY_ROW)
    counts = (F.col("value") != "") & ((F.col("_rows") == 1) | ~(label | F.upper("value").isin(*SPANNING)))
    parts = parts.where(counts)
    at = lambda condition: F.max_by(F.when(condition, F.col("value")), F.when(condition, F.col("row_idx")))
    own = parts.groupBy("table_id", "col_idx").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("value", "row_idx").alias("_last"),
        at(F.col("row_idx") == F.col("_party_row")).alias("_party"), at(F.col("row_idx") < F.col("_party_row")).alias("_name"),
    )
    inside = F.nullif(F.trim(F.regexp_extract("_name", r"\(([^)]+)\)", 1)), F.lit(""))
    chosen = F.when(F.col("_n") >= 2, F.coalesce("_party", inside, "_name", "_last")).otherwise(F.col("_last"))
    every = shape.select("table_id", "_rows", F.explode(F.sequence(F.lit(0), F.col("_width") - 1)).alias("col_idx"))
    joined = every.join(own, ["table_id", "col_idx"], "left")
    blank = F.when(F.col("_rows") == 1, "").otherwise(F.concat(F.lit("Column "), (F.col("col_idx") + 1).cast("string")))
    return joined.select("table_id", "col_idx", F.coalesce(chosen, blank).alias("header"))


def standard_headers(headers: DataFrame) -> DataFrame:
    """(table_id, col_idx, header, standard, is_party): party columns by their party, independents numbered ``IND_1``, ``IND_2``.

    Independents count by column within a table.  Columns that name no candidate are their own name in capitals, other
    headers stay, and empty ones are ``Column_k``.
    """
    text = sanitize(F.col("header"))
    plain = F.lower(text).isin(*NOT_CANDIDATES)
    h = headers.withColumn("_t", text).withColumn("_party", F.when(~plain, F.upper(party_in_cell(text))))
    alone = F.coalesce(F.col("_party").isin(*INDEPENDENT), F.lit(False))
    number = F.sum(alone.cast("int")).over(W.partitionBy("table_id").orderBy("col_idx").rowsBetween(W.unboundedPreceding, 0))
    name = (
        F.when(F.col("_t") == "", F.concat(F.lit("Column_"), F.col("col_idx").cast("string")))
        .when(plain, F.upper("_t")).when(alone, F.concat(F.lit("IND_"), number.cast("string"))).otherwise(F.coalesce("_party", "_t"))
    )
    return h.select("table_id", "col_idx", "header", name.alias("standard"), F.col("_party").isNotNull().alias("is_party"))


def fold_positions(headers: DataFrame, alliances: DataFrame) -> DataFrame:
    """(table_id, col_idx, new_idx, new_header): where each column goes when allies are folded into their main parties.

    ``headers``: table_id, col_idx, header, party (null for other columns); ``alliances``: main, ally.  Groups, which are a main
    party's columns and those of its allies, stand first, in the order of their first column, named by the main party's first
    column or, without one, ``<main> Votes``; the other columns follow in order.  Mains without an ally in a table are no group.
    """
    ally = alliances.select(F.col("main").alias("_main"), F.col("ally").alias("party")).distinct()
    marked = headers.join(ally, "party", "left")
    mains = marked.where("_main IS NOT NULL").select("table_id", F.col("_main").alias("party")).distinct().withColumn("_own", F.lit(True))
    marked = marked.join(mains, ["table_id", "party"], "left")
    marked = marked.withColumn("_group", F.coalesce("_main", F.when(F.col("_own"), F.col("party"))))
    by = W.partitionBy("table_id", "_group")
    lead = F.min(F.when(F.col("_own") & F.col("_main").isNull(), F.struct("col_idx", "header"))).over(by)
    first = F.when(F.col("_group").isNotNull(), F.min("col_idx").over(by)).otherwise(F.col("col_idx"))
    name = F.when(F.col("_group").isNull(), F.col("header")).otherwise(F.coalesce(lead["header"], F.concat("_group", F.lit(" Votes"))))
    marked = marked.withColumns({"_lead": name, "_first": first})
    place = F.dense_rank().over(W.partitionBy("table_id").orderBy(F.col("_group").isNull(), "_first")) - 1
    return marked.select("table_id", "col_idx", place.alias("new_idx"), F.col("_lead").alias("new_header"))


def is_header_by_indicators(cells: Column) -> Column:
    """Two of the words that headers have, in any cells."""
    text = F.lower(F.array_join(filled(cells), " "))
    return sum((F.contains(text, F.lit(w)).cast("int") for w in INDICATORS), F.lit(0)) >= 2


def drop_duplicate_headers(rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Rows that neither repeat a header row of their table (see ``rows.drop_repeated_headers``) nor have two header words."""
    return drop_repeated_headers(rows, header_rows).where(~is_header_by_indicators(F.col("cells")))


def is_title_row(cells: Column) -> Column:
    """At most two filled cells, and at least one."""
    return F.size(filled(cells)).between(1, 2)
