"""The forms a table takes.

*Rows*: ``table_id, page, row_idx, cells array<string>``, ragged allowed.  *Cells*: one row for each cell,
``table_id, page, row_idx, col_idx, value``.  *Wide*: one column for each header, once the header is fixed.  Order is
always data (``page, row_idx, col_idx``), never the order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "table_id string, page int, row_idx int, cells array<string>"
HEADERS = "table_id string, headers array<string>"
WORDS = "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double"
LINES = "doc_id string, page int, line_no int, text string"
VOTERS = (
    "serial_no string, name string, father_husband_name string, relation_type string, house_no string, age string,"
    " gender string, voter_id string, street_name string"
)
ISSUES = "table_id string, severity string, code string, row_idx int, col_idx int, value string"


def to_cells(rows: DataFrame) -> DataFrame:
    """Rows to cells."""
    return rows.select("table_id", "page", "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def to_rows(cells: DataFrame, width: int | None = None) -> DataFrame:
    """Cells to dense rows: missing cells are empty, up to ``width`` or each table's widest row."""
    wide = F.lit(width) if width is not None else F.max("col_idx").over(_by("table_id")) + 1
    held = cells.withColumn("_w", wide).where("col_idx < _w").groupBy("table_id", "page", "row_idx").agg(
        F.first("_w").alias("_w"), F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("_m")
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("")))
    return held.select("table_id", "page", "row_idx", dense.alias("cells"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def fit_width(cells: Column, width: Column | int) -> Column:
    """Pad with empty cells or cut to ``width``; null cells become empty."""
    width = F.lit(width) if isinstance(width, int) else width
    filled = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(""), width)), 1, width)


def to_wide(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column for each name; names must differ (see ``operators.columns.distinct_names``)."""
    fitted = rows.withColumn("_c", fit_width(F.col("cells"), len(names)))
    return fitted.select("table_id", "page", "row_idx", *[F.col("_c")[i].alias(n) for i, n in enumerate(names)])


def from_wide(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide to cells under ``keys``."""
    return df.select(*keys, F.posexplode(F.array(*[F.col(f"`{n}`").cast("string") for n in names])).alias("col_idx", "value"))
