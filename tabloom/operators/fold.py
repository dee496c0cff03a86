"""Folding of column groups: allies into a main column, the unselected rest into ``Others Votes``, and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import numeric


def _value(df: DataFrame, name: str) -> Column:
    """A column as a number, 0 where it is none."""
    field = next(t for n, t in df.dtypes if n == name)
    c = F.col(f"`{name}`")
    return F.coalesce(numeric(c) if field == "string" else c.cast("double"), F.lit(0.0))


def fold(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each main column becomes itself plus its allies, once; allies are dropped; a missing main is made.

    Columns that are not there are ignored, unless none of a group is.  A made main stands where its first ally stood.
    """
    groups = {m: [a for a in allies if a in df.columns] for m, allies in groups.items()}
    groups = {m: allies for m, allies in groups.items() if allies or m in df.columns}
    gone = {a for allies in groups.values() for a in allies}
    at = {m if m in df.columns else allies[0]: m for m, allies in groups.items()}
    out = []
    for c in df.columns:
        if c in at:
            main = at[c]
            parts = ([main] if main in df.columns else []) + list(groups[main])
            out.append(reduce(lambda x, y: x + y, [_value(df, p) for p in parts]).alias(main))
        elif c not in gone:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def fold_cells(cells: DataFrame, alliances: DataFrame, keys: Sequence[str] = ("table_id", "row_idx")) -> DataFrame:
    """The same in long form: cells (keys, party, value) and alliances (main, ally), by one join and one sum."""
    joined = cells.join(alliances, cells["party"] == alliances["ally"], "left")
    return joined.groupBy(*keys, F.coalesce("main", "party").alias("party")).agg(F.sum(F.coalesce(numeric(F.col("value")), F.lit(0.0))).alias("votes"))


def others(df: DataFrame, keep: Sequence[str], add: Sequence[str], name: str = "Others Votes", legacy: bool = False) -> DataFrame:
    """Keep columns and the whole row sum of others; ``legacy`` counts numbers with commas as 0."""
    def value(c: str) -> Column:
        return F.coalesce(F.trim(F.col(f"`{c}`").cast("string")).try_cast("double"), F.lit(0.0)) if legacy else _value(df, c)

    total = reduce(lambda x, y: x + y, [value(c) for c in add], F.lit(0.0))
    return df.select(*[F.col(f"`{c}`") for c in keep], total.cast("long").alias(name))


def numeric_columns(df: DataFrame, least: float = 0.5) -> list[str]:
    """Columns at least ``least`` of whose non-empty cells are numbers; one aggregate over the table."""
    texts = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns}
    row = df.agg(*[F.avg(F.when(t != "", numeric(t).isNotNull().cast("int"))).alias(str(i)) for i, t in enumerate(texts.values())]).first()
    return [c for i, c in enumerate(texts) if (row[i] or 0) >= least]


def totals(df: DataFrame, label_column: str, numeric_cols: Sequence[str], label: str = "TOTAL") -> DataFrame:
    """One row: the sums of the numeric columns under ``label``."""
    return df.agg(*[F.sum(_value(df, c)).alias(c) for c in numeric_cols]).select(F.lit(label).alias(label_column), *[F.col(f"`{c}`") for c in numeric_cols])


def with_total_row(df: DataFrame, label_column: str, numeric_cols: Sequence[str], label: str = "TOTAL") -> DataFrame:
    """The table as text with its total row; for sinks only, so that totals are never read as data."""
    body = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    sums = totals(df, label_column, numeric_cols, label)
    last = sums.select(*[(F.col(f"`{c}`").cast("string") if c in sums.columns else F.lit("")).alias(c) for c in df.columns])
    return body.unionAll(last)
