"""Operators on the set of columns of one wide table; planning reads names only, work stays lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import ac_number, booth_name, party_in_cell
from tabloom.operators.labels import resolve_columns, suggest_columns


def distinct_names(names: Sequence[str]) -> list[str]:
    """Repeated names get `` (2)``, `` (3)`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def select_columns(df: DataFrame, wanted: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns in the wanted order, found by the resolution ladder and renamed; names that match nothing raise with
    suggestions."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "name string, pos int")
    asked = spark.createDataFrame([(w,) for w in wanted], "requested string")
    found = {r["requested"]: r["name"] for r in resolve_columns(asked, names).collect()}
    missing = [w for w in wanted if w not in found]
    if missing:
        near = suggest_columns(asked.where(F.col("requested").isin(missing)), names).orderBy("requested", "rank").collect()
        raise ValueError(f"no column for {missing}; near: {[r['name'] for r in near]}")
    titles = distinct_names([(rename or {}).get(w, found[w]) for w in wanted])
    return df.select(*[F.col(f"`{found[w]}`").alias(t) for w, t in zip(wanted, titles, strict=True)])


def order_columns(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """Known names in their order, then the others in theirs."""
    rank = {k: i for i, k in enumerate(known)}
    return sorted(names, key=lambda n: (rank.get(n, len(rank)), names.index(n)))


def order_by_role(names: Sequence[str], roles: Mapping[str, str]) -> list[str]:
    """Metadata, then parties, then others, then counts; each in its order."""
    rank = {"identifier": 0, "location": 0, "party": 1, "count": 3}
    return sorted(names, key=lambda n: (rank.get(roles.get(n, ""), 2), names.index(n)))


def guess_column(names: Sequence[str], keywords: Sequence[str]) -> str:
    """The first name with a keyword, else the first."""
    return next((n for n in names if any(k in n.lower() for k in keywords)), names[0])


def with_constant_first(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(value).alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


def with_ac_number(df: DataFrame, pages: DataFrame, name: str = "AC NO.") -> DataFrame:
    """The constituency number of each table's document as first column: the first page that states one."""
    found = pages.withColumn("_n", ac_number(F.col("text"))).where("_n IS NOT NULL").groupBy("doc_id").agg(F.min_by("_n", "page").alias(name))
    joined = df.join(found, df["table_id"] == found["doc_id"], "left").drop("doc_id")
    return joined.select(F.coalesce(f"`{name}`", F.lit("")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def with_booth_name(df: DataFrame, source: str, name: str = "Booth Name") -> DataFrame:
    """The institution's name right after the column it is taken from."""
    out: list[Column] = []
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        if c == source:
            out.append(booth_name(F.col(f"`{c}`")).alias(name))
    return df.select(*out)


def apply_by_index(df: DataFrame, results: DataFrame, index: str = "row_index") -> DataFrame:
    """Add or overwrite the columns of ``results`` by row index; rows without a result have nulls."""
    new = [c for c in results.columns if c != index]
    return df.drop(*new).join(results, index, "left")


def edit_cell(df: DataFrame, row: int, column: str, value: str, key: str = "row_idx") -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) == row, F.lit(value)).otherwise(F.col(f"`{column}`")))


def insert_row(df: DataFrame, row: int, above: bool, key: str = "row_idx") -> DataFrame:
    """An empty row above or below another; the rows from there on move by one."""
    at = row if above else row + 1
    moved = df.withColumn(key, F.when(F.col(key) >= at, F.col(key) + 1).otherwise(F.col(key)).cast(df.schema[key].dataType))
    blank = df.sparkSession.range(1).select(
        *[(F.lit(at).cast(f.dataType) if f.name == key else F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema.fields]
    )
    return moved.unionByName(blank)


def delete_row(df: DataFrame, row: int, key: str = "row_idx") -> DataFrame:
    kept = df.where(F.col(key) != row)
    return kept.withColumn(key, F.when(F.col(key) > row, F.col(key) - 1).otherwise(F.col(key)).cast(df.schema[key].dataType))


def is_sequential(df: DataFrame, column: str, order: Sequence[str], rows: int = 20, share: float = 0.7) -> bool:
    """Whether the first rows hold three integers at least whose steps are mostly 0 or 1."""
    head = df.orderBy(*order).limit(rows).select(F.col(f"`{column}`").cast("string").try_cast("int").alias("n"), *order).where("n IS NOT NULL")
    step = F.col("n") - F.lag("n").over(W.orderBy(*order))  # at most `rows` rows
    r = head.withColumn("s", step).agg(F.count("n"), F.avg(F.when(F.col("s").isNotNull(), F.col("s").isin(0, 1).cast("int")))).first()
    return r[0] >= 3 and (r[1] or 0) >= share


def drop_twin_serials(df: DataFrame, order: Sequence[str], rows: int = 20, same: float = 0.8) -> DataFrame:
    """Drop the second of two neighbouring serial columns: both named so, both sequential, mostly equal."""
    serial = [c for c in df.columns if c.lower().replace(".", "").strip() in ("sl no", "slno", "s no", "sno", "serial no", "sr no", "no", "serial number")]
    gone = set()
    for a, b in zip(df.columns, df.columns[1:], strict=False):
        if a in serial and b in serial and a not in gone and is_sequential(df, a, order, rows) and is_sequential(df, b, order, rows):
            equal = df.orderBy(*order).limit(rows).agg(F.avg((F.col(f"`{a}`") == F.col(f"`{b}`")).cast("int"))).first()[0]
            if (equal or 0) >= same:
                gone.add(b)
    return df.drop(*gone)


def combine_headers(block: DataFrame, style: str = "last") -> DataFrame:
    """(table_id, col_idx, header) from a header block (table_id, row_idx, col_idx, value).

    ``last``: the party in parentheses if any part has one, else the last specific part; ``name_party``: the parts with
    the party on a line of its own; columns without any part are ``Column k``.  Labels that span (the same text in
    three columns of a row or more) are skipped where there is another part.
    """
    span = F.count(F.lit(1)).over(W.partitionBy("table_id", "row_idx", "value"))
    parts = block.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).withColumn("spans", span >= 3).where("value <> ''")
    listed = parts.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "value", "spans"))).alias("p"))
    own = F.filter("p", lambda x: ~x["spans"])
    texts = F.array_distinct(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("p")), lambda x: x["value"]))
    listed = listed.withColumn("t", texts)
    party = F.try_element_at(F.filter(F.transform("t", party_in_cell), lambda x: x.isNotNull()), F.lit(-1))
    if style == "name_party":
        names = F.filter("t", lambda x: party_in_cell(x).isNull())
        header = F.when(party.isNotNull() & (F.size(names) > 0), F.concat(F.array_join(names, " "), F.lit("\n("), party, F.lit(")"))).otherwise(F.array_join("t", " "))
    else:
        header = F.coalesce(party, F.element_at("t", -1))
    columns = block.select("table_id", "col_idx").distinct()
    return columns.join(listed.select("table_id", "col_idx", header.alias("header")), ["table_id", "col_idx"], "left").withColumn(
        "header", F.coalesce("header", F.format_string("Column %d", F.col("col_idx") + 1))
    )


def number_independents(headers: DataFrame) -> DataFrame:
    """Headers (table_id, col_idx, party) with every independent named ``IND_k`` in column order."""
    is_ind = F.upper("party").isin("IND", "INDEPENDENT")
    k = F.sum(is_ind.cast("int")).over(W.partitionBy("table_id").orderBy("col_idx"))
    return headers.withColumn("party", F.when(is_ind, F.concat(F.lit("IND_"), k.cast("string"))).otherwise(F.col("party")))


def candidate_columns(headers: DataFrame) -> DataFrame:
    """(table_id, col_idx, name, party) of headers like ``NAME (PARTY)``."""
    party = F.regexp_extract("header", "\\(([^()]*(?:\\([A-Z]\\))?)\\)\\s*$", 1)
    return headers.where(party != "").select("table_id", "col_idx", F.trim(F.regexp_extract("header", "^(.*?)\\s*\\(", 1)).alias("name"), F.trim(party).alias("party"))


def standard_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.toDF(*distinct_names([mapping.get(c, c) for c in df.columns]))


def row_sum(df: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))


def search_columns(headers: DataFrame, text: str) -> DataFrame:
    """The headers (table_id, col_idx, header) that hold a text, without regard to case; an empty text finds all."""
    return headers.where(F.contains(F.lower(F.coalesce("header", F.lit(""))), F.lit(text.strip().lower())))
