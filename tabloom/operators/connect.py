"""Calls to outside services: distinct values out, one answer back for each, joined on.

A connector is a function from a pandas Series to a Series.  Values that a saved table already answers are not asked
again; an answer that fails is the value itself (or null), never a lost row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import clean_address, should_translate

Connector = Callable[[pd.Series], pd.Series]


def ask(values: DataFrame, column: str, connector: Connector, known: DataFrame | None = None, pause: float = 0.0, tries: int = 3, keep_on_error: bool = True, lanes: int = 1) -> DataFrame:
    """(value, answer) of the distinct values, with ``pause`` seconds between calls and, on errors, linear backoff.

    A rate is kept over all ``lanes`` together: each of them pauses as many times as long, so calls that are slow
    themselves need not wait for each other.  Without a pause every partition is a lane.
    """
    asked = values.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    if known is not None:
        asked = asked.join(known, "value", "left_anti")
    if pause:
        asked = asked.repartition(lanes) if lanes > 1 else asked.coalesce(1)
        pause = pause * lanes

    def alone(value: str) -> str | None:
        time.sleep(pause)
        try:
            return pd.Series(connector(pd.Series([value]))).iloc[0]
        except Exception:
            return value if keep_on_error else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answer = None
            for n in range(tries):
                try:
                    answer = connector(batch["value"])
                    break
                except Exception:
                    time.sleep(pause * (n + 1))
            if answer is None:  # one bad value does not take the answers of the others
                answer = pd.Series([alone(v) for v in batch["value"]], dtype=object)
            time.sleep(pause)
            yield pd.DataFrame({"value": batch["value"].values, "answer": pd.Series(answer).values})

    found = asked.mapInPandas(run, "value string, answer string")
    return found if known is None else known.unionByName(found)


def translate(cells: DataFrame, connector: Connector, fixed: DataFrame | None = None, known: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Cells with their texts translated: the fixed dictionary first, then the connector; outer white space stays."""
    inner = F.trim(F.col(column))
    marked = cells.withColumn("_t", F.when(should_translate(F.col(column)), inner))
    if fixed is not None:
        marked = marked.join(fixed.select(F.col("value").alias("_t"), F.col("answer").alias("_f")), "_t", "left")
    else:
        marked = marked.withColumn("_f", F.lit(None).cast("string"))
    answers = ask(marked.where("_f IS NULL"), "_t", connector, known).select(F.col("value").alias("_t"), F.col("answer").alias("_a"))
    joined = marked.join(answers, "_t", "left")
    new = F.coalesce("_f", "_a", "_t")
    whole = F.concat(F.regexp_extract(column, "^(\\s*)", 1), new, F.regexp_extract(column, "(\\s*)$", 1))
    return joined.withColumn(column, F.when(F.col("_t").isNotNull(), whole).otherwise(F.col(column))).select(*cells.columns)


def geocode(rows: DataFrame, column: str, connector: Connector, pause: float = 0.0, index: str = "row_index") -> DataFrame:
    """(row index, latitude, longitude, status) by the distinct cleaned addresses; answers are ``lat,lon`` or null."""
    cleaned = rows.select(index, clean_address(F.col(column)).alias("_a"))
    found = ask(cleaned.where("_a <> ''"), "_a", connector, pause=pause, keep_on_error=False)
    joined = cleaned.join(found, cleaned["_a"] == found["value"], "left")
    lat, lon = (F.get(F.split("answer", ","), F.lit(i)).try_cast("double") for i in (0, 1))
    return joined.select(index, lat.alias("latitude"), lon.alias("longitude"), F.when(lat.isNotNull() & lon.isNotNull(), "success").otherwise("failed").alias("status"))


def _place_key(column: str, region: str) -> Column:
    return F.concat(F.lower(clean_address(F.coalesce(F.col(column), F.lit("")))), F.lit(f"|{region.lower()}"))


def geocode_answers(rows: DataFrame, column: str, connector: Connector, region: str = "India", known: DataFrame | None = None) -> DataFrame:
    """(key, latitude, longitude, status) of the distinct addresses: ``success``, or ``not_found`` after all queries.

    A key is the cleaned address in lower case and the region.  An address is asked for in up to three ways, each only for those
    that the ones before did not find: cleaned with the region, cleaned alone, and as it stands with the region.  Answers of
    the connector are ``lat,lon`` or anything else for nothing found; a call that fails finds nothing.  Keys in ``known`` (the table
    that this function returns) are not asked for again, found or not.  Empty addresses are left out.

    Each partition asks in batches, all ways within one pass; write the answers before they are used twice.
    """
    cleaned = clean_address(F.coalesce(F.col(column), F.lit("")))
    asked = rows.select(_place_key(column, region).alias("key"), cleaned.alias("c"), F.trim(F.col(column)).alias("o")).where("c <> ''")
    asked = asked.groupBy("key").agg(F.min("c").alias("c"), F.min("o").alias("o"))
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")

    def located(answer: object) -> tuple[float, float] | None:
        try:
            lat, lon = str(answer).split(",")
            return float(lat), float(lon)
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[int, tuple[float, float]] = {}
            ways = ([f"{c}, {region}" if region else c for c in batch["c"]], list(batch["c"]), [f"{o}, {region}" if region and o != c else None for c, o in zip(batch["c"], batch["o"], strict=True)])
            for queries in ways:
                open_ = [i for i, q in enumerate(queries) if i not in found and q is not None]
                if not open_:
                    continue
                try:
                    answers = list(connector(pd.Series([queries[i] for i in open_])))
                except Exception:
                    answers = []
                    for i in open_:  # one bad address does not take the answers of the others
                        try:
                            answers.append(list(connector(pd.Series([queries[i]])))[0])
                        except Exception:
                            answers.append(None)
                found |= {i: place for i, a in zip(open_, answers, strict=True) if (place := located(a))}
            places = [found.get(i) for i in range(len(batch))]
            yield pd.DataFrame(
                {"key": batch["key"], "latitude": [p and p[0] for p in places], "longitude": [p and p[1] for p in places], "status": ["success" if p else "not_found" for p in places]}
            )

    answers = asked.select("key", "c", "o").mapInPandas(run, "key string, latitude double, longitude double, status string")
    return answers if known is None else known.select(*answers.columns).unionByName(answers)


def with_places(rows: DataFrame, column: str, answers: DataFrame, region: str = "India") -> DataFrame:
    """All rows with ``latitude, longitude, status`` from ``geocode_answers``; ``error`` where there is no address or answer."""
    told = answers.select(F.col("key").alias("_k"), "latitude", "longitude", "status")
    joined = rows.drop("latitude", "longitude", "status").join(told, _place_key(column, region) == F.col("_k"), "left").drop("_k")
    return joined.withColumn("status", F.coalesce("status", F.lit("error")))
