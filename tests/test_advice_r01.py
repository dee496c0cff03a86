"""Whole jobs that the first round's operators did only in part."""

import os

import pytest
from pyspark.sql import functions as F

from tabloom import model
from tabloom.operators import segment
from tabloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sparse_to_dense(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(queries, "to_rows", lambda *a: calls.append(a) or model.to_rows(*a), raising=False)
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    whole = queries.QUERIES["sparse_to_dense_all"](spark, SF).collect()
    assert sum(r["n"] for r in whole) == orders and len(whole) == 75
    queries.QUERIES["sparse_to_dense"](spark, SF)
    assert len(calls) == 2
    assert "set_symdiff_all" in queries.ORACLE_SQL and "%" not in queries.ORACLE_SQL["set_symdiff_all"]


def test_box_columns(spark):
    many = spark.range(1500).selectExpr("cast(id as int) AS rank", "id * 10.0 AS lo", "id * 10.0 + 8 AS hi")
    boxes = spark.createDataFrame([(r, 10.0 * r + 1, 2.0) for r in (0, 999, 1000, 1499, 1499)], "n int, x double, width double")
    assert sorted((r["n"], r["column"]) for r in segment.box_columns(boxes, many).collect()) == [(r, r) for r in (0, 999, 1000, 1499, 1499)]
    rows = [("a", 1, 0, 1.0), ("a", 1, 0, 11.0), ("b", 1, 0, 11.0), ("b", 1, 0, 31.0), ("b", 2, 0, 5.0)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, row int, x double").withColumn("width", F.lit(2.0))
    extents = segment.column_extents(pages.where("page = 1"), ["doc_id", "page", "row"], ["doc_id", "page"])
    got = {(r["doc_id"], r["page"], r["x"]): r["column"] for r in segment.box_columns(pages, extents).collect()}
    assert got == {("a", 1, 1.0): 0, ("a", 1, 11.0): 1, ("b", 1, 11.0): 0, ("b", 1, 31.0): 1, ("b", 2, 5.0): None}
