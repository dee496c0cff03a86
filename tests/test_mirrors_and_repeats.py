"""Mirrored text with all its fixed values, shared names, and repeated rows in closest-row joins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import reversal
from tabloom.operators import connect, lookup, records, rows, segment


@pytest.mark.parametrize("t", ["JKMDJAIA", "KMDMAIA", ".PIHSNAM", ".ON .LS", "detcejeR", "- ILIKEHT", "-YNOLOK", "x )a( y"])
def test_mirrored(t):
    assert reversal.looks_reversed(t)


@pytest.mark.parametrize("t", ["AIMDJMK", "AIADMK", "KARTHIYANIP.", "NEELAMAGAM", "MANSHIP.", "SL. NO.", "Rejected", "", "A", "AB", "   "])
def test_not_mirrored(t):
    assert not reversal.looks_reversed(t)


def test_score():
    assert reversal.naturalness("AIMDJMK") > reversal.naturalness("JKMDJAIA")
    # pairs KA-AT-TC-CH-HI hold AT; the term counts twice 2 and once -5
    assert reversal.naturalness("KATCHI") == 1 + 4 - 5
    assert reversal.naturalness("ab") == 0
    assert all(reversal.clustered(t) for t in ("JKMDJAIA", "STRENGTH")) and not reversal.clustered("CHANDRAHASAM")


def test_shared_names(spark):
    asked = [
        ("C.N. Annadurai", None, "DMK"), ("Annadurai", "Tiruvannamalai", "DMK"), ("Annadurai", "Salem", "PMK"),
        ("Senthilnathan", "Karur", "BJP"), ("P. Senthilnathan", None, "AMMK"), ("Senthilnathan", None, None),
        ("Jothi Venkatesan", None, "PMK"), ("Su. Venkatesan", "x", "CPI(M)"), ("A. Mani", None, "DMK"),
        ("Tamil Mani", None, "AIADMK"), ("Mani", "Namakkal", "AIADMK"), ("Other", "Karur", None), (None, "Karur", None),
    ]
    df = spark.createDataFrame(asked, "t string, c string, want string")
    assert df.where(~lookup.collision(F.col("t"), F.col("c")).eqNullSafe(F.col("want"))).count() == 0


def test_repeated_rows_stay(spark):
    left = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("k", 9.0)], "k string, a double")
    right = spark.createDataFrame([("k", 1.5, 7), ("k", 1.2, 8)], "k string, b double, id int")
    near = lookup.nearest(left, right, "k", "a", "b", 1.0, "id")
    band = segment.band_join(left, right, ["k"], "a", "b", 1.0, "id")
    assert [tuple(r) for r in near.collect()] == [("k", 1.0, 1.2, 8)] * 2
    assert [tuple(r) for r in band.collect()] == [("k", 1.0, 1.5, 7)] * 2
    names = spark.createDataFrame([("k", "abcd")] * 2, "k string, n string")
    known = spark.createDataFrame([("k", "abce", 1)], "k string, m string, p int")
    close = lookup.close_match(names, known, "n", "m", ["k"], 0.7)
    assert [(r["n"], r["m"], r["score"]) for r in close.collect()] == [("abcd", "abce", 0.75)] * 2


def test_wide_rows(spark):
    cells = ["1", "school"] + ["x"] * 1200 + ["12", "34"]
    area = ["1", "2"] + ["x"] * 200 + ["All Voters"]
    df = spark.createDataFrame([(cells, area)], "c array<string>, a array<string>")
    got = df.select(rows.is_structured_data_row(F.col("c")), records.polling_row(F.col("a"))["station_type"]).first()
    assert tuple(got) == (True, "All Voters")


def test_one_failing_value_keeps_the_others(spark):
    def connector(s: pd.Series) -> pd.Series:
        if (s == "bad").any():
            raise ValueError("bad")
        return s.str.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "v string").coalesce(1)
    for keep, bad in ((True, "bad"), (False, None)):
        got = {r["value"]: r["answer"] for r in connect.ask(df, "v", connector, tries=1, keep_on_error=keep).collect()}
        assert got == {"a": "A", "b": "B", "bad": bad}
